"""Exact top-k by inner product over a bit-sliced index.

A block of rows holds, for each dimension, one bitmap per bit of its quantised values. A query adds shifted
slices with bitmap adders until one bitmap per bit of the score is left; the best rows are then selected
from the most significant slice downward, and rows that tie at the boundary are resolved by id.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.session import written


def slices_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitmaps (all slices of dimension 0, then 1, ...) of an (n, dims) array, the least value and the bits per dimension."""
    n, dims = values.shape
    low = values.min(axis=0)
    shifted = (values - low).astype(np.uint64)
    bits = np.array([int(m).bit_length() for m in shifted.max(axis=0)], np.int64)
    words = -(-n // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    row = 0
    for d in range(dims):
        for b in range(bits[d]):
            packed = np.packbits((shifted[:, d] >> np.uint64(b)) & np.uint64(1), bitorder="little")
            out[row, : len(packed)] = packed
            row += 1
    return out.view(np.uint64).reshape(len(out), words), low, bits


def signed_digits(value: int) -> list[tuple[int, int]]:
    """(bit, +1 or -1) with no two neighbouring bits, so few slices are added."""
    out, at = [], 0
    while value:
        if value & 1:
            digit = 2 - (value & 3)
            out.append((at, digit))
            value -= digit
        value >>= 1
        at += 1
    return out


class ScoreOverflow(OverflowError):
    """A score among the best that 64 bits do not hold."""


class BitSlices:
    """One block of the index, ready for queries."""

    def __init__(self, ids: np.ndarray, slices: np.ndarray, low: np.ndarray, bits: np.ndarray):
        self.ids, self.slices, self.low, self.bits = ids, slices, [int(x) for x in low], [int(b) for b in bits]
        self.flipped = ~slices
        self.start = np.concatenate([[0], np.cumsum(bits)]).astype(int)
        n, words = len(ids), -(-len(ids) // 64)
        self.rows = np.full(words, ~np.uint64(0))
        if n % 64:
            self.rows[-1] = np.uint64((1 << (n % 64)) - 1)

    def add(self, query: list[int]) -> tuple[dict[int, np.ndarray], int]:
        """Bitmaps of the score by bit, and what is to be added to it."""
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        constant = 0
        for d, value in enumerate(query):
            constant += value * self.low[d]
            first = self.start[d]
            for at, digit in signed_digits(value):
                source = self.slices if digit > 0 else self.flipped
                if digit < 0:  # -u is the flipped bits of u less the largest u
                    constant -= ((1 << self.bits[d]) - 1) << at
                for b in range(self.bits[d]):
                    columns[at + b].append(source[first + b : first + b + 1])
        total, weight = {}, min(columns, default=0)
        while weight in columns:
            own = np.concatenate(columns.pop(weight))
            while len(own) > 1:
                if len(own) == 2:
                    columns[weight + 1].append(own[:1] & own[1:])
                    own = own[:1] ^ own[1:]
                    break
                third = len(own) // 3
                a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
                half = a ^ b
                columns[weight + 1].append((a & b) | (half & c))
                own = np.concatenate([half ^ c, own[3 * third :]])
            total[weight] = own[0]
            weight += 1
            if weight not in columns and columns:
                weight = min(columns)
        return total, constant

    def top(self, query: list[int], k: int, own: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k best rows other than ``own``, ties to the smaller id; in no order."""
        total, constant = self.add(query)
        tied = self.rows.copy()
        for row in range(*np.searchsorted(self.ids, [own, own + 1])):
            tied[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        sure = np.zeros_like(tied)
        for weight in sorted(total, reverse=True):
            high = tied & total[weight]
            both = int(np.bitwise_count(sure | high).sum())
            if both > k:
                tied = high
            else:
                sure |= high
                tied &= ~total[weight]
                if both == k:
                    tied[:] = 0
                    break
        best, rest = self._positions(sure), self._positions(tied)
        best = np.concatenate([best, rest[: k - len(best)]])  # positions follow the ids
        scores = [constant] * len(best)
        for weight, bitmap in total.items():
            on = (bitmap[best // 64] >> (best % 64).astype(np.uint64)) & np.uint64(1)
            scores = [s + (int(o) << weight) for s, o in zip(scores, on, strict=True)]
        return self.ids[best], scores

    def _positions(self, bitmap: np.ndarray) -> np.ndarray:
        words = np.flatnonzero(bitmap)
        bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")
        at, bit = np.nonzero(bits)
        return words[at] * 64 + bit


def _index(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id", kind="stable")
    slices, low, bits = slices_of(np.stack(pdf["v"].to_numpy()))
    return pd.DataFrame(
        {"dims": [len(low)], "block": [pdf["block"].iloc[0]], "ids": [pdf["id"].to_numpy()], "low": [low], "bits": [bits],
         "slices": [slices.tobytes()]}
    )


def quantised(vectors: DataFrame, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(id, dims, v) of the rows that take part: an id, and components that are neither null nor infinite."""
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("e"))
    rows = rows.where(F.col("id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & fine)
    large = F.raise_error(F.lit("a component times the scale does not fit 62 bits")).cast("long")
    v = F.transform("e", lambda x: F.when(F.abs(x * scale) < 2.0**62, F.floor(x * scale).cast("long")).otherwise(large))
    return rows.select("id", F.size("e").alias("dims"), v.alias("v")).distinct()


def build_index(rows: DataFrame, blocks: int) -> DataFrame:
    """One row per block: ids (ascending), least values, bits and bitmaps. Blocks are dealt by hash."""
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    return dealt.groupBy("dims", "block").applyInPandas(
        _index, "dims int, block long, ids array<long>, low array<long>, bits array<long>, slices binary"
    )


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, bits = np.array(row["ids"], np.int64), np.array(row["bits"], np.int64)
                slices = np.frombuffer(row["slices"], np.uint64).reshape(int(bits.sum()), -(-len(ids) // 64))
                index = BitSlices(ids, slices, np.array(row["low"], np.int64), bits)
                out: tuple[list, list, list] = ([], [], [])
                for q in row["queries"]:
                    found, scores = index.top(q["v"], k, q["id"])
                    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
                        raise ScoreOverflow(f"a score of query {q['id']} does not fit 64 bits")
                    out[0].extend([q["id"]] * len(found))
                    out[1].extend(found.tolist())
                    out[2].extend(scores)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "vec_id", "score"])

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    scale: int = 64,
    rows_per_block: int = 32768,
    queries_per_block: int = 512,
) -> DataFrame:
    """The ``k`` best rows of each query: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id.
    A row is never a result of a query with its own id. Rows without id, and vectors that are null, empty
    or hold null or non-finite components, take no part; vectors of different length are not compared.
    Repeated rows are one row; different vectors under one id all take part, and results of the queries
    under one id are ranked together. Each block of queries meets each block of the index once: tasks hold
    one of each. Empty tables give no rows, extra columns are not returned. Scores are added in integers of any
    size; one among the best that does not fit 64 bits ends the job with ``ScoreOverflow``, a component times the
    scale of 2^62 or more with an error that says so.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = written(quantised(vectors, vec_id, vector, scale), "quantised")
    asked = quantised(queries, vec_id, vector, scale)
    row_blocks = max(1, -(-rows.count() // rows_per_block))
    index = written(build_index(rows, row_blocks), "index")
    blocks = max(1, -(-asked.count() // queries_per_block))
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    dealt = written(dealt.groupBy("dims", "part").agg(F.collect_list(F.struct("id", "v")).alias("queries")), "queries")
    # every block of queries meets every block of rows; the join leaves out blocks that are empty
    index = index.withColumn("part", F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")))
    # a pair of blocks is seconds of work: each may have a task, whatever the size of the files
    index = index.repartition(min(blocks * row_blocks, 100_000), "block", "part")
    dealt = dealt.withColumn("block", F.explode(F.expr(f"sequence(0L, {row_blocks - 1}L)")))
    pairs = index.join(dealt, ["dims", "part", "block"]).select("ids", "low", "bits", "slices", "queries")
    best = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
