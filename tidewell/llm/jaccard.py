"""Groups of documents whose word shingles overlap, by a parity-sketch join. All links count, none is missed.

1.  Documents with the same set of shingles are one class, and its smallest id stands for it.
2.  A class writes its set into a parity sketch: each shingle flips a bit of one part. Linked sets of sizes
    a and b differ in at most d = (a + b) (1 - t) / (1 + t) shingles, so in at most d parts. The number of
    parts depends on the size band, and a class sketches itself for each band of a possible partner.
3.  Pigeonhole: in any order of the parts that all classes share, two linked classes agree in one of their
    first d + 1 parts that are not zero. The order is by number of classes that hold the part, rare ones
    first, so most classes find nothing to share, and common passages are hardly ever looked at.
4.  Classes that agree in a part are candidates. Where many agree, the shingles that only one of them holds
    are counted: they tell most pairs that cannot link. The rest are first compared with a few pivots; classes
    that are connected then need no further comparison, the others are compared.
5.  Every pair must pass a bound before it goes on: parity bits of the two sets differ in no more places than the
    sets differ in shingles, so a Hamming distance above d rules a link out. What is left is verified on whole
    texts; links give components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm import shingles as S
from tidewell.llm.common import packed, unpacked, utf8
from tidewell.llm.components import components, extended
from tidewell.session import written

#: ids from here on stand for rows without an id
UNNAMED = 1 << 62
#: sets below this size are not folded into parts: a part per shingle
FINE = 128
#: parts shared by more classes than this are compared with a pivot first: the class with the least excess, which
#: crowded parts mostly have in common
FEW = 16
#: further pivots by hash, at first and in each of the rounds for parts that are still unsettled
PIVOTS = 0
ROUNDS = 1
#: classes of one part that are compared in one task
SIDE = 4096
#: 64-bit words of what is compared first and of what moves with a class; bits of the smallest sketch
FIRST, COARSE, LEAST_BITS = 8, 32, 2048


class Bands:
    """Size bands: below ``fine``, then doubling. ``spread``: shingles per part at the top of a band."""

    def __init__(self, num: int, den: int, spread: float, fine: int = FINE):
        self.num, self.den, self.spread, self.fine = num, den, spread, fine

    def of(self, n: int) -> int:
        return (n // self.fine).bit_length()

    def top(self, band: int) -> int:
        return (self.fine << band) - 1

    def parts(self, band: int) -> int:
        # the larger the set, the less its number of parts that are not zero strays
        return 0 if band == 0 else max(1, int(self.top(band) / (self.spread * (0.85, 0.93, 1.0)[min(band, 3) - 1])))

    def apart(self, sizes: int) -> int:
        """Most shingles in which two linked sets of together ``sizes`` differ."""
        return sizes * (self.den - self.num) // (self.den + self.num)

    def bits(self, n: int) -> int:
        """Places of the parity bits of a set: 32 or more for each shingle in which a linked set may differ."""
        return max(LEAST_BITS, 1 << (32 * self.apart(n + n * self.den // self.num)).bit_length())

    def roles(self, n: int) -> Iterator[tuple[int, int]]:
        """(band, d): the bands of partners at least as large, and d for the largest of them."""
        most = n * self.den // self.num
        for band in range(self.of(n), self.of(most) + 1):
            yield band, self.apart(n + min(most, self.top(band)))


def _sets(texts: pa.Array) -> pa.Array:
    out = []
    for raw in texts.to_pylist():
        own = S.shingles(raw)
        a, b = S.set_key(own)
        out.append({"n": len(own), "a": a, "b": b})
    return pa.array(out, pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]))


def _long(values) -> pa.Array:
    return pa.array(np.asarray(values, np.int64))


_SKETCHED = "bucket long, toks array<int>, nodes array<long>, bands array<tinyint>, n array<int>, slack array<int>"
_COUNTED = "dest long, bucket long, toks array<int>, nodes array<long>, bands array<tinyint>, c array<int>, n array<int>, slack array<int>"
_FIRST = "bucket long, toks array<int>, nodes array<long>, n array<int>"
_FOUND = "tok long, node long, other long, n long, other_n long, size long"


def _dealt(key: np.ndarray, kinds: dict[str, tuple[np.ndarray, type]], name: str, **same) -> pa.Table:
    """One row per value of ``key`` with the lists of its entries: the shuffle moves rows, not single tokens."""
    order = np.argsort(key, kind="stable")
    own, first = np.unique(key[order], return_index=True)
    bounds = pa.array(np.append(first, len(order)), pa.int32())
    columns = {name: pa.array(own, pa.int64())} | {k: pa.array([v] * len(own), pa.int64()) for k, v in same.items()}
    for k, (values, kind) in kinds.items():
        # no values: empty lists
        flat = pa.array(values[order].astype(kind)) if values is not None else pa.array([], pa.from_numpy_dtype(kind))
        columns[k] = pa.ListArray.from_arrays(bounds if values is not None else pa.array(np.zeros(len(own) + 1), pa.int32()), flat)
    return pa.table(columns)


def _flat(table: pa.Table, names: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The values of list columns, and how many each row has."""
    lists = {c: table[c].combine_chunks() for c in names}
    values = {c: x.flatten().to_numpy(zero_copy_only=False) for c, x in lists.items()}
    return values, {c: np.asarray(x.value_lengths()).astype(np.int64) for c, x in lists.items()}


def _sketched(bands: Bands, buckets: int):
    """Tokens of a batch, packed by bucket, and rows without tokens: the size of each class and how many of its
    parts may be left out (``slack``). A null bucket tells that some class has too few parts to decide."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks, nodes, roles, about, short = [], [], [], [], False
            for node, raw in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = S.shingles(raw)
                n = len(own)
                for band, apart in bands.roles(n) if n else ():
                    tokens = S.sketch_tokens(own, bands.parts(band))
                    if band == bands.of(n) and len(tokens) <= bands.apart(2 * n):
                        short = True
                    toks.append(tokens)
                    nodes.append(np.full(len(tokens), node, np.int64))
                    roles.append(np.full(len(tokens), band, np.int8))
                    about.append((node, band, n, len(tokens) - apart - 1))
            if not about:
                continue
            tok = np.concatenate(toks)
            bucket = (((tok >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            low = (tok & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            node, band, n, slack = (np.array(x) for x in zip(*about, strict=True))
            at = (S.mix(node.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            none = (None, np.int32)
            parts = [
                _dealt(bucket, {"toks": (low, np.int32), "nodes": (np.concatenate(nodes), np.int64), "bands": (np.concatenate(roles), np.int8), "n": none, "slack": none}, "bucket"),
                _dealt(at, {"toks": none, "nodes": (node, np.int64), "bands": (band, np.int8), "n": (n, np.int32), "slack": (slack, np.int32)}, "bucket"),
            ]
            if short:
                parts.append(parts[0].slice(0, 1).set_column(0, "bucket", pa.nulls(1, pa.int64())))
            for part in parts:
                yield from part.combine_chunks().to_batches()

    return run


def _counted(buckets: int):
    """Tokens of a bucket that several classes hold, with their number, packed by class; the sizes pass through."""

    def run(table: pa.Table) -> pa.Table:
        values, sizes = _flat(table, ["toks", "nodes", "bands", "n", "slack"])
        bucket = table["bucket"][0].as_py()
        if bucket is None:
            mark = _dealt(np.zeros(1, np.int64), {k: (None, t) for k, t in _KINDS}, "dest", bucket=None)
            return mark.set_column(0, "dest", pa.nulls(1, pa.int64()))
        about = np.repeat(sizes["toks"] == 0, sizes["nodes"])
        tok, node, band = values["toks"].view(np.uint32), values["nodes"][~about], values["bands"][~about]
        _, place, c = np.unique(tok, return_inverse=True, return_counts=True)
        c = c[place]
        own = c > 1
        dest = lambda x: (S.mix(x.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        node, tok, band, c = node[own], tok[own].view(np.int32), band[own], c[own]
        none, whose = (None, np.int32), values["nodes"][about]
        held = {"toks": (tok, np.int32), "nodes": (node, np.int64), "bands": (band, np.int8), "c": (c, np.int32), "n": none, "slack": none}
        said = {"toks": none, "nodes": (whose, np.int64), "bands": (values["bands"][about], np.int8), "c": none,
                "n": (values["n"], np.int32), "slack": (values["slack"], np.int32)}
        return pa.concat_tables(
            [_dealt(dest(node), held, "dest", bucket=bucket), _dealt(dest(whose), said, "dest", bucket=bucket)]
        )

    return run


_KINDS = [("toks", np.int32), ("nodes", np.int64), ("bands", np.int8), ("c", np.int32), ("n", np.int32), ("slack", np.int32)]


def _first(table: pa.Table) -> pa.Table:
    """Of each class and band the first parts in the order (classes that hold it, part), packed by bucket again.

    A class with several texts keeps all its parts, and its size is unknown (-1).
    """
    if table["dest"][0].as_py() is None:
        return _dealt(np.zeros(1, np.int64), {"toks": (None, np.int32), "nodes": (None, np.int64), "n": (None, np.int32)}, "bucket").set_column(
            0, "bucket", pa.nulls(1, pa.int64())
        )
    values, sizes = _flat(table, [k for k, _ in _KINDS])
    said = np.repeat(sizes["n"] > 0, sizes["nodes"])
    bucket = np.repeat(table["bucket"].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64), sizes["nodes"])
    node, band = values["nodes"], values["bands"]
    tok, c = _spread(values["toks"].view(np.uint32), ~said), _spread(values["c"], ~said)
    n, slack = _spread(values["n"], said), _spread(values["slack"], said)
    order = np.lexsort((tok, bucket, c, band, node))  # what is said of a class has c = 0 and comes first
    node, band, tok, c, n, slack, bucket, said = (x[order] for x in (node, band, tok, c, n, slack, bucket, said))
    start = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (band[1:] != band[:-1])))
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(node))))
    told = np.add.reduceat(said.astype(np.int64), start)
    count = np.diff(np.append(start, len(node))) - told
    place = np.arange(len(node)) - start[run] - told[run]
    keep = ~said & ((told[run] > 1) | (place < count[run] - slack[start][run]))
    size = np.where(told > 1, -1, n[start])[run]
    kinds = {"toks": (tok[keep].astype(np.uint32).view(np.int32), np.int32), "nodes": (node[keep], np.int64), "n": (size[keep], np.int32)}
    return _dealt(bucket[keep], kinds, "bucket")


def _spread(own: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), np.int64)
    out[where] = own
    return out


def _close(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether two sizes allow a link; an unknown one does."""
    return (np.minimum(x, y) < 0) | (np.minimum(x, y) * den >= np.maximum(x, y) * num)


def _found(few: int, num: int, den: int):
    """Pairs of the parts that few classes hold, and the members of the others."""

    def run(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        if bucket is None:
            return pa.table({k: pa.nulls(1, pa.int64()) for k in _FOUND_NAMES})
        values, _ = _flat(table, ["toks", "nodes", "n"])
        tok, node, n = values["toks"].view(np.uint32).astype(np.int64), values["nodes"], values["n"].astype(np.int64)
        order = np.lexsort((node, tok))
        tok, node, n = tok[order], node[order], n[order]
        once = np.append(True, (tok[1:] != tok[:-1]) | (node[1:] != node[:-1]))[: len(tok)]
        tok, node, n = tok[once], node[once], n[once]
        _, start, size = np.unique(tok, return_index=True, return_counts=True)
        pairs = [np.zeros((4, 0), np.int64)]
        for s in range(2, few + 1):
            at = start[size == s]
            for i in range(s - 1):
                for j in range(i + 1, s):
                    x, y = at + i, at + j
                    fine = _close(n[x], n[y], num, den)
                    pairs.append(np.stack([node[x], node[y], n[x], n[y]])[:, fine])
        two = np.unique(np.concatenate(pairs, axis=1), axis=1)
        own = np.repeat(size, size) > few
        members = _long((bucket << 32) + tok[own]), _long(node[own]), _long(n[own]), _long(np.repeat(size, size)[own])
        no = lambda k: pa.nulls(k, pa.int64())
        a, m = two.shape[1], int(own.sum())
        columns = [(no(a), members[0]), (_long(two[0]), members[1]), (_long(two[1]), no(m)), (_long(two[2]), members[2]),
                   (_long(two[3]), no(m)), (no(a), members[3])]
        return pa.table({k: pa.concat_arrays(x) for k, x in zip(_FOUND_NAMES, columns, strict=True)})

    return run


_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _verified(num: int, den: int):
    """(a, b, linked) of pairs with their texts. Sets are kept while the next pairs need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}

        def of(node: int, text) -> np.ndarray:
            if node not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[node] = S.shingles(text.as_py())
            return known[node]

        for batch in batches:
            a, b, both, union = batch["a"].to_pylist(), batch["b"].to_pylist(), [], []
            for x, y, tx, ty in zip(a, b, batch["ta"], batch["tb"], strict=True):
                own, other = of(x, tx), of(y, ty)
                both.append(S.shared(own, other))
                union.append(len(own) + len(other) - both[-1])
            linked = [den * i >= num * u for i, u in zip(both, union, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["a"], batch["b"], _long(both), _long(union), pa.array(linked, pa.bool_())],
                ["a", "b", "both", "together", "linked"],
            )

    return run


def _shingled(buckets: int):
    """The shingles of a batch, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = [S.shingles(raw) for raw in batch["text"].to_pylist()]
            nodes = np.repeat(np.array(batch["node"].to_pylist(), np.int64), [len(t) for t in toks])
            tok = np.concatenate([np.zeros(0, np.uint64), *toks])
            bucket = (((tok >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
            low = (tok & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)
            yield from _dealt(bucket, {"toks": (low, np.int32), "nodes": (nodes, np.int64)}, "bucket").combine_chunks().to_batches()

    return run


def _singles(table: pa.Table) -> pa.Table:
    """How many shingles of a bucket only this class holds."""
    values, _ = _flat(table, ["toks", "nodes"])
    _, first, c = np.unique(values["toks"], return_index=True, return_counts=True)
    node, count = np.unique(values["nodes"][first[c == 1]], return_counts=True)
    return pa.table({"node": _long(node), "own": _long(count)})


def with_excess(crowded: DataFrame, texts: DataFrame, bands: Bands) -> DataFrame:
    """Members with ``e``; classes whose sum of ``e`` is above 0 cannot link.

    A shingle that no other class of a crowded part holds is in the symmetric difference of every pair, so a
    pair differs in the sum of these at least, and may differ in (a + b) (1 - t) / (1 + t). A class of
    unknown size may link with any. Members without a possible partner in their part are left out.
    """
    nodes = written(crowded.select("node").distinct(), "nodes")
    total = crowded.select("node", "n").distinct().agg(F.sum("n")).first()[0] or 0
    packs = texts.join(nodes, "node", "left_semi").mapInArrow(
        _shingled(max(1, total // 500_000)), "bucket long, toks array<int>, nodes array<long>"
    )
    singles = packs.groupBy("bucket").applyInArrow(_singles, "node long, own long").groupBy("node").agg(F.sum("own").alias("own"))
    members = crowded.join(written(singles, "singles"), "node", "left")
    e = F.coalesce("own", F.lit(0)) * (bands.den + bands.num) - F.col("n") * (bands.den - bands.num)
    members = written(members.withColumn("e", F.when(F.col("n") < 0, F.lit(-(1 << 60))).otherwise(e)).drop("own"), "members")
    # the two smallest: a member's best partner is not itself
    two = members.groupBy("tok").agg(F.min(F.struct("e", "node")).alias("x"))
    least = written(two.select("tok", "x.e", "x.node").toDF("tok", "least", "who"), "least")
    return written(
        members.join(least, "tok").where((F.col("node") == F.col("who")) | (F.col("e") + F.col("least") <= 0)).drop("least", "who"),
        "partners",
    )


def candidates(classes: DataFrame, bands: Bands, all_shingles: int) -> DataFrame | None:
    """Pairs (node, other) of classes (node, text) that agree in a first part, and members (tok, node, n, size)
    of the parts that more than ``FEW`` classes hold.

    None if some set has too few parts that are not zero to be decided in these bands.
    """
    buckets = max(1, all_shingles // 500_000)
    found = (
        classes.mapInArrow(_sketched(bands, buckets), _SKETCHED)
        .groupBy("bucket").applyInArrow(_counted(buckets), _COUNTED)
        .groupBy("dest").applyInArrow(_first, _FIRST)
        .groupBy("bucket").applyInArrow(_found(FEW, bands.num, bands.den), _FOUND)
    )
    found = written(found, "found")
    return found if found.where("node IS NULL").isEmpty() else None


def _near(x: Column, y: Column, num: int, den: int) -> Column:
    return (F.least(x, y) < 0) | (F.least(x, y) * den >= F.greatest(x, y) * num)


def _pairs_with_pivots(crowded: DataFrame, seeds: list[int], num: int, den: int) -> DataFrame:
    """Each member with the pivots of its part: the one with the least excess, and for each seed one by hash, so
    the same classes are pivots of all parts that hold them."""
    one = F.struct("node", "n", "root", "e")
    best = [F.min_by(one, F.struct("e", "node")).alias("p")] + [F.min_by(one, F.xxhash64("node", F.lit(s))).alias(f"p{s}") for s in seeds]
    pivots = crowded.groupBy("tok").agg(*best)
    pivots = pivots.select("tok", F.explode(F.array_distinct(F.array("p", *[f"p{s}" for s in seeds]))).alias("p"))
    pairs = crowded.join(written(pivots, "pivots"), "tok").where(
        (F.col("root") != F.col("p.root"))
        & (F.col("e") + F.col("p.e") <= 0)
        & _near(F.col("n"), F.col("p.n"), num, den)
    )
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b"))


def _bit_sketched(bands: Bands):
    kind = pa.struct([("bits", pa.binary()), ("coarse", pa.binary())])

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.to_pylist():
            own = S.shingles(raw)
            bits = S.bit_sketch(own, bands.bits(len(own)))
            out.append({"bits": bits, "coarse": S.folded(np.frombuffer(bits, np.uint64), COARSE).tobytes()})
        return pa.array(out, kind)

    return F.arrow_udf(run, "bits binary, coarse binary")


def _sketches(texts: DataFrame, bands: Bands) -> DataFrame:
    """(node, size, bits, coarse) of each class; one with several texts has none, and no pair of it is ruled out."""
    said = F.arrow_udf(_sets, "n long, a long, b long")
    own = texts.select("node", said("text")["n"].alias("size"), _bit_sketched(bands)("text").alias("s")).select("node", "size", "s.*")
    known = {c: F.when(F.count("*") == 1, F.max(c)).alias(c) for c in ("size", "bits", "coarse")}
    return written(own.groupBy("node").agg(*known.values()), "sketches")


def _near_enough(bands: Bands):
    def run(x: pa.Array, y: pa.Array, sizes: pa.Array) -> pa.Array:
        rows = zip(x.to_pylist(), y.to_pylist(), sizes.to_pylist(), strict=True)
        return pa.array([n is None or S.distance(a, b) <= bands.apart(n) for a, b, n in rows], pa.bool_())

    return F.arrow_udf(run, "boolean")


def _may_link(pairs: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """The distinct pairs (a, b) that their parity bits do not rule out."""
    left = sketches.select(F.col("node").alias("a"), F.col("size").alias("n"), F.col("bits").alias("x"))
    right = sketches.select(F.col("node").alias("b"), F.col("size").alias("m"), F.col("bits").alias("y"))
    both = pairs.distinct().join(left, "a").join(right, "b")
    return both.where(_near_enough(bands)("x", "y", F.col("n") + F.col("m"))).select("a", "b")


def _cross(bands: Bands):
    """Pairs of one part and two sides of it that may link, from different components.

    A pair is looked at by a few parity bits, then by more; all of them are compared afterwards.
    """

    def run(table: pa.Table) -> pa.Table:
        node, n, root, e, side = (table[c].to_numpy() for c in ("node", "n", "root", "e", "left"))
        raw = table["coarse"].to_pylist()
        known = np.array([x is not None for x in raw])
        bits = np.frombuffer(b"".join(x or bytes(8 * COARSE) for x in raw), np.uint64).reshape(len(raw), COARSE)
        first = np.stack([S.folded(x, FIRST) for x in bits]) if len(raw) else np.zeros((0, FIRST), np.uint64)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(one) or not len(two):  # a side with itself
            one = two = np.arange(len(node))
        out = [np.zeros((2, 0), np.int64)]
        for i in one:
            j = two[(root[two] != root[i]) & (node[two] != node[i]) & (e[two] + e[i] <= 0)]
            j = j[_close(n[j], n[i], bands.num, bands.den)]
            for words in (first, bits):
                apart = np.bitwise_count(words[j] ^ words[i]).sum(axis=1, dtype=np.int64)
                most = (n[j] + n[i]) * (bands.den - bands.num) // (bands.den + bands.num)
                j = j[~(known[j] & known[i]) | (apart <= most)]
            out.append(np.stack([np.minimum(node[j], node[i]), np.maximum(node[j], node[i])]))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": _long(pairs[0]), "b": _long(pairs[1])})

    return run


def _pairs_across(crowded: DataFrame, sketches: DataFrame, bands: Bands) -> DataFrame:
    """All pairs from different components of a part that may link, in blocks of two sides of bounded size."""
    crowded = crowded.join(sketches.select("node", "coarse"), "node")
    sides = F.ceil(F.col("size") / SIDE).cast("long")
    own = crowded.withColumn("sides", sides).withColumn("side", F.pmod(F.xxhash64("node"), F.col("sides")))
    dealt = own.withColumn("other", F.explode(F.expr("sequence(0L, sides - 1)"))).select(
        "tok", F.least("side", "other").alias("x"), F.greatest("side", "other").alias("y"),
        (F.col("side") <= F.col("other")).alias("left"), "node", "n", "root", "e", "coarse",
    )
    return dealt.groupBy("tok", "x", "y").applyInArrow(_cross(bands), "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, num: int, den: int) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    out = joined.mapInArrow(_verified(num, den), "a long, b long, both long, together long, linked boolean")
    return written(out, "verified")


def _unsettled(members: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Members with the root of their component, of the parts that hold several components; None without any."""
    own = members.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    own = written(own, "rooted")
    mixed = own.groupBy("tok").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("tok")
    mixed = written(mixed, "mixed")
    return None if mixed.isEmpty() else written(own.join(mixed, "tok"), "crowded")


def roots_of(members: DataFrame, texts: DataFrame, tied: DataFrame | None, num: int, den: int) -> DataFrame:
    """(node, root) of all classes that are not roots; ``tied``: links that are known before."""
    bands = Bands(num, den, 1.0)
    sketches = _sketches(texts, bands)

    def linked(pairs: DataFrame) -> DataFrame:
        return _verify(_may_link(pairs, sketches, bands), texts, num, den).where("linked").select("a", "b")

    crowded = members.where("tok IS NOT NULL").select("tok", "node", "n", "size", F.col("node").alias("root"))
    crowded = with_excess(crowded, texts, bands)
    few = members.where("tok IS NULL").select(F.col("node").alias("a"), F.col("other").alias("b"))
    links = linked(few.union(_pairs_with_pivots(crowded, list(range(PIVOTS)), num, den)))
    roots = components(links if tied is None else links.union(tied))
    for step in range(ROUNDS + 1):
        crowded = _unsettled(crowded, roots)
        if crowded is None:
            break
        if step < ROUNDS:
            pairs = _pairs_with_pivots(crowded, [PIVOTS + step], num, den)
        else:  # what pivots have not connected is compared as it is
            pairs = _pairs_across(crowded, sketches, bands)
        roots = extended(roots, linked(pairs))
    return roots


def _documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, text); a document without an id is known by its text."""
    value = F.col(text).cast("string")
    by_text = F.xxhash64(value).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), by_text).alias("doc"), utf8(value).alias("text"))


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", num: int = 75, den: int = 100, spread: float = 2.8,
    fine: int = FINE,
) -> DataFrame:
    """One row per document: ``doc``, ``n_shingles`` and ``component_id``, the smallest id that links lead to.

    Words stand between blanks, A-Z lower-cased; a set holds the distinct runs of five words, with fewer
    words all of them as one. Two documents link when den * intersection >= num * union. A document
    without words (null, empty) is linked with nothing and has its own id. Rows that share an id are one
    document: what one of them links with, all do. A row without an id is known by its text: ``doc`` is then
    a number from ``UNNAMED`` on, as is the ``component_id`` of a group without any id. Every row of the
    input gives a row, an empty table none; extra columns take no part. ``spread`` (shingles per part of
    the sketch) and ``fine`` (sets below this size are not folded) change the work, not the result.
    """
    base = _documents(docs, doc_id, text)
    said = F.arrow_udf(_sets, "n long, a long, b long")
    sets = written(base.select("doc", said("text").alias("s")).select("doc", "s.*"), "sets")
    classes = written(sets.where("n > 0").groupBy("n", "a", "b").agg(F.min("doc").alias("node")), "classes")
    own = written(sets.join(classes, ["n", "a", "b"], "left").select("doc", "n", "node"), "own")
    # texts of the classes: documents that only repeat the set of another are left out
    copies = own.where("n > 0").select("doc").join(classes.select(F.col("node").alias("doc")), "doc", "left_anti").distinct()
    first = base.join(written(copies, "copies"), "doc", "left_anti").select(F.col("doc").alias("node"), "text")
    total = classes.agg(F.sum("n")).first()[0] or 0
    members = None
    while members is None:
        members = candidates(first, Bands(num, den, spread, fine), total)
        spread /= 2
    wanted = members.select("node").union(members.select("other").where("other IS NOT NULL")).distinct()
    texts = written(first.join(written(wanted, "wanted"), "node", "left_semi"), "texts")
    # an id with several texts ties their classes
    several = own.where("n > 0").groupBy("doc").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y")
    several, tied = written(several.select("doc"), "several"), None
    if not several.isEmpty():
        ends = own.where("n > 0").join(several, "doc")
        tied = ends.select(F.least("doc", "node").alias("a"), F.greatest("doc", "node").alias("b")).where("a < b")
    roots = roots_of(members, texts, tied, num, den)
    found = own.join(roots.select(F.col("node"), "root"), "node", "left")
    return found.select("doc", F.col("n").alias("n_shingles"), F.coalesce("root", "node", "doc").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that stand for their group: one per component, with all its columns.

    Of several rows under one id that stays, the one with the least text stays (any of equal ones).
    """
    groups = written(near_duplicates(docs, doc_id, text, **options), "groups")
    gone = groups.where("component_id <> doc").select("doc").distinct()
    again = groups.groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc")
    value = F.col(text).cast("string")
    by_text = F.xxhash64(value).bitwiseAND(F.lit(UNNAMED - 1)).bitwiseOR(F.lit(UNNAMED))
    base = packed(docs, doc=F.coalesce(F.col(doc_id).cast("long"), by_text), text=value)
    kept = base.join(written(gone, "gone"), "doc", "left_anti")
    again = written(again, "again")
    single = kept.join(again, "doc", "left_anti").select("_row")
    repeated = kept.join(again, "doc", "left_semi").groupBy("doc").agg(F.min_by("_row", F.coalesce("text", F.lit(""))).alias("_row"))
    return unpacked(single.union(repeated.select("_row")))
