"""Documents packed into sequences of bounded length, by best fit under conflicts.

Documents are dealt by hash into groups of bounded size, which are packed on their own: longest first,
each into the tightest bin that holds nothing of the same source and duplicate cluster.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import packed, utf8
from tidewell.session import written

_KIND = pa.struct([("n", pa.int64()), ("cluster", pa.int64())])


def _measured(text: pa.Array) -> pa.Array:
    """Number of words, and a key that copies share: their words, A-Z lower-cased."""
    out = []
    for raw in text.to_pylist():
        words = (raw or b"").lower().split()
        digest = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
        out.append({"n": len(words), "cluster": int.from_bytes(digest[:8], "little", signed=True)})
    return pa.array(out, _KIND)


def best_fit(pieces: list[tuple[int, int, int]], capacity: int) -> list[int]:
    """The bin of each (length, source bitmap, cluster bitmap), given longest first.

    Open bins stand in order of what they have left. From the first that is large enough, its successors
    are tried until one shares neither source nor cluster: that is the tightest compatible bin.
    """
    order: list[tuple[int, int]] = []  # (left, bin)
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for length, source, cluster in pieces:
        i = bisect_left(order, (length, -1))
        while i < len(order) and (sources[order[i][1]] & source or clusters[order[i][1]] & cluster):
            i += 1
        if i < len(order):
            left, own = order.pop(i)
        else:
            left, own = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[own] |= source
        clusters[own] |= cluster
        if left > length:
            insort(order, (left - length, own))
        out.append(own)
    return out


def _bits(values: list) -> list[int]:
    """A bit per distinct value; none for null, which conflicts with nothing."""
    known: dict = {}
    return [0 if v is None else 1 << known.setdefault(v, len(known)) for v in values]


def _pack_group(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(
            pdf.itertuples(index=False),
            key=lambda r: (-r.n, r.cluster, r.doc is None or pd.isna(r.doc), r.doc if not pd.isna(r.doc) else 0, r.copy),
        )
        sources = _bits([None if r.source is None or pd.isna(r.source) else r.source for r in rows])
        clusters = _bits([r.cluster for r in rows])
        bins = best_fit([(r.n, s, c) for r, s, c in zip(rows, sources, clusters, strict=True)], capacity)
        used: dict[int, int] = {}
        out = []
        for r, own in zip(rows, bins, strict=True):
            out.append((r.doc, r.copy, r.piece, f"{r.grp}-{own}", used.get(own, 0), r.n))
            used[own] = used.get(own, 0) + r.n
        frame = pd.DataFrame(out, columns=["doc", "copy", "piece", "bin", "start", "n_tokens"])
        return frame.astype({"doc": "Int64"})

    return run


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    capacity: int = 2048,
    rows_per_group: int = 1024,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``copy``, ``piece``, ``bin``, ``start`` in the bin, ``n_tokens``.

    A document is cut into pieces of ``capacity`` words; only the last may be shorter. Full pieces fill a
    bin of their own. No bin holds two pieces of one source or of one cluster of copies (equal words, A-Z
    lower-cased); a null source conflicts with no source. Pieces of equal length go in the order cluster,
    id, copy. A document without words has one piece of length 0 and a null bin. Repeated rows are counted
    and told apart by ``copy``; many copies spread over groups. ``rows_per_group`` is the mean size of a
    group: bins are tightest within it, and no task holds more than a few groups. Extra columns take no part.
    """
    base = packed(docs, doc=F.col(doc_id).cast("long"), source=F.col(source).cast("string"), text=utf8(F.col(text)))
    measure = F.arrow_udf(_measured, "n long, cluster long")
    base = base.withColumn("said", measure("text")).select("doc", "source", "said.n", "said.cluster")
    rows = written(base.groupBy("doc", "source", "n", "cluster").agg(F.count("*").alias("copies")), "measured")
    span = 64  # copies that stay together
    rows = rows.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {span})"))).withColumn(
        "copy", F.explode(F.expr(f"sequence(chunk * {span}, least(copies, (chunk + 1) * {span}) - 1)"))
    )
    full = (
        rows.where(F.col("n") >= capacity)
        .withColumn("piece", F.explode(F.expr(f"sequence(0L, n div {capacity} - 1)")))
        .select(
            "doc", "copy", "piece",
            F.concat_ws("-", F.lit("full"), F.coalesce(F.col("doc").cast("string"), F.lit("none")), F.hex("cluster"), "copy", "piece").alias("bin"),
            F.lit(0).cast("long").alias("start"),
            F.lit(capacity).cast("long").alias("n_tokens"),
        )
    )
    none = rows.where("n = 0").select(
        "doc", "copy", F.lit(0).cast("long").alias("piece"), F.lit(None).cast("string").alias("bin"),
        F.lit(None).cast("long").alias("start"), F.col("n").alias("n_tokens"),
    )
    groups = max(1, -(-(rows.agg(F.sum("copies")).first()[0] or 0) // rows_per_group))
    rest = rows.where(F.col("n") % capacity > 0).select(
        "doc", "source", "cluster", "copy",
        F.expr(f"n div {capacity}").alias("piece"),
        (F.col("n") % capacity).alias("n"),
        F.pmod(F.xxhash64("doc", "source", "cluster", "chunk"), F.lit(groups)).alias("grp"),
    )
    mixed = rest.groupBy("grp").applyInPandas(
        _pack_group(capacity), "doc long, copy long, piece long, bin string, start long, n_tokens long"
    )
    return mixed.unionByName(full).unionByName(none).withColumnRenamed("doc", doc_id)
