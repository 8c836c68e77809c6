"""Lines that several documents share are kept in the first of these documents only.

Lines are exploded, normalised and hashed; documents are counted per hash; the hashes to drop go back
to their documents, where the remaining lines are joined by position.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import NAMELESS, packed, unpacked, utf8
from tidewell.session import written

BLANKS = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_points: int) -> bytes | None:
    """Hash of the normalised line; None if it has too few code points to count."""
    line = line.strip(BLANKS).lower()  # bytes.lower: A-Z only
    if len(line) < min_points or len(line.decode("utf-8", "replace")) < min_points:
        return None
    return hashlib.md5(line, usedforsecurity=False).digest()


def _hashed(min_points: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {
                (key, doc)
                for doc, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True)
                for line in (text or b"").split(b"\n")
                if (key := line_key(line, min_points)) is not None
            }
            keys, docs = zip(*seen, strict=True) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], ["key", "doc"])

    return run


def _kept(min_points: int):
    kind = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])

    def run(text: pa.Array, drops: pa.Array) -> pa.Array:
        out = []
        for raw, keys in zip(text.to_pylist(), drops.to_pylist(), strict=True):
            lines = (raw or b"").split(b"\n")
            gone = set(keys or ())
            kept = [x for x in lines if not gone or line_key(x, min_points) not in gone]
            out.append(
                {"n_lines": len(lines), "n_dropped": len(lines) - len(kept), "text": b"\n".join(kept).decode("utf-8", "replace")}
            )
        return pa.array(out, kind)

    return F.arrow_udf(run, "n_lines long, n_dropped long, text string")


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = 10, min_docs: int = 2
) -> DataFrame:
    """The documents with the repeated lines taken out, and ``n_lines`` (before) and ``n_dropped``.

    A line counts if its key (stripped, A-Z lower-cased) has ``min_points`` code points. A key held by
    ``min_docs`` documents loses its lines everywhere but in the smallest id that holds it; there every
    occurrence stays. Null and empty texts are one empty line, and a null text comes back empty. Rows
    with the same id are one document when keys are counted, and each gives its own row; rows without an
    id are one document that comes last. Extra columns pass through. An empty table gives no rows.
    """
    base = packed(docs, doc=F.coalesce(F.col(doc_id).cast("long"), F.lit(NAMELESS)), text=utf8(F.col(text)))
    lines = written(base.select("doc", "text").mapInArrow(_hashed(min_points), "key binary, doc long"), "lines")
    counts = lines.groupBy("key").agg(F.min("doc").alias("first"), F.count_distinct("doc").alias("docs"))
    shared = written(counts.where(F.col("docs") >= min_docs).select("key", "first"), "shared")
    drops = (
        lines.join(shared, "key")
        .where("doc > first")
        .groupBy("doc")
        .agg(F.collect_set("key").alias("drops"))
        .withColumnRenamed("doc", "drop_doc")
    )
    out = base.join(drops, F.col("doc") == F.col("drop_doc"), "left").withColumn(
        "kept", _kept(min_points)("text", "drops")
    )
    return unpacked(
        out,
        **{text: F.col("kept.text")},
        n_lines=F.col("kept.n_lines"),
        n_dropped=F.col("kept.n_dropped"),
    )
