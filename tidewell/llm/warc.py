"""WARC archives: written as text with the record boundary as line separator, read by boundary chains.

The reader cuts the archives at the magic, in byte ranges. Each piece is a candidate record with the
offset of its successor. A magic inside a payload makes candidates too, so only records that are reached
from the start of their file count; they are found by pointer jumping, first inside each byte range,
then over the ranges.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewell.llm.common import packed, utf8
from tidewell.session import written

# --- fixed values of the format ---
MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# --- end of fixed values ---


def _lines(*pairs: tuple[str, object]) -> F.Column:
    """``Name: value`` lines; a null value leaves its line out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{n}: "), v, F.lit("\r\n")), F.lit("")) for n, v in pairs])


def write_warc(
    pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000
) -> None:
    """One record per page below ``path``: a response, or a revisit of the page with the same payload.

    Among equal payloads of at least ``least`` bytes the largest page id is the response (each of its rows,
    if the page is repeated; every row, if no page of the group has an id), the others revisit it. A null
    payload is empty; a null url leaves out its line. Only payload digests are shuffled.
    """
    spark = pages.sparkSession
    base = packed(
        pages,
        page=F.col(page_id).cast("long"),
        url=F.regexp_replace(F.col(url).cast("string"), r"[\x00-\x20\x7F]", "%20"),
        html=F.coalesce(F.col(html).cast("string"), F.lit("")),
    ).select("page", "url", "html", F.octet_length("html").alias("size"), F.sha1(utf8(F.col("html"))).alias("digest"))
    held = base.where(F.col("size") >= least).groupBy("digest").agg(F.max("page").alias("response"), F.count("*").alias("n"))
    held = written(held.where("n > 1 AND response IS NOT NULL").select("digest", "response"), "payloads")
    each = base.join(held, "digest", "left").withColumn(
        "refers", F.when(F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response")), F.col("response"))
    )
    revisit = F.col("refers").isNotNull()
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"),
        F.lit(GAP),
    )
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    head = _lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.coalesce(urn(F.col("page")), F.lit("<urn:page:>"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Refers-To", urn(F.col("refers"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", F.octet_length("block").cast("string")),
    )
    records = each.withColumn("block", block).select(F.concat(F.lit(MAGIC), head, F.lit("\r\n"), F.col("block")).alias("value"))
    ready = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    records.write.option("lineSep", GAP).option("maxRecordsPerFile", ready if int(ready) > 0 else 1_000_000).text(path)


_FIELD = re.compile(rb"^([A-Za-z-]+): ?(.*?)\r?$", re.M)
_PAGE = re.compile(r"^<urn:page:(-?\d+)>$")


def _fields(head: bytes) -> dict[str, str]:
    return {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(head)}


def _page(urn: str | None) -> int | None:
    m = _PAGE.match(urn or "")
    return int(m[1]) if m else None


def parse_record(piece: bytes) -> dict:
    """What a piece after a magic says if it is a record: bytes up to its successor, ids, and payload digest.

    ``need`` counts from the magic on and is null without a header. ``whole`` tells that the piece ends
    where the record ends; ``sha`` is the digest of the payload that the piece holds.
    """
    gap = GAP.encode()
    head, found, rest = piece.partition(gap)
    fields = _fields(head) if found else {}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 16 and "warc-type" in fields):
        return {"need": None}
    need = len(MAGIC) + len(head) + len(gap) + int(length) + len(gap)
    http, _, payload = rest[: int(length)].partition(gap)
    declared = _fields(http).get("content-length", "")
    return {
        "need": need,
        "whole": need == len(MAGIC) + len(piece),
        "page": _page(fields.get("warc-record-id")),
        "kind": fields["warc-type"],
        "refers": _page(fields.get("warc-refers-to")),
        "digest": fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "bytes": len(payload),
        "declared": int(declared) if declared.isascii() and declared.isdigit() else None,
        "sha": hashlib.sha1(payload, usedforsecurity=False).hexdigest(),
    }


_PIECE = "need long, whole boolean, page long, kind string, refers long, digest string, bytes long, declared long, sha string"
_KEYS = [x.split()[0] for x in _PIECE.split(", ")]
_ARROW = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]


def _cut(values: bool):
    """Pieces with their place in the byte range; with ``values`` the bytes themselves instead of what they say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rel = None, 0
        for batch in batches:
            files, blocks, pieces = (batch[n].to_pylist() for n in ("file", "block", "value"))
            rels, sizes = [], []
            for f, b, piece in zip(files, blocks, pieces, strict=True):
                if (f, b) != at:
                    at, rel = (f, b), 0
                rels.append(rel)
                sizes.append(len(piece) + len(MAGIC))
                rel += sizes[-1]
            place = [batch["file"], batch["block"], pa.array(rels, pa.int64())]
            if values:
                yield pa.RecordBatch.from_arrays([*place, batch["value"]], ["file", "block", "rel", "value"])
                continue
            said = [parse_record(p) for p in pieces]
            own = [pa.array([s.get(k) for s in said], t) for k, t in zip(_KEYS, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*place, pa.array(sizes, pa.int64()), *own], ["file", "block", "rel", "size", *_KEYS]
            )

    return run


def _pieces(spark: SparkSession, path: str, values: bool = False) -> DataFrame:
    text = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    text = text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("value"),
    )
    place = "file string, block long, rel long, "
    return text.mapInArrow(_cut(values), place + ("value binary" if values else "size long, " + _PIECE))


def exits(off: np.ndarray, after: np.ndarray) -> np.ndarray:
    """For each candidate of a byte range (ascending) the first offset on its chain that is no candidate here."""
    at = np.searchsorted(off, after)
    inside = (at < len(off)) & (off[np.minimum(at, len(off) - 1)] == after)
    jump = np.where(inside, at, np.arange(len(off)))  # the last of a chain points at itself
    while True:
        further = jump[jump]
        if (further == jump).all():
            return after[jump]
        jump = further


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("off")
    return pdf.assign(exit=exits(pdf["off"].to_numpy(), pdf["after"].to_numpy()))


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chains that start at the entries of a byte range."""
    pdf, wanted, keep = pdf.sort_values("off"), set(pdf.loc[pdf["entry"], "off"]), []
    for off, after in zip(pdf["off"], pdf["after"], strict=True):
        keep.append(off in wanted)
        if keep[-1]:
            wanted.add(after)
    return pdf.loc[keep, ["file", "off"]]


def _chained(candidates: DataFrame) -> DataFrame:
    """(file, off) of the candidates that the chain from the start of their file reaches."""
    spark = candidates.sparkSession
    slim = candidates.where("need IS NOT NULL").select("file", "block", "off", (F.col("off") + F.col("need")).alias("after"))
    nodes = written(
        slim.groupBy("file", "block").applyInPandas(_exits, "file string, block long, off long, after long, exit long"),
        "chains",
    )
    # entries: starts of files, and offsets where a chain leaves its byte range
    ends = nodes.select("file", F.col("exit").alias("off")).distinct()
    jumps = written(
        nodes.select("file", "off", "exit").join(ends, ["file", "off"], "left_semi").union(
            nodes.where("off = 0").select("file", "off", "exit")
        ).distinct(),
        "jumps",
    )
    reached = nodes.where("off = 0").select("file", "off")
    ranges = slim.groupBy("file").agg(F.count_distinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    for _ in range((ranges - 1).bit_length()):
        more = reached.join(jumps, ["file", "off"]).select("file", F.col("exit").alias("off"))
        reached = written(reached.union(more).distinct(), "reached")
        twice = jumps.select("file", "off", F.col("exit").alias("mid")).join(
            jumps.select("file", F.col("off").alias("mid"), "exit"), ["file", "mid"]
        )
        jumps = written(twice.select("file", "off", "exit"), "jumps")
    entries = nodes.join(reached.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn(
        "entry", F.coalesce("entry", F.lit(False))
    )
    return entries.select("file", "block", "off", "after", "entry").groupBy("file", "block").applyInPandas(
        _reached, "file string, off long"
    )


def covered(places: DataFrame, broken: DataFrame) -> DataFrame:
    """(file, block, rel, start, off) of the pieces that a broken record covers.

    Records do not overlap, so it is the last one that starts at the piece or before: in the same byte range, or else
    the last one of the ranges before.
    """
    record = F.when(F.col("need").isNotNull(), F.struct(F.col("off").alias("start"), "need"))
    upward = Window.partitionBy("file", "block").orderBy("off")
    marked = places.join(broken, ["file", "off"], "left").withColumn("here", F.last(record, ignorenulls=True).over(upward))
    marked = written(marked.drop("need"), "marked")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    tops = marked.groupBy("file", "block").agg(F.max("here").alias("top"))
    tops = tops.select("file", "block", F.max("top").over(before).alias("carried"))
    found = marked.join(tops, ["file", "block"]).withColumn("record", F.coalesce("here", "carried"))
    return found.where("off < record.start + record.need").select("file", "block", "rel", F.col("record.start").alias("start"), "off")


def _joined(spark: SparkSession, path: str, places: DataFrame, broken: DataFrame) -> DataFrame:
    """Records with a magic inside, put together again from the pieces they cover."""
    parts = written(covered(places, broken), "parts")
    values = _pieces(spark, path, values=True).join(parts, ["file", "block", "rel"])
    whole = values.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [parse_record(MAGIC.encode().join(p["value"] for p in x)) for x in batch["parts"].to_pylist()]
            own = [pa.array([s.get(k) for s in said], t) for k, t in zip(_KEYS, _ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(own, _KEYS)

    return whole.mapInArrow(run, _PIECE)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives below ``path``: page_id, record_type, refers_to, payload_bytes, payload_digest, intact.

    Bytes and digest of a response are those of the payload read; a revisit has those of the payload it
    refers to, from its HTTP header and its digest field. ``intact`` tells that the digest read is the one
    written. A file that does not start with a record gives none; a broken record ends the chain of its file.
    """
    pieces = written(_pieces(spark, path), "pieces")
    order = Window.partitionBy("file").orderBy("block")
    sizes = pieces.groupBy("file", "block").agg(F.sum("size").alias("total"))
    bases = sizes.select(
        "file", "block", (F.sum("total").over(order) - F.col("total") - F.lit(len(MAGIC))).alias("base")
    )
    placed = written(pieces.join(bases, ["file", "block"]).withColumn("off", F.col("base") + F.col("rel")), "placed")
    kept = placed.join(_chained(placed), ["file", "off"])
    kept = written(kept.select("file", "off", *_KEYS), "kept")
    records = kept.where("whole").select(*_KEYS)
    broken = kept.where("NOT whole").select("file", "off", "need")
    if not broken.isEmpty():
        records = records.union(_joined(spark, path, placed.select("file", "block", "rel", "off"), broken))
    revisit = F.col("kind") == "revisit"
    digest = F.when(revisit, F.col("digest")).otherwise(F.col("sha"))
    return records.select(
        F.col("page").alias("page_id"),
        F.when(revisit, F.col("declared")).otherwise(F.col("bytes")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("refers").alias("refers_to"),
        (digest == F.col("digest")).alias("intact"),
    )
