"""Shards of bounded bytes by extendible hashing.

The directory is indexed by the leading bits of a row's hash. Only a bucket above the limit splits on its
next bit. The first look takes enough bits for the mean bucket; what is still too large is looked at with
more bits, without touching the rest again.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import packed, unpacked, utf8
from tidewell.session import written

BITS = 60


def _prefix(depth: int) -> Column:
    """The first ``depth`` bits of the hash, as a number."""
    return F.shiftright("hash", BITS - depth)


def _lookup(rows: DataFrame, low: int, high: int, max_bytes: int) -> DataFrame:
    """For each ``high``-bit cell its bucket: depth, bytes, rows. A null depth: still too large at ``high`` bits."""
    cells = rows.groupBy(_prefix(high).alias("cell")).agg(
        F.sum("size").alias("size"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    cells = written(cells, "cells")
    level = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    levels = cells.select("*", level).withColumn("at", F.expr(f"shiftright(cell, {high} - depth)"))
    buckets = levels.groupBy("depth", "at").agg(
        F.sum("size").alias("shard_bytes"), F.sum("n").alias("shard_rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    # rows of one hash can't be told apart: they stay together
    buckets = written(buckets.withColumn("splits", (F.col("shard_bytes") > max_bytes) & (F.col("lo") < F.col("hi"))), "buckets")
    deepest = (
        levels.select("cell", "depth", "at")
        .join(buckets.where("splits").select("depth", "at"), ["depth", "at"])
        .groupBy("cell")
        .agg((F.max("depth") + 1).alias("depth"))
    )
    found = cells.select("cell").join(deepest, "cell", "left").withColumn("depth", F.coalesce("depth", F.lit(low)))
    found = found.withColumn("at", F.expr(f"CASE WHEN depth <= {high} THEN shiftright(cell, {high} - depth) END"))
    return found.where(f"depth <= {high}").join(buckets.drop("lo", "hi", "splits"), ["depth", "at"]).select(
        F.col("cell").alias(f"cell{high}"), "depth", "at", "shard_bytes", "shard_rows"
    )


def assign_shards(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = 64 << 20, bits_per_round: int = 4
) -> DataFrame:
    """The documents with ``shard`` (its leading hash bits as text, empty if all fit one), ``depth``,
    ``shard_bytes``, ``shard_rows`` and ``oversize``.

    The hash is the first 60 bits of the MD5 of id and text (null: empty). A shard holds at most
    ``max_bytes`` of UTF-8 text. Repeated rows of one document, which no bit of the hash tells apart, take the
    number of their share of the copies as further bits, in any order. Only a document that is larger by itself
    is a shard that holds more, and is marked ``oversize``. Extra columns pass through; an empty table gives
    no rows.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("\n"), value)
    base = packed(docs, hash=F.conv(F.substring(F.md5(utf8(key)), 1, 15), 16, 10).cast("long"), size=F.octet_length(value))
    rows = written(base.select("hash", F.col("size").cast("long").alias("size")), "hashes")
    rows = rows.select("hash", "size", F.lit(1).cast("long").alias("n"), F.col("hash").alias("lo"), F.col("hash").alias("hi"))
    total = rows.agg(F.sum("size")).first()[0] or 0

    low, high = 0, min(BITS, ceil(log2(max(total / max_bytes, 1))) + 3)
    copies = rows.groupBy("hash").agg(F.max("size").alias("size"), F.count("*").alias("copies"))
    heavy = written(copies.where((F.col("copies") > 1) & (F.col("size") * F.col("copies") > max_bytes)), "heavy")
    any_heavy = not heavy.isEmpty()
    out = base.drop("size")
    if any_heavy:
        out = out.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()})
    found: list[str] = []
    while True:
        table = written(_lookup(rows, low, high, max_bytes), "directory")
        cell = f"cell{high}"
        own = table.select(cell, F.struct("depth", "at", "shard_bytes", "shard_rows").alias(f"found{high}"))
        out = out.withColumn(cell, _prefix(high)).join(own, cell, "left").drop(cell)
        found.append(f"found{high}")
        rows = rows.withColumn(cell, _prefix(high)).join(own.select(cell), cell, "left_anti").drop(cell)
        if high == BITS or rows.isEmpty():
            break
        rows = written(rows, "unsettled")
        low, high = high + 1, min(BITS, high + bits_per_round)
    out = out.withColumn("found", F.coalesce(*found))
    bits = F.lpad(F.conv(F.col("found.at").cast("string"), 10, 2), F.col("found.depth"), F.lit("0"))
    out = out.select(
        "*",
        F.when(F.col("found.depth") == 0, F.lit("")).otherwise(bits).alias("bits"),
        F.col("found.depth").cast("int").alias("depth"),
        F.col("found.shard_bytes").alias("bytes"),
        F.col("found.shard_rows").alias("count"),
    ).drop(*found, "found")
    if any_heavy:
        dealt = _dealt_copies(out.join(heavy, "hash"), max_bytes)
        out = out.join(heavy.select("hash"), "hash", "left_anti").select(*dealt.columns).unionByName(dealt)
    return unpacked(
        out, shard=F.col("bits"), depth=F.col("depth"), shard_bytes=F.col("bytes"), shard_rows=F.col("count"),
        oversize=F.col("bytes") > max_bytes,
    )


def _dealt_copies(rows: DataFrame, max_bytes: int) -> DataFrame:
    """Copies of one row in shares that fit the limit. They are numbered within the part of the input they come from."""
    rows = written(rows, "copies")
    parts = rows.groupBy("hash", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(parts.select("hash", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")), "copy_starts")
    inside = F.row_number().over(Window.partitionBy("hash", "part").orderBy("row")) - 1
    placed = rows.withColumn("number", inside).join(starts, ["hash", "part"]).withColumn("number", F.col("number") + F.col("start"))
    share = F.greatest(F.expr(f"{max_bytes}L div greatest(size, 1)"), F.lit(1))
    shares = placed.withColumns({"share": F.expr("number") - F.expr("number") % share, "most": share})
    last = F.bin(F.expr("(copies - 1) div most"))
    held = F.least("most", F.col("copies") - F.col("share"))
    return shares.select(
        "_row",
        F.concat("bits", F.lpad(F.bin(F.expr("share div most")), F.length(last), F.lit("0"))).alias("bits"),
        (F.col("depth") + F.length(last)).alias("depth"),
        (held * F.col("size")).alias("bytes"),
        held.alias("count"),
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """One folder per shard, ``shard=b`` and its bits; a shard fits a task, and tasks follow the number of shards."""
    # the letter keeps readers from taking the bits for a number
    sharded = assign_shards(docs, **options).withColumn("shard", F.concat(F.lit("b"), "shard"))
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def shard_sql(max_bytes: int = 64 << 20) -> str:
    """The same in DuckDB's SQL over ``documents``, all depths of every document at once."""
    heavy = f"f.copies > 1 AND f.size * f.copies > {max_bytes}"
    return f"""
    WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS size,
                 CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 15)
                   AS BIGINT) AS hash FROM documents),
    c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, hash) - 1 AS copy, count(*) OVER (PARTITION BY hash) AS copies,
            greatest({max_bytes} // greatest(size, 1), 1) AS most FROM d),
    l AS (SELECT *, unnest(range(0, {BITS} + 1)) AS depth FROM c),
    p AS (SELECT *, CASE WHEN depth = 0 THEN 0 ELSE hash >> CAST({BITS} - depth AS INT) END AS at_bits FROM l),
    b AS (SELECT depth, at_bits, sum(size) AS bytes, count(*) AS n, min(hash) < max(hash) AS more FROM p GROUP BY ALL),
    f AS (SELECT p.doc_id, p.hash, p.size, p.copies, p.most, p.copy, coalesce(max(p.depth) FILTER (bytes > {max_bytes} AND more) + 1, 0) AS depth
          FROM p JOIN b ON p.depth = b.depth AND p.at_bits = b.at_bits GROUP BY ALL),
    s AS (SELECT f.doc_id, CASE WHEN f.depth = 0 THEN '' ELSE substr(lpad(bin(f.hash), {BITS}, '0'), 1, CAST(f.depth AS INT)) END
            || CASE WHEN {heavy} THEN lpad(bin(copy // most), CAST(length(bin((copies - 1) // most)) AS INT), '0') ELSE '' END AS shard,
          f.depth + CASE WHEN {heavy} THEN length(bin((copies - 1) // most)) ELSE 0 END AS depth,
          CASE WHEN {heavy} THEN least(most, copies - copy // most * most) ELSE b.n END AS n,
          CASE WHEN {heavy} THEN least(most, copies - copy // most * most) * f.size ELSE b.bytes END AS bytes
          FROM f JOIN b ON b.depth = f.depth AND b.at_bits = CASE WHEN f.depth = 0 THEN 0 ELSE f.hash >> CAST({BITS} - f.depth AS INT) END)
    SELECT doc_id, shard, CAST(depth AS INT) AS depth, CAST(bytes AS BIGINT) AS shard_bytes, CAST(n AS BIGINT) AS shard_rows,
      bytes > {max_bytes} AS oversize FROM s"""
