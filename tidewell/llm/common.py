"""What the operators share: row packing against clashing names, byte-level text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.session import tune, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows without an id count as one nameless document that comes after all others
NAMELESS = 9223372036854775807
#: UTF-8 bytes, A-Z lower-cased and everything that is no word byte made a blank: ``.split()`` gives the words
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library; Arrow batches small enough for very long texts."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """Every input column inside ``_row``, next to the named ones: no name of the input can clash."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("_row"), *[c.alias(n) for n, c in columns.items()])


def unpacked(df: DataFrame, **columns: Column) -> DataFrame:
    """The input columns again, followed by the given ones; a given one replaces an input column of its name."""
    own = df.schema["_row"].dataType.names
    new = {n.lower() for n in columns}
    kept = [
        (columns.get(n, columns.get(n.lower())) if n.lower() in new else F.col("_row").getField(n)).alias(n) for n in own
    ]
    have = {n.lower() for n in own}
    return df.select(*kept, *[c.alias(n) for n, c in columns.items() if n.lower() not in have])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def utf8(c: Column) -> Column:
    return c.cast("string").cast("binary")


def numbered(df: DataFrame, group: str, order: list[str], name: str = "position") -> DataFrame:
    """``name``: the place (from 0) of each row in its group, by ``order`` with nulls first.

    Rows are cut into ranges of (group, order), so a large group lies in many tasks; what a group has in the
    ranges before is a sum over a row for each range and group.
    """
    sort = [F.asc_nulls_first(c) for c in (group, *order)]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_seq", F.monotonically_increasing_id())
    placed = written(placed, "in_order").withColumn("_range", F.shiftright("_seq", 33))
    own = placed.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_own")).agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_low"))
    starts = written(starts.select("_group", "_own", "_start"), "range_starts")
    joined = placed.join(starts, (F.col("_range") == F.col("_own")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_seq") + F.col("_start")).drop("_seq", "_range", "_group", "_own", "_start")
