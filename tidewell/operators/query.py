"""Queries over records: ranges, series, metrics, prices, activity, stored files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import schema
from tidewell.functions.tokens import byte_size, parse_any
from tidewell.operators.resample import with_direction

# Metrics preferred for a plot.
PREFERRED_METRICS = ["close", "value", "temperature", "price"]


def series_range(
    df: DataFrame,
    series_id: str,
    start=None,
    end=None,
    limit: int | None = None,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Rows of one series, both ends inclusive, oldest first; ``limit`` of them if given, otherwise all."""
    if not series_id:
        raise ValueError("series_id is required")
    rows = df.where(F.col("series_id") == series_id)
    if start is not None:
        rows = rows.where(F.col("timestamp") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("timestamp") <= F.lit(end).cast("timestamp"))
    rows = rows.orderBy("timestamp", *ties)
    return rows if limit is None else rows.limit(limit)


def half_open_range(df: DataFrame, start, end) -> DataFrame:
    t = F.col("timestamp")
    return df.where((t >= F.lit(start).cast("timestamp")) & (t < F.lit(end).cast("timestamp")))


def latest(df: DataFrame, n: int = 10, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc("timestamp"), *[F.desc(t) for t in ties]).limit(n)


def tenant_rows(df: DataFrame, user, column: str = "user_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(user))


#: a store may keep the number of a metric beside the map, in a column of this prefix
PROMOTED = "__metric_"


def from_map(name: str, df: DataFrame | None = None) -> Column:
    """The number of a metric in the map, or the column in which the store keeps it, where filters are pushed down."""
    if df is not None and f"{PROMOTED}{name}" in df.columns:
        return F.col(f"`{PROMOTED}{name}`")
    return F.col("measurements")[name]["num"]


def metric(name: str, df: DataFrame | None = None) -> Column:
    """The metric from the map; from a column of that name when there is no map entry."""
    if df is not None and name in df.columns:
        return F.when(F.col("measurements").isNotNull(), from_map(name, df)).otherwise(F.col(name).cast("double"))
    return from_map(name, df)


def measurement_above(df: DataFrame, name: str, bound: float) -> DataFrame:
    return df.where(from_map(name, df) > bound)


def metric_values(df: DataFrame, name: str) -> DataFrame:
    projected = df.select("series_id", "timestamp", metric(name, df).alias("value"))
    return projected.where(F.col("value").isNotNull())


def real_timestamps(df: DataFrame) -> DataFrame:
    """Drop synthetic ``row_<n>`` times and times that cannot be read."""
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        df = df.where(~F.col("timestamp").rlike(r"^row_\d+$"))
        df = df.withColumn("timestamp", parse_any(F.col("timestamp")))
    return df.where(F.col("timestamp").isNotNull())


def available_series(df: DataFrame) -> DataFrame:
    return df.select("series_id").distinct().orderBy("series_id")


def available_metrics(df: DataFrame) -> DataFrame:
    """(series_id, metric): map keys and price columns that hold a value."""
    present = [
        F.when(F.col(c).isNotNull(), F.lit(c)) for c in schema.PRICE_FIELDS if c in df.columns
    ]
    keys = F.coalesce(F.map_keys("measurements"), F.array().cast("array<string>"))
    if present:
        keys = F.concat(keys, F.array_compact(F.array(*present)))
    return df.select("series_id", F.explode(keys).alias("metric")).distinct()


def is_financial(df: DataFrame) -> DataFrame:
    """Per series: are open, high, low and close there, as columns or in some map."""
    if all(c in df.columns for c in schema.OHLC):
        return df.select("series_id").distinct().withColumn("is_financial", F.lit(True))
    in_map = F.lit(True)
    for c in schema.OHLC:
        in_map = in_map & F.map_contains_key("measurements", c)
    return df.groupBy("series_id").agg(F.bool_or(F.coalesce(in_map, F.lit(False))).alias("is_financial"))


def default_metric(df: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Per series: the first preferred metric that occurs, else the first key of the first record."""
    has = [
        F.bool_or(F.map_contains_key("measurements", m)).alias(f"has_{m}") for m in PREFERRED_METRICS
    ]
    order = F.struct("timestamp", *ties)
    first_key = F.get(F.map_keys("measurements"), F.lit(0))
    seen = df.groupBy("series_id").agg(*has, F.min_by(first_key, order).alias("first_key"))
    chosen = F.coalesce(
        *[F.when(F.col(f"has_{m}"), F.lit(m)) for m in PREFERRED_METRICS], F.col("first_key")
    )
    return seen.select("series_id", chosen.alias("metric"))


def ohlcv(df: DataFrame, sort: bool = True) -> DataFrame:
    """Open, high, low, close and volume from columns or map; rows lacking a price are dropped."""
    if all(c in df.columns for c in schema.OHLC):
        prices = {c: F.col(c).cast("double") for c in schema.OHLC}
        spellings = [F.col(c).cast("double") for c in ("vol", "volume") if c in df.columns]
    else:
        prices = {c: from_map(c, df) for c in schema.OHLC}
        spellings = [from_map("vol", df), from_map("volume", df)]
    # a zero volume counts as absent, so the next spelling is tried
    volume = F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in spellings], F.lit(0.0))
    rows = df.select(
        "series_id", "timestamp", *[p.alias(c) for c, p in prices.items()], volume.alias("volume")
    ).dropna(subset=schema.OHLC)
    rows = with_direction(rows)
    return rows.orderBy("timestamp") if sort else rows


def hourly_activity(df: DataFrame, sort: bool = True) -> DataFrame:
    hours = df.groupBy(F.date_trunc("hour", "timestamp").alias("hour")).agg(
        F.count("*").alias("records"), F.countDistinct("series_id").alias("series")
    )
    return hours.orderBy(F.desc("hour")) if sort else hours


def preview(df: DataFrame, rows: int = 200, columns: int = 10) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns[:columns]]).limit(rows)


def file_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(key, type, size_bytes, size, modified) of the files below ``path``; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.when(F.instr(name, ".") > 0, F.upper(F.element_at(F.split(name, r"\."), -1)))
    return files.select(
        F.col("path").alias("key"),
        F.coalesce(extension, F.lit("DATA")).alias("type"),
        F.col("length").alias("size_bytes"),
        byte_size(F.col("length")).alias("size"),
        F.col("modificationTime").alias("modified"),
    )


def search_files(
    inventory: DataFrame, text: str = "", extension: str | None = None, series: str = "", limit: int | None = None
) -> DataFrame:
    """Case-insensitive substring search over keys, by key; the first ``limit`` matches if given."""
    key = F.lower("key")
    rows = inventory
    if text:
        rows = rows.where(F.contains(key, F.lit(text.lower())))
    if series:
        rows = rows.where(F.contains(key, F.lit(series.lower())))
    if extension and extension != "All":
        rows = rows.where(F.endswith(key, F.lit(f".{extension.lower()}")))
    rows = rows.orderBy("key")
    return rows if limit is None else rows.limit(limit)
