"""Registered queries with the SQL that must give the same rows, and the table bindings."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schema, tune
from tidewell.functions.tokens import iso_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        @wraps(function)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Float results are compared after rounding; the nudge keeps ties from flipping."""
    c = F.col(c) if isinstance(c, str) else c
    scale = 10.0**digits
    return F.floor(c * scale + 0.50001) / scale


def r(expression: str, digits: int = 4) -> str:
    scale = f"1e{digits}"
    return f"(floor(({expression}) * {scale} + 0.50001) / {scale})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """The observation table: ``event_type`` is the series, ``ts`` the time, ``k`` a second number."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").withColumn("k", k).drop("props")


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    """Observations of a low ``k`` count as missing."""
    return events(spark, sf).withColumn("v", F.when(F.col("k") >= 15, F.col("value")))


EVENTS = (
    "ev AS (SELECT event_id, ts, user_id, event_type, value, "
    "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
)
GAPPY = EVENTS + ", g AS (SELECT *, CASE WHEN k >= 15 THEN value END AS v FROM ev)"


def _numbers(names: list[str]) -> Column:
    """The columns hold no nulls; looking up a key of ``create_map`` folds back to its column."""
    pairs = [x for n in names for x in (F.lit(n), schema.number_value(F.col(n)))]
    return F.create_map(*pairs)


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical records: measurements ``value`` and ``k``, the user as metadata."""
    e = events(spark, sf)
    return e.select(
        F.col("event_type").alias("series_id"),
        F.col("ts").alias("timestamp"),
        iso_text(F.col("ts")).alias("timestamp_raw"),
        _numbers(["value", "k"]).alias("measurements"),
        F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"),
        F.lit("events").alias("format"),
        "event_id",
    )


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """One price record per order: open, high, low, close and volume made of its numbers."""
    o = table(spark, sf, "orders")
    p = F.col("o_totalprice")
    return o.select(
        F.col("o_orderstatus").alias("ticker"),
        F.col("o_orderdate").alias("timestamp"),
        p.alias("open"),
        (p + 10).alias("high"),
        (p - 10).alias("low"),
        (p + F.col("o_custkey") % 7 - 3).alias("close"),
        F.col("o_custkey").alias("vol"),
        "o_orderkey",
    )


BARS = (
    "bars AS (SELECT o_orderstatus AS ticker, o_orderdate AS timestamp, o_totalprice AS open, "
    "o_totalprice + 10 AS high, o_totalprice - 10 AS low, o_totalprice + o_custkey % 7 - 3 AS close, "
    "o_custkey AS vol, o_orderkey FROM orders)"
)


def bar_records(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    names = ["open", "high", "low", "close", "vol"]
    return b.select(
        F.col("ticker").alias("series_id"),
        "timestamp",
        iso_text(F.col("timestamp")).alias("timestamp_raw"),
        _numbers(names).alias("measurements"),
        F.create_map(F.lit("ticker"), F.col("ticker")).alias("metadata"),
        F.lit("orders").alias("format"),
        "o_orderkey",
    )
