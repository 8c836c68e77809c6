"""Readers for the text protocols of time-series databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import bound, iso_text, once

SOURCE = "source_file"

# possessive repetition runs as a loop: a plain one recurses for every character of a long field
# and takes a run of plain characters at a time, a greedy one inside a text, which is the fastest loop
_TOKEN = r"(?:[^\\, =]++|\\.)++"
_QUOTED = r"\"[^\"\\]*(?:\\.[^\"\\]*)*+\""
_HEAD = r"^((?:[^\\ ]++|\\.)++) "
_LINE = rf"{_HEAD}((?:[^\" ]++|{_QUOTED})++)(?: (-?\d+))?$"
_FIELD = rf"({_TOKEN})=({_QUOTED}|[^,]+)"
_TAG = rf",({_TOKEN})=({_TOKEN})"


def _unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\([,= \"\\])", "$1")).otherwise(c)


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias(SOURCE))


def _source(df: DataFrame) -> list[str]:
    return [c for c in (SOURCE,) if c in df.columns]


def _canonical(rows: DataFrame, series: Column, at: Column, measurements: Column, metadata: Column, fmt: str):
    return rows.select(
        *_source(rows),
        "error",
        series.alias("series_id"),
        at.alias("timestamp"),
        iso_text(at).alias("timestamp_raw"),
        measurements.alias("measurements"),
        metadata.alias("metadata"),
        F.lit(fmt).alias("format"),
    )


def line_protocol_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """``series[,tag=v] field=v[,field=v] [nanoseconds]``; a ``series_id`` tag names the series."""
    line = F.col(column)
    given = lines.where((F.length(F.trim(line)) > 0) & ~line.startswith("#")).select(*_source(lines), line.alias("line"))
    # the whole line is matched once; a match has fields, stands behind the head and leaves the time
    matched = once(given, {"fields": F.regexp_extract("line", _LINE, 2)})
    headed = once(matched, {"head": F.when(F.col("fields") != "", F.regexp_extract("line", _HEAD, 1)).otherwise("")})
    rest = F.substr("line", F.length("head") + F.length("fields") + 2)
    rows = headed.select(
        *_source(lines),
        "head",
        "fields",
        F.when(F.col("fields") != "", F.regexp_extract(rest, r"^ (-?\d+)", 1)).otherwise("").try_cast("bigint").alias("ns"),
        F.when(F.col("fields") == "", F.lit("Not a line protocol line")).alias("error"),
    )

    def value(token: Column) -> Column:
        text = token.startswith('"')
        flag = F.when(token.isin("true", "t", "T", "True", "TRUE"), F.lit(1.0)).when(
            token.isin("false", "f", "F", "False", "FALSE"), F.lit(0.0)
        )
        bare = F.regexp_replace(token, "i$", "")
        inner = bound(F.substring(token, F.lit(2), F.length(token) - 2), _unescape)
        num = F.when(~text, F.coalesce(flag, bare.try_cast("double")))
        return F.struct(num.alias("num"), F.when(text, inner).otherwise(bare).alias("raw"))

    def entry(pair: Column) -> Column:
        key = F.regexp_extract(pair, f"^{_TOKEN}", 0)
        token = F.substring(pair, F.length(key) + 2, F.length(pair))
        return F.struct(_unescape(key).alias("key"), bound(token, value).alias("value"))

    measurements = F.map_from_entries(F.transform(_group(F.col("fields"), _FIELD, 0), entry))
    tags = F.map_from_arrays(
        F.transform(_group(F.col("head"), _TAG, 1), _unescape),
        F.transform(_group(F.col("head"), _TAG, 2), _unescape),
    )
    name = _unescape(F.regexp_extract("head", r"^((?:[^\\,]++|\\.)++)", 1))
    series = F.coalesce(F.element_at(tags, "series_id"), name)
    metadata = F.map_filter(tags, lambda k, _: k != "series_id")
    # integer division: a double cannot hold nanoseconds since 1970
    at = F.timestamp_micros(F.expr("(ns - pmod(ns, 1000)) div 1000"))
    read = {"__series": series, "__at": at, "__measurements": measurements, "__metadata": metadata}
    done = once(rows, read)
    return _canonical(done, *[F.col(c) for c in read], "influxdb")


def opentsdb_records(lines: DataFrame, column: str = "value") -> DataFrame:
    """``put metric time value [tag=v ...]``; the last part of the metric is the measurement."""
    line = F.trim(F.col(column))
    p = F.split(line, r"\s+")
    rows = lines.where(F.length(line) > 0).select(
        *_source(lines),
        p.alias("p"),
        F.when(
            (F.get(p, F.lit(0)) != "put") | (F.size(p) < 4) | F.get(p, F.lit(3)).try_cast("double").isNull(),
            F.lit("Not a put line"),
        ).alias("error"),
    )
    pairs = F.filter(F.slice("p", 5, F.greatest(F.size("p") - 4, F.lit(0))), lambda t: F.contains(t, F.lit("=")))
    tags = F.map_from_arrays(
        F.transform(pairs, lambda t: F.split_part(t, F.lit("="), F.lit(1))),
        F.transform(pairs, lambda t: F.regexp_replace(t, "^[^=]*=", "")),
    )
    metric = F.get("p", F.lit(1))
    named = F.regexp_extract(metric, r"^(.*)\.([^.]+)$", 1)
    key = F.regexp_extract(metric, r"^(.*)\.([^.]+)$", 2)
    token = F.get("p", F.lit(3))
    # text is sent as a tag of the measurement's own name, next to the value 0
    text = F.element_at(tags, key)
    value = F.when(text.isNotNull(), schema.text_value(text)).otherwise(
        F.struct(token.try_cast("double").alias("num"), token.alias("raw"))
    )
    measurements = F.when(key != "", F.map_from_arrays(F.array(key), F.array(value))).otherwise(
        F.map_from_arrays(F.array(F.lit("value")), F.array(value))
    )
    series = F.coalesce(F.element_at(tags, "series_id"), F.when(key != "", named).otherwise(metric))
    metadata = F.map_filter(tags, lambda k, _: (k != "series_id") & (k != key))
    at = F.timestamp_seconds(F.get("p", F.lit(2)).try_cast("bigint"))
    return _canonical(rows, series, at, measurements, metadata, "opentsdb")


_SERIES = (
    "labels array<struct<name:string,value:string>>, "
    "samples array<struct<value:double,timestamp:bigint>>"
)
_SERIES_STRUCT = _SERIES.replace("labels ", "labels:").replace("samples ", "samples:").replace(", ", ",")


def prometheus_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON with labels and millisecond samples: one series per line, or a ``timeseries`` list."""
    read = spark.read.schema(f"timeseries array<struct<{_SERIES_STRUCT}>>, {_SERIES}").json(path)
    read = read.select("*", F.col("_metadata.file_path").alias(SOURCE))
    one = F.array(F.struct("labels", "samples"))
    series = read.select(SOURCE, F.explode(F.coalesce("timeseries", one)).alias("s"))
    rows = series.select(
        SOURCE, F.map_from_entries(F.col("s.labels")).alias("tags"), F.explode("s.samples").alias("x")
    ).withColumn("error", F.lit(None).cast("string"))
    name = F.element_at("tags", "__name__")
    sid = F.coalesce(F.element_at("tags", "series_id"), name)
    key = F.when(name.startswith(F.concat(sid, F.lit("_"))), F.substring(name, F.length(sid) + 2, F.length(name))).otherwise("value")
    value = F.struct(F.col("x.value").alias("num"), F.col("x.value").cast("string").alias("raw"))
    metadata = F.map_filter("tags", lambda k, _: ~k.isin("__name__", "series_id"))
    at = F.timestamp_millis("x.timestamp")
    return _canonical(
        rows, sid, at, F.map_from_arrays(F.array(key), F.array(value)), metadata, "prometheus"
    )


def read_line_protocol(spark: SparkSession, path: str) -> DataFrame:
    return line_protocol_records(_lines(spark, path))


def read_opentsdb(spark: SparkSession, path: str) -> DataFrame:
    return opentsdb_records(_lines(spark, path))
