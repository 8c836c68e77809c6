"""Records as text lines and JSON rows of time-series databases.

Every function is a projection: one expression per record or exploded measurement, no
shuffle. Text lines come in a column ``value``, ready for ``write.text``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import two_decimals
from tidewell.operators.reshape import POINTS_PER_ROW, in_blocks, unpivot_long
from tidewell.operators.store import with_series_metadata
from tidewell.sources.stooq import STOOQ_COLUMNS

# Spellings of the price fields on export, tried in this order.
EXPORT_SPELLINGS = {
    "open": ["open", "OPEN", "o"],
    "high": ["high", "HIGH", "h"],
    "low": ["low", "LOW", "l"],
    "close": ["close", "CLOSE", "c"],
    "vol": ["vol", "VOL", "volume", "Volume"],
    "openint": ["openint", "OPENINT", "open_interest"],
}


def nanoseconds(ts: Column) -> Column:
    # whole microseconds times 1000, as integers: a float product would lose digits
    return F.unix_micros(ts) * F.lit(1000).cast("bigint")


def plain_number(x: Column) -> Column:
    """A double as text, without an exponent for whole numbers."""
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, F.concat(x.cast("bigint").cast("string"), F.lit(".0"))).otherwise(
        F.lower(x.cast("string"))
    )


def _escaped(c: Column, characters: str = ",= ") -> Column:
    return F.regexp_replace(c, f"([{characters}])", r"\\$1")


def _fields() -> Column:
    """``key=token`` pairs; text is quoted, numbers and booleans print their source token."""

    def pair(e: Column) -> Column:
        token = F.when(e["value"]["num"].isNotNull(), e["value"]["raw"]).otherwise(
            F.concat(F.lit('"'), F.regexp_replace(e["value"]["raw"], r'(["\\])', r"\\$1"), F.lit('"'))
        )
        return F.concat(_escaped(e["key"]), F.lit("="), token)

    given = F.filter(F.map_entries("measurements"), lambda e: e["value"]["raw"].isNotNull())
    return F.array_join(F.transform(given, pair), ",")


def _tags(metadata: Column, escape: bool) -> Column:
    pairs = F.filter(F.map_entries(metadata), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    clean = _escaped if escape else (lambda c: F.regexp_replace(c, r"\s+", "_"))
    return F.transform(pairs, lambda e: F.concat(clean(e["key"]), F.lit("="), clean(e["value"])))


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def line_protocol(df: DataFrame, measurement: str = "time_series") -> DataFrame:
    """``series field=v,field="text" nanoseconds``; the time is left out when unknown."""
    series = _escaped(F.coalesce("series_id", F.lit(measurement)), ", ")
    fields = F.nullif(F.coalesce(_fields(), F.lit("")), F.lit(""))
    return df.select(
        F.concat_ws(" ", series, fields, nanoseconds(F.col("timestamp")).cast("string")).alias("value")
    )


def questdb_lines(df: DataFrame, table: str = "time_series_data") -> DataFrame:
    """``table,series_id=...,tags fields nanoseconds``; rows without fields or time are dropped."""
    own = F.concat(F.lit("series_id="), _escaped(F.coalesce("series_id", F.lit(table))))
    tags = F.concat(F.array(own), F.coalesce(_tags(F.col("metadata"), True), _no_tags()))
    head = F.concat(F.lit(_escape_name(table)), F.lit(","), F.array_join(tags, ","))
    rows = df.where(F.col("timestamp").isNotNull() & (F.size("measurements") > 0))
    return rows.select(
        F.concat_ws(" ", head, _fields(), nanoseconds(F.col("timestamp")).cast("string")).alias("value")
    )


def _escape_name(name: str) -> str:
    return name.replace(",", "\\,").replace(" ", "\\ ")


def opentsdb_lines(df: DataFrame, metric_name: str | None = None) -> DataFrame:
    """One ``put metric.key seconds value tags`` line per measurement; text goes into a tag."""
    metric = F.lit(metric_name) if metric_name else F.coalesce("series_id", F.lit("metric"))
    metric = F.regexp_replace(metric, r"\s+", "_")
    tags = F.coalesce(_tags(F.col("metadata"), False), _no_tags())
    if metric_name:
        own = F.concat(F.lit("series_id="), F.regexp_replace("series_id", r"\s+", "_"))
        tags = F.concat(F.when(F.col("series_id") != metric_name, F.array(own)).otherwise(_no_tags()), tags)
    seconds = F.unix_seconds("timestamp").cast("string")
    timed = df.where(F.col("timestamp").isNotNull())
    long = timed.where(F.col("measurements").isNotNull()).select(
        metric.alias("metric"), seconds.alias("s"), tags.alias("tags"),
        F.explode("measurements").alias("key", "m"),
    )
    key = F.regexp_replace("key", r"\s+", "_")
    as_tag = F.concat(key, F.lit("="), F.regexp_replace("m.raw", r"\s+", "_"))
    text = F.col("m.num").isNull()
    lines = long.select(
        F.concat_ws(
            " ", F.lit("put"), F.concat("metric", F.lit("."), key), "s",
            F.when(text, F.lit("0")).otherwise(F.col("m.raw")), F.when(text, as_tag), "tags",
        ).alias("value")
    )
    bare = timed.where(F.col("measurements").isNull()).select(
        F.concat_ws(" ", F.lit("put"), metric, seconds, F.lit("0"), F.concat(F.lit("series_id="), "series_id")).alias("value")
    )
    return lines.unionByName(bare)


def _label_map(name: Column) -> Column:
    own = F.map_from_arrays(F.array(F.lit("__name__")), F.array(name))
    return F.map_concat(own, F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def prometheus_rows(df: DataFrame) -> DataFrame:
    """(labels, samples) per numeric measurement: one sample in milliseconds."""
    long = unpivot_long(df)
    name = F.concat_ws("_", "series_id", "measurement")

    def label(n: Column, v: Column) -> Column:
        return F.struct(n.alias("name"), v.alias("value"))

    own = F.array(label(F.lit("__name__"), name), label(F.lit("series_id"), F.col("series_id")))
    more = F.transform(F.map_entries("metadata"), lambda e: label(e["key"], e["value"]))
    sample = F.struct(F.col("value"), F.unix_millis("timestamp").alias("timestamp"))
    return long.select(
        F.when(more.isNull(), own).otherwise(F.concat(own, more)).alias("labels"),
        F.array(sample).alias("samples"),
    )


def token(v: Column) -> Column:
    """A measurement as a variant: the number or boolean as it was written, else the number, else the text."""
    written = F.when(v["num"].isNotNull(), F.try_parse_json(v["raw"]))
    return F.coalesce(written, v["num"].cast("variant"), v["raw"].cast("variant"))


def protobuf_rows(df: DataFrame) -> DataFrame:
    """(series_id, timestamp in nanoseconds or the raw text, fields, metadata)."""
    at = F.coalesce(
        nanoseconds(F.col("timestamp")).cast("variant"), F.col("timestamp_raw").cast("variant")
    )
    fields = F.transform_values("measurements", lambda _, v: token(v))
    return df.select("series_id", at.alias("timestamp"), fields.alias("fields"), "metadata")


def tsfile_rows(df: DataFrame) -> DataFrame:
    return unpivot_long(df).select(
        F.col("series_id").alias("device"), F.unix_millis("timestamp").alias("timestamp"),
        "measurement", "value",
    )


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def tdengine_lines(df: DataFrame, table: str = "time_series_data") -> DataFrame:
    at = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")
    return unpivot_long(df).select(
        F.concat(
            F.lit(f"INSERT INTO {table} USING {table}_tags TAGS ("), _quoted(F.col("measurement")),
            F.lit(") VALUES ("), _quoted(at), F.lit(", "), _quoted(F.col("series_id")), F.lit(", "),
            plain_number(F.col("value")), F.lit(");"),
        ).alias("value")
    )


def victoria_rows(
    df: DataFrame, block: str | None = "hour", points: int = POINTS_PER_ROW, bounds=None, order: Sequence[str] | None = None
) -> DataFrame:
    """(metric labels, values, timestamps): a row per series, measurement and time unit, of at most ``points`` points.

    All points of a series carry the metadata of its first record by ``order`` (time, then the metadata as
    text). Without a unit (None) each point is a row.
    """
    by = list(order) if order else [F.col("timestamp"), schema.canonical_text(F.col("metadata"))]
    long = with_series_metadata(unpivot_long(df), df, by)
    labels = _label_map(F.concat_ws("_", "series_id", "measurement"))
    if block is None:
        return long.select(
            labels.alias("metric"), F.array("value").alias("values"),
            F.array(F.unix_millis("timestamp")).alias("timestamps"),
        )
    point = F.struct(F.unix_millis("timestamp").alias("t"), F.col("value").alias("v"))
    keys = ["series_id", "measurement"]
    grouped = in_blocks(long, keys, block, points, bounds).groupBy(*keys, "block", "part").agg(
        F.array_sort(F.array_agg(point)).alias("p"), F.any_value("metadata").alias("metadata")
    )
    return grouped.select(
        labels.alias("metric"), F.col("p.v").alias("values"), F.col("p.t").alias("timestamps")
    )


def timescale_rows(df: DataFrame) -> DataFrame:
    """The narrow table (time, series_id, measurement_name, value, metadata)."""
    return unpivot_long(df).select(
        F.col("timestamp").alias("time"), "series_id", F.col("measurement").alias("measurement_name"),
        "value", F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"),
    )


def timescale_ddl(table: str = "time_series_data", hypertable: bool = True) -> list[str]:
    columns = "time TIMESTAMPTZ NOT NULL, series_id TEXT, measurement_name TEXT, value DOUBLE PRECISION, metadata JSONB"
    ddl = [f"CREATE TABLE IF NOT EXISTS {table} ({columns});"]
    if hypertable:
        ddl.append(f"SELECT create_hypertable('{table}', 'time', if_not_exists => TRUE);")
    ddl += [
        f"CREATE INDEX IF NOT EXISTS idx_{table}_{short} ON {table} ({column});"
        for short, column in (("series", "series_id"), ("measurement", "measurement_name"))
    ]
    return ddl


def timescale_lines(df: DataFrame, table: str = "time_series_data") -> DataFrame:
    """One INSERT per numeric measurement."""
    at = F.date_format("time", "yyyy-MM-dd HH:mm:ss")
    values = [
        _quoted(at), _quoted(F.col("series_id")), _quoted(F.col("measurement_name")),
        plain_number(F.col("value")), _quoted(F.col("metadata")),
    ]
    head = f"INSERT INTO {table} (time, series_id, measurement_name, value, metadata) VALUES ("
    return timescale_rows(df).select(F.concat(F.lit(head), F.concat_ws(", ", *values), F.lit(");")).alias("value"))


def _spelled(name: str) -> Column:
    """The first spelling that holds something; zero counts as absent."""
    tries = [F.col("measurements")[s] for s in EXPORT_SPELLINGS[name]]
    return F.coalesce(*[F.when(F.coalesce(t["num"], F.lit(1.0)) != 0, t) for t in tries])


def stooq_rows(df: DataFrame, default_ticker: str = "UNKNOWN", default_period: str = "D") -> DataFrame:
    """The ten text columns of a Stooq file; records without a readable time are left out."""

    def given(c: Column) -> Column:
        return F.nullif(c, F.lit(""))

    def price(v: Column) -> Column:
        return F.coalesce(two_decimals(v["num"]), v["raw"], F.lit(""))

    def amount(v: Column) -> Column:
        number = F.coalesce(v["num"], v["raw"].try_cast("double"))
        return F.coalesce(number.try_cast("bigint"), F.lit(0)).cast("string")

    metadata, period = F.col("metadata"), F.col("measurements")["period"]["raw"]
    # One expression over an array instead of six copies of it: the generated method of six
    # copies is too long for the JVM to compile, and runs several times slower.
    texts = F.transform(F.array(*[_spelled(n) for n in ("open", "high", "low", "close")]), price)
    counts = F.transform(F.array(_spelled("vol"), _spelled("openint")), amount)
    head = [
        F.coalesce(given(metadata["ticker"]), given(F.col("series_id")), F.lit(default_ticker)),
        F.coalesce(given(period), given(metadata["period"]), F.lit(default_period)),
        F.date_format("timestamp", "yyyyMMdd"),
        F.date_format("timestamp", "HHmmss"),
    ]
    rows = df.where(F.col("timestamp").isNotNull()).select(
        *[c.alias(n) for c, n in zip(head, STOOQ_COLUMNS)], texts.alias("texts"), counts.alias("counts")
    )
    cells = [F.get("texts", F.lit(i)) for i in range(4)] + [F.get("counts", F.lit(i)) for i in range(2)]
    return rows.select(*STOOQ_COLUMNS[:4], *[c.alias(n) for c, n in zip(cells, STOOQ_COLUMNS[4:])])
