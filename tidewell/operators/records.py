"""Validating, converting and normalising records.

Sources deliver one of two shapes: JSON records as a VARIANT column ``record`` (any field
may have any type), or typed canonical columns. Both end in the canonical record plus an
``error`` text; bad rows are split off with their reason instead of being logged away.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell import schema
from tidewell.functions.tokens import bound, once, parse_timestamp

NUMBER_KINDS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)"


@dataclass
class Split:
    accepted: DataFrame
    rejected: DataFrame


def json_records(df: DataFrame, column: str = "value") -> DataFrame:
    """Parse JSON text into a VARIANT column ``record``; text that is not exactly one value gives null.

    The parser stops behind the first value, so the text is read as the first of two elements: a marker
    that stands where it should shows that nothing else followed.
    """
    end = F.md5(F.col(column).cast("binary"))  # a mark that the text itself cannot hold
    text = F.concat(F.lit("["), F.col(column), F.lit(',"'), F.col("__end"), F.lit('"]'))
    two = once(once(df, {"__end": end}), {"__two": F.try_parse_json(text)})
    whole = (F.try_variant_get("__two", "$[1]", "string") == F.col("__end")) & F.try_variant_get("__two", "$[2]", "variant").isNull()
    return once(two, {"record": F.when(whole, F.try_variant_get("__two", "$[0]", "variant"))}).drop("__two", "__end")


def field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$['{name}']", "variant")


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def _text(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$['{name}']", "string")


def _entries(record: Column) -> Column:
    return F.try_variant_get(record, "$.measurements", "map<string,variant>")


def _is_number(kind: Column) -> Column:
    return kind.rlike(NUMBER_KINDS)


def _first_error(*rules: tuple[Column, Column | str]) -> Column:
    return F.coalesce(
        *[F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in rules]
    )


def _bad_key(entries: Column) -> Column:
    """The first measurement that is neither number nor text."""
    bad = F.filter(
        F.map_entries(entries), lambda e: ~_kind(e["value"]).rlike(rf"{NUMBER_KINDS}|^STRING")
    )
    return F.get(bad, F.lit(0))["key"]


def _bad_measurement(key: Column) -> Column:
    return F.concat(F.lit("Measurement '"), key, F.lit("' must be a number or string"))


def time_series_error(record: Column) -> Column:
    """First broken rule of a time-series record, or null. The rules are tried in order.

    What several rules look at is taken out of the record once. Typing a whole object is
    costly, so that happens only when a field is absent.
    """
    parts = F.struct(
        _kind(field(record, "series_id")).alias("series"),
        _text(record, "series_id").alias("name"),
        _kind(field(record, "timestamp")).alias("time"),
        _entries(record).alias("entries"),
    )

    def rules(p: Column) -> Column:
        no_map = p["entries"].isNull()
        return _first_error(
            ((p["series"] == "ABSENT") & ~_kind(record).startswith("OBJECT"), "Record must be a dictionary"),
            (p["series"] == "ABSENT", "Missing required field: series_id"),
            (p["time"] == "ABSENT", "Missing required field: timestamp"),
            (no_map & (_kind(field(record, "measurements")) == "ABSENT"), "Missing required field: measurements"),
            ((p["series"] != "STRING") | (p["name"] == ""), "series_id must be a non-empty string"),
            (p["time"] != "STRING", "timestamp must be a string"),
            (no_map, "measurements must be a dictionary"),
            (F.size(p["entries"]) == 0, "measurements must contain at least one key-value pair"),
            # null when no key is bad, and so is the text made of it
            (F.lit(True), _bad_measurement(_bad_key(p["entries"]))),
        )

    return bound(parts, rules)


def _price_field(top: Column, inner: Column, name: str) -> Column:
    """The first alias that holds something: record before measurements, alias by alias."""
    tries = [place[alias] for alias in schema.ALIASES[name] for place in (top, inner)]
    return F.coalesce(*[F.when(~F.is_variant_null(t), t) for t in tries])


def _price_error(name: str, v: Column) -> Column:
    return F.when(v.isNotNull() & ~_is_number(_kind(v)), F.lit(f"{name} must be a number")).when(
        F.try_variant_get(v, "$", "double") < 0, F.lit(f"{name} must be non-negative")
    )


def financial_error(record: Column) -> Column:
    """First broken rule of a price record, flat or nested, or null."""
    parts = F.struct(
        F.try_variant_get(record, "$", "map<string,variant>").alias("top"),
        _entries(record).alias("entries"),
    )
    return bound(parts, lambda p: _price_rules(p["top"], p["entries"]))


def _price_rules(top: Column, entries: Column) -> Column:
    def text(name: str) -> Column:
        return F.nullif(F.try_variant_get(top[name], "$", "string"), F.lit(""))

    ident_kind = F.when(text("ticker").isNotNull(), _kind(top["ticker"])).otherwise(_kind(top["series_id"]))
    any_number = F.coalesce(
        F.exists(F.map_values(entries), lambda v: _is_number(_kind(v))), F.lit(False)
    )
    time_kind = _kind(top["timestamp"])
    return _first_error(
        (top.isNull(), "Record must be a dictionary"),
        (F.coalesce(text("ticker"), text("series_id")).isNull(), "Missing required field: ticker or series_id"),
        (time_kind == "ABSENT", "Missing required field: timestamp"),
        (ident_kind != "STRING", "ticker/series_id must be a non-empty string"),
        (
            _price_field(top, entries, "close").isNull() & ~any_number,
            "Missing required field: close (or any numeric measurement)",
        ),
        *[
            (F.lit(True), bound(_price_field(top, entries, name), partial(_price_error, name)))
            for name in ("open", "high", "low", "close", "vol")
        ],
        # after conversion the time-series rules apply as well
        (time_kind != "STRING", "timestamp must be a string"),
        (F.lit(True), _bad_measurement(_bad_key(entries))),
    )


def _value(v: Column) -> Column:
    number = F.when(_is_number(_kind(v)), F.try_variant_get(v, "$", "double"))
    return F.struct(number.alias("num"), F.try_variant_get(v, "$", "string").alias("raw"))


def _empty_map() -> Column:
    return F.create_map().cast(schema.MEASUREMENTS)


def _measurements(record: Column) -> Column:
    return F.coalesce(F.transform_values(_entries(record), lambda _, v: _value(v)), _empty_map())


def merge_last_wins(first: Column, second: Column) -> Column:
    def merged(last: Column) -> Column:
        return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(last, k)), last)

    return bound(second, merged)


def _top_level_prices(record: Column) -> Column:
    """Price fields next to the measurements. ``volume`` is taken as ``vol``."""
    values = {n: field(record, n) for n in schema.PRICE_FIELDS}
    values["vol"] = F.coalesce(values["vol"], field(record, "volume"))
    return schema.measurement_map({n: F.when(v.isNotNull(), _value(v)) for n, v in values.items()})


def canonical(record: Column, record_type: str = "time_series") -> dict[str, Column]:
    """Canonical columns of a valid record."""
    raw_time = _text(record, "timestamp")
    metadata = F.try_variant_get(record, "$.metadata", "map<string,string>")
    if record_type == "financial":
        sid = F.coalesce(F.nullif(_text(record, "ticker"), F.lit("")), _text(record, "series_id"))
        measurements = merge_last_wins(_measurements(record), _top_level_prices(record))
        metadata = F.lit(None).cast(schema.METADATA)  # prices carry no metadata over
    else:
        sid, measurements = _text(record, "series_id"), _measurements(record)
    return {
        "series_id": sid,
        "timestamp": parse_timestamp(raw_time),
        "timestamp_raw": raw_time,
        "measurements": measurements,
        "metadata": metadata,
        "format": _text(record, "format"),
    }


ERRORS = {"time_series": time_series_error, "financial": financial_error}


def process(df: DataFrame, record_type: str = "time_series") -> DataFrame:
    """Canonical columns and ``error`` for a table with a VARIANT ``record``.

    A timestamp that cannot be parsed is no error: ``timestamp`` is null and the text stays
    in ``timestamp_raw``.
    """
    if record_type not in ERRORS:
        raise ValueError(f"Unknown record type: {record_type}")
    others = [c for c in df.columns if c != "record"]
    record = F.col("record")
    checked = bound(record, ERRORS[record_type])
    fields = bound(
        record, lambda v: F.struct(*[c.alias(n) for n, c in canonical(v, record_type).items()])
    )
    return once(df, {"__r": fields, "error": checked}).select(*others, "__r.*", "error")


def check_canonical(df: DataFrame) -> DataFrame:
    """The time-series rules for typed sources; an ``error`` of the reader comes first."""
    empty = F.get(
        F.filter(F.map_entries("measurements"), lambda e: e["value"]["raw"].isNull()), F.lit(0)
    )["key"]
    found = _first_error(
        (F.col("series_id").isNull() | (F.col("series_id") == ""), "series_id must be a non-empty string"),
        (F.col("timestamp_raw").isNull(), "timestamp must be a string"),
        (F.col("measurements").isNull(), "measurements must be a dictionary"),
        (F.size("measurements") == 0, "measurements must contain at least one key-value pair"),
        (empty.isNotNull(), _bad_measurement(empty)),
    )
    return df.withColumn("error", F.coalesce("error", found) if "error" in df.columns else found)


def split(processed: DataFrame) -> Split:
    return Split(
        processed.where(F.col("error").isNull()).drop("error"),
        processed.where(F.col("error").isNotNull()),
    )


def outcome_counts(processed: DataFrame, by: str = "source_file") -> DataFrame:
    """Per source: total, accepted and rejected records."""
    return processed.groupBy(by).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("success"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
