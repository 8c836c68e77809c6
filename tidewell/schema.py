"""The canonical record and the fixed names the data model uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ``num`` is null for text; ``raw`` keeps the source token so text sinks print it unchanged.
VALUE = T.StructType([T.StructField("num", T.DoubleType()), T.StructField("raw", T.StringType())])
MEASUREMENTS = T.MapType(T.StringType(), VALUE)
METADATA = T.MapType(T.StringType(), T.StringType())

RECORD = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestamp_raw", T.StringType()),
        T.StructField("measurements", MEASUREMENTS),
        T.StructField("metadata", METADATA),
        T.StructField("format", T.StringType()),
    ]
)

# Accepted spellings per price field, tried in this order.
ALIASES = {
    "close": ["close", "c", "adj_close", "adjclose", "adj close", "price", "last"],
    "open": ["open", "o"],
    "high": ["high", "h"],
    "low": ["low", "l"],
    "vol": ["vol", "volume", "v"],
}
# Fields of a price record that may stand next to the measurements.
PRICE_FIELDS = ["open", "high", "low", "close", "vol", "openint"]
OHLC = ["open", "high", "low", "close"]


def number_value(c: Column) -> Column:
    return F.struct(c.cast("double").alias("num"), c.cast("string").alias("raw"))


def text_value(c: Column) -> Column:
    return F.struct(F.lit(None).cast("double").alias("num"), c.cast("string").alias("raw"))


def measurement_map(values: dict[str, Column]) -> Column:
    """A measurement map of named VALUE structs, entries with a null token left out."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"]["raw"].isNotNull()))


def string_map(values: dict[str, Column]) -> Column:
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in values.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def canonical_text(c: Column) -> Column:
    """A map as text with sorted keys: maps cannot be grouped or compared directly."""
    return F.to_json(F.array_sort(F.map_entries(c)))
