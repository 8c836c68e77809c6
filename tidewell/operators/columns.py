"""Row filters and single-column changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.condition import column_of
from tidewell.functions.tokens import parse_any
from tidewell.operators.missing import numeric_columns
from tidewell.plans.quantiles import known


class NotConvertible(ValueError):
    pass


def filter_rows(df: DataFrame, column: str, condition: str) -> DataFrame:
    return df.where(column_of(f"`{column}` {condition}", df, as_filter=True))


def add_column(df: DataFrame, column: str, value=None, expression: str | None = None) -> DataFrame:
    """An expression wins over a value; division by zero gives null."""
    if expression:
        return df.withColumn(column, column_of(expression, df))
    return df if value is None else df.withColumn(column, F.lit(value))


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def normalize_timestamps(df: DataFrame, column: str = "timestamp", sort: bool = True) -> DataFrame:
    """Parse, drop what does not parse, sort by time."""
    parsed = df.withColumn(column, as_timestamp(df, column)).dropna(subset=[column])
    return parsed.orderBy(column) if sort else parsed


def as_timestamp(df: DataFrame, column: str):
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return parse_any(F.col(column))
    if isinstance(kind, (T.DateType, T.TimestampNTZType, T.TimestampType)):
        return F.col(column).cast("timestamp")
    # a bare number counts nanoseconds since 1970
    return F.timestamp_micros((F.col(column) / 1000).cast("long"))


def convert_type(df: DataFrame, column: str, dtype: str = "float") -> DataFrame:
    """``float``, ``int``, ``datetime`` or ``string``; what does not convert becomes null.

    ``int`` refuses a column that holds fractions. That depends on the data, so one small
    probe runs first.
    """
    c = F.col(column)
    text = isinstance(df.schema[column].dataType, T.StringType)
    number = F.trim(c).try_cast("double") if text else c.cast("double")
    if dtype == "float":
        return df.withColumn(column, number)
    if dtype == "int":
        if df.select(known(number).alias("x")).where("x <> floor(x)").limit(1).count():
            raise NotConvertible(f"{column} holds fractions")
        exact = F.trim(c).try_cast("bigint") if text else F.lit(None).cast("bigint")
        return df.withColumn(column, F.coalesce(exact, number.try_cast("bigint")))
    if dtype == "datetime":
        return df.withColumn(column, as_timestamp(df, column))
    if dtype == "string":
        return df.withColumn(column, c.cast("string"))
    raise NotConvertible(f"unknown type {dtype!r}")


def clip_values(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    c = F.col(column)
    bounded = c if high is None else F.least(c, F.lit(high))
    bounded = bounded if low is None else F.greatest(bounded, F.lit(low))
    return df.withColumn(column, F.when(c.isNotNull(), bounded))


def round_values(
    df: DataFrame, columns: Sequence[str] | None = None, decimals: int = 2
) -> DataFrame:
    """Half-even rounding of the binary value, as numeric libraries do."""
    scale = float(10**decimals)
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    real = [c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.rint(F.col(c) * scale) / scale for c in real}) if real else df
