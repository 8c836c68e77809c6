"""Table profiles and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.missing import numeric_columns
from tidewell.operators.outliers import iqr_fences
from tidewell.plans.quantiles import exact_quantiles, known

QUARTILES = [0.25, 0.5, 0.75]


def _missing(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    real = isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType))
    return c.isNull() | F.isnan(c) if real else c.isNull()


def _unpivot(row: DataFrame, per_column: Mapping[str, Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One wide aggregate row to one row per column."""
    structs = [
        F.struct(F.lit(c).alias("column_name"), *[v.alias(n) for v, n in zip(values, names)])
        for c, values in per_column.items()
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def profile_columns(df: DataFrame) -> DataFrame:
    """Per column: type, rows, missing count and missing percentage, in one pass."""
    fields = df.schema.fields
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(_missing(df, f.name)).alias(f"m{i}") for i, f in enumerate(fields)],
    )
    per = {}
    for i, f in enumerate(fields):
        m = F.col(f"m{i}")
        share = F.try_divide(m * 100.0, F.col("rows"))
        per[f.name] = [F.lit(f.dataType.simpleString()), F.col("rows"), m, share]
    return _unpivot(row, per, ["dtype", "total_rows", "missing_values", "missing_percentage"])


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; quartiles are exact."""
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, QUARTILES)
    aggregates = []
    for i, c in enumerate(columns):
        x = known(c)
        aggregates += [
            F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
            F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
        ]
    per = {}
    for i, c in enumerate(columns):
        q = [F.lit(v).cast("double") for v in quartiles[c]]
        per[c] = [F.col(f"{k}{i}") for k in "nasl"] + q + [F.col(f"h{i}")]
    names = ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]
    return _unpivot(df.agg(*aggregates), per, names)


def datetime_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max and their distance in seconds per timestamp column."""
    kinds = (T.TimestampType, T.TimestampNTZType)
    columns = list(columns or [f.name for f in df.schema if isinstance(f.dataType, kinds)])
    row = df.agg(
        *[F.min(F.col(c).cast("timestamp")).alias(f"l{i}") for i, c in enumerate(columns)],
        *[F.max(F.col(c).cast("timestamp")).alias(f"h{i}") for i, c in enumerate(columns)],
    )
    per = {}
    for i, c in enumerate(columns):
        low, high = F.col(f"l{i}"), F.col(f"h{i}")
        per[c] = [low, high, (F.unix_micros(high) - F.unix_micros(low)) / 1e6]
    return _unpivot(row, per, ["min", "max", "range_seconds"])


def source_report(sources: Mapping[str, DataFrame]) -> DataFrame:
    """Title, rows, columns and numeric statistics per source, as one table."""
    report = None
    for title, df in sources.items():
        rows = df.agg(F.count("*").alias("total_rows"))
        head = rows.select(
            F.lit(title).alias("source"), "total_rows",
            F.lit(len(df.columns)).cast("long").alias("total_columns"),
        )
        stats = describe_numeric(df).withColumn("source", F.lit(title))
        part = head.join(stats, "source", "left")
        report = part if report is None else report.unionByName(part)
    return report


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, in one pass."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    row = df.agg(*[F.corr(known(a), known(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    structs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Equal-width bins over the value range; the last one includes the maximum."""
    x = known(column)
    row = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    low, high = row["lo"], row["hi"]
    if low is None:
        return df.select(F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n")).limit(0)
    width = (high - low) / bins
    cell = F.least(F.floor((x - low) / width), F.lit(bins - 1)) if width else F.lit(0)
    return (
        df.where(x.isNotNull())
        .groupBy(cell.cast("long").alias("bin"))
        .agg(F.count("*").alias("n"))
        .select("bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("lower"), "n")
    )


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, fences and the number of values outside them."""
    q1, q2, q3 = exact_quantiles(df, [column], QUARTILES)[column]
    if q1 is None:
        raise ValueError(f"{column} holds no value")
    low, high = iqr_fences(q1, q3)
    x = known(column)
    return df.agg(
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
        F.lit(low).alias("lower_fence"), F.lit(high).alias("upper_fence"),
        F.count_if((x < low) | (x > high)).alias("outliers"),
        F.min(F.when(x >= low, x)).alias("whisker_low"),
        F.max(F.when(x <= high, x)).alias("whisker_high"),
    )
