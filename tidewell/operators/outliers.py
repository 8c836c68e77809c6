"""Outlier removal. Bounds come from one small aggregate and then filter the scan directly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.missing import numeric_columns
from tidewell.plans.quantiles import exact_quantiles, known


def iqr_fences(q1: float, q3: float) -> tuple[float, float]:
    spread = q3 - q1
    return q1 - 1.5 * spread, q3 + 1.5 * spread


def remove_outliers_iqr(
    df: DataFrame, columns: Sequence[str] | None = None, sequential: bool = True
) -> DataFrame:
    """Keep rows within 1.5 interquartile ranges; missing values are dropped.

    ``sequential`` takes each column's quartiles after the previous column's filter. With
    ``sequential=False`` all quartiles come from the input, in one pass.
    """
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    kept = df
    together = {} if sequential else exact_quantiles(df, columns, [0.25, 0.75])
    for c in columns:
        q1, q3 = together[c] if c in together else exact_quantiles(kept, [c], [0.25, 0.75])[c]
        if q1 is None:
            return kept.where(F.lit(False))
        low, high = iqr_fences(q1, q3)
        kept = kept.where(F.col(c).between(low, high))
    return kept


def remove_outliers_zscore(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 3.0
) -> DataFrame:
    """Keep rows with ``|x - mean| / sample std`` below ``threshold``; a constant column keeps none."""
    columns = [c for c in (columns or numeric_columns(df)) if c in df.columns]
    kept = df
    for c in columns:
        row = kept.agg(F.avg(known(c)).alias("m"), F.stddev_samp(known(c)).alias("s")).first()
        if not row["s"]:
            return kept.where(F.lit(False))
        kept = kept.where(F.abs((known(c) - F.lit(row["m"])) / F.lit(row["s"])) < threshold)
    return kept
