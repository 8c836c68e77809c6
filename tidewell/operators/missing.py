"""Dropping, filling and interpolating missing values (null or NaN)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.plans import chunking
from tidewell.plans.quantiles import exact_quantiles, known


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    real = [
        c for c in columns if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
    ]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in real}) if real else df


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    return df.dropna(how=how, subset=list(subset) if subset else None)


def fill_value(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    return df.fillna(value, subset=list(columns) if columns else None)


def _fill_with(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    known_values = {c: v for c, v in values.items() if v is not None}
    if not known_values:
        return df
    return df.withColumns({c: F.coalesce(known(c), F.lit(v)) for c, v in known_values.items()})


def fill_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns else numeric_columns(df)
    if not columns:
        return df
    row = df.agg(*[F.avg(known(c)).alias(c) for c in columns]).first()
    return _fill_with(df, row.asDict())


def fill_median(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns) if columns else numeric_columns(df)
    if not columns:
        return df
    medians = exact_quantiles(df, columns, [0.5])
    return _fill_with(df, {c: q[0] for c, q in medians.items()})


def fill_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value, the smallest on ties, 0 when all are missing.

    Counted per value and cut to one row, instead of one aggregate that keeps every value.
    """
    filled = df
    for c in columns:
        kind = df.schema[c].dataType
        top = (
            nan_to_null(df.select(c), [c])
            .where(F.col(c).isNotNull())
            .groupBy(c)
            .agg(F.count("*").alias("__n"))
            .orderBy(F.desc("__n"), F.asc(c))
            .first()
        )
        value = F.lit(top[0] if top else 0).cast(kind)
        filled = nan_to_null(filled, [c]).withColumn(c, F.coalesce(F.col(c), value))
    return filled


def fill_along(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    backward: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Forward or backward fill along ``order``, within ``by`` when given."""
    columns = [c for c in (columns or df.columns) if c not in by and c not in order]
    return chunking.fill_ordered(nan_to_null(df, columns), columns, order, by, backward, bounds)


def interpolate(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    by: Sequence[str] = (),
    method: str = "linear",
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Fill inner gaps between the neighbouring known values.

    ``linear`` goes by row position, ``time`` by the first order column, ``nearest`` takes
    the nearer neighbour by position. Leading gaps stay; trailing gaps repeat the last known
    value (``nearest`` leaves them).
    """
    if method in ("pad", "ffill", "bfill", "backfill"):
        return fill_along(df, order, by, columns, method in ("bfill", "backfill"), bounds)
    if method not in ("linear", "time", "nearest"):
        raise ValueError(f"unknown interpolation method {method!r}")
    if bounds is None:
        bounds = chunking.chunk_bounds(df, order)
    names = df.columns
    rows = nan_to_null(df, columns)
    if method == "time":
        placed = rows.withColumn("__at", chunking.numeric_key(rows, order[0]))
    else:
        placed = chunking.row_positions(rows, order, by, "__at", bounds)
        placed = placed.withColumn("__at", F.col("__at").cast("double"))
    near = _neighbours(placed, columns, order, list(by), bounds)
    at = F.col("__at")
    filled: dict[str, Column] = {}
    for i, c in enumerate(columns):
        before, after = F.col(f"__before{i}"), F.col(f"__after{i}")
        share = F.try_divide(at - before["at"], after["at"] - before["at"])
        if method == "nearest":
            inner = F.when(at - before["at"] <= after["at"] - at, before["v"]).otherwise(after["v"])
            estimate = F.when(before.isNotNull() & after.isNotNull(), inner)
        else:
            line = before["v"] + (after["v"] - before["v"]) * share
            estimate = F.when(before.isNull(), None).when(after.isNull(), before["v"]).otherwise(line)
        filled[c] = F.coalesce(F.col(c).cast("double"), estimate)
    return near.withColumns(filled).select(*names)


def _neighbours(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], by: list[str], bounds
) -> DataFrame:
    """Add ``struct(at, v)`` of the last known value up to, and the first from, each row."""
    marks = {
        i: F.when(
            F.col(c).isNotNull(),
            F.struct(F.col("__at").alias("at"), F.col(c).cast("double").alias("v")),
        )
        for i, c in enumerate(columns)
    }
    sides = {"__before": False, "__after": True}  # name: read backward
    if not bounds and by:
        return df.withColumns(
            {
                f"{side}{i}": F.last(m, ignorenulls=True).over(
                    chunking.along(by, order, backward).rowsBetween(*chunking.FIRST_TO_HERE)
                )
                for side, backward in sides.items()
                for i, m in marks.items()
            }
        )
    marked = chunking.with_chunk(df, order, bounds).withColumns(
        {f"__mark{i}": m for i, m in marks.items()}
    )
    rank = {i: F.when(F.col(f"__mark{i}").isNotNull(), F.struct(*order)) for i in marks}
    summary = marked.groupBy(*by, chunking.CHUNK).agg(
        *[F.max_by(f"__mark{i}", rank[i]).alias(f"__before{i}") for i in marks],
        *[F.min_by(f"__mark{i}", rank[i]).alias(f"__after{i}") for i in marks],
    )
    keys = [F.col(k) for k in (*by, chunking.CHUNK)]

    def reaching(side: str, i: int) -> Column:
        across = chunking.along(by, [chunking.CHUNK], sides[side]).rowsBetween(*chunking.BEFORE)
        return F.last(f"{side}{i}", ignorenulls=True).over(across).alias(f"{side}{i}")

    scanned = summary.select(*keys, *[reaching(side, i) for side in sides for i in marks])
    heads_and_tails = F.array(
        *[
            F.struct(F.lit(edge).alias("edge"), *[F.col(f"{side}{i}").alias(f"m{i}") for i in marks])
            for edge, side in ((-1, "__before"), (1, "__after"))
        ]
    )
    edges = scanned.select(*keys, F.explode(heads_and_tails).alias("e")).select(
        *keys,
        F.col("e.edge").alias(chunking.EDGE),
        *[F.col(f"e.m{i}").alias(f"__mark{i}") for i in marks],
    )
    both = marked.withColumn(chunking.EDGE, F.lit(0)).unionByName(edges, allowMissingColumns=True)
    near = both.withColumns(
        {
            f"{side}{i}": F.last(f"__mark{i}", ignorenulls=True).over(
                chunking.chunk_window(by, order, backward).rowsBetween(*chunking.FIRST_TO_HERE)
            )
            for side, backward in sides.items()
            for i in marks
        }
    )
    return near.where(F.col(chunking.EDGE) == 0)
