"""Removing and counting duplicate rows; missing values equal each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def comparable(df: DataFrame, column: str) -> Column:
    """The column itself, or its JSON text where Spark cannot group by the type."""
    kind = df.schema[column].dataType
    c = F.col(f"`{column}`")
    if isinstance(kind, T.MapType):
        return F.to_json(F.array_sort(F.map_entries(c)))
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(F.struct(c))
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def remove_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order: Sequence[str] = (),
) -> DataFrame:
    """Keep the first or last row of each key in ``order``, or with ``False`` only unique keys.

    ``row_number() = 1`` lets Spark cut every key to one row per input partition before the
    shuffle (WindowGroupLimit), so a heavily repeated key does not pile up in one task.
    """
    names = df.columns
    keys = {f"__key{i}": comparable(df, c) for i, c in enumerate(subset or names)}
    keyed = df.withColumns(keys)
    if keep is False:
        rest = [F.first(f"`{c}`").alias(c) for c in names]
        once = keyed.groupBy(*keys).agg(F.count("*").alias("__n"), *rest)
        return once.where(F.col("__n") == 1).select(*names)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be 'first', 'last' or False, not {keep!r}")
    ties = [c for c in names if c not in order and c not in (subset or names)]
    ranked_by = [F.col(c) for c in order] or [comparable(df, c) for c in ties] or [F.lit(0)]
    if keep == "last":
        ranked_by = [c.desc() for c in ranked_by]
    w = Window.partitionBy(*keys).orderBy(*ranked_by)
    return keyed.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).select(*names)


def duplicate_rows(df: DataFrame, name: str = "duplicate_rows") -> DataFrame:
    """One row: how many rows equal an earlier row."""
    keys = [comparable(df, c).alias(f"k{i}") for i, c in enumerate(df.columns)]
    counted = df.select(*keys).groupBy(*[f"k{i}" for i in range(len(keys))]).count()
    return counted.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias(name))
