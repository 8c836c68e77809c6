"""Moving between map, wide and long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans import chunking

MAX_KEYS = 10_000
POINTS_PER_ROW = 10_000


def measurement_kinds(
    df: DataFrame, keys: Sequence[str] | None = None, column: str = "measurements"
) -> dict[str, str]:
    """The map keys, sorted, with the field that keeps all their values: ``raw`` if one holds any text, else ``num``.

    They become column names, so their number is checked; ``keys`` limits the look to these.
    """
    entries = df.select(F.explode(column).alias("k", "v"))
    if keys is not None:
        entries = entries.where(F.col("k").isin(list(keys)))
    text = F.col("v")["num"].isNull() & F.col("v")["raw"].isNotNull()
    found = entries.groupBy("k").agg(F.max(text).alias("text")).limit(MAX_KEYS + 1).collect()
    if len(found) > MAX_KEYS:
        raise ValueError(f"more than {MAX_KEYS} measurements cannot become columns; use unpivot_long")
    kinds = {r["k"]: "raw" if r["text"] else "num" for r in found}
    return {k: kinds.get(k, "num") for k in (sorted(kinds) if keys is None else keys)}


def measurement_keys(df: DataFrame, column: str = "measurements") -> list[str]:
    """Sorted union of the map keys."""
    return list(measurement_kinds(df, column=column))


def _kinds(df: DataFrame, keys: Sequence[str] | None, kind: str | None) -> dict[str, str]:
    if kind is None:
        return measurement_kinds(df, keys)
    return dict.fromkeys(measurement_keys(df) if keys is None else keys, kind)


def _value(key: str, kind: str) -> Column:
    return F.col("measurements")[key][kind]


def flatten(
    df: DataFrame, keys: Sequence[str] | None = None, prefix: str = "measurement_", kind: str | None = None
) -> DataFrame:
    """One column per measurement, other columns kept; no pivot, no shuffle of the rows.

    Without ``kind`` a measurement that holds any text becomes a text column, all others numbers.
    """
    kinds = _kinds(df, keys, kind)
    rest = [c for c in df.columns if c != "measurements"]
    return df.select(*rest, *[_value(k, t).alias(f"{prefix}{k}") for k, t in kinds.items()])


def expand(
    df: DataFrame, keys: Sequence[str] | None = None, on_conflict: str = "measurement", kind: str | None = None
) -> DataFrame:
    """Columns without prefix, typed as in ``flatten``. On a name clash the measurement wins, or the column is kept."""
    kinds = _kinds(df, keys, kind)
    keys = list(kinds)
    if on_conflict == "keep":
        return df.select(
            *[c for c in df.columns if c != "measurements"],
            *[_value(k, t).alias(k) for k, t in kinds.items() if k not in df.columns],
        )
    # a record without a map keeps its own field
    own = {
        c: F.when(F.map_contains_key("measurements", c), _value(c, "raw")).otherwise(
            F.col(f"`{c}`").cast("string")
        )
        for c in df.columns
        if c in keys
    }
    rest = [own[c].alias(c) if c in own else F.col(f"`{c}`") for c in df.columns if c != "measurements"]
    return df.select(*rest, *[_value(k, t).alias(k) for k, t in kinds.items() if k not in own])


def unpivot_long(df: DataFrame, numeric_only: bool = True) -> DataFrame:
    """(series_id, timestamp, measurement, value); rows without a time are dropped."""
    carried = [c for c in ("metadata",) if c in df.columns]
    long = df.where(F.col("timestamp").isNotNull()).select(
        "series_id", "timestamp", *carried, F.explode("measurements").alias("measurement", "m")
    )
    value = F.col("m.num").alias("value")
    if numeric_only:
        return long.where(F.col("m.num").isNotNull()).select(
            "series_id", "timestamp", "measurement", value, *carried
        )
    text = F.when(F.col("m.num").isNull(), F.col("m.raw")).alias("value_text")
    return long.select("series_id", "timestamp", "measurement", value, text, *carried)


def in_blocks(
    df: DataFrame, by: Sequence[str], block: str, points: int, bounds: Sequence[float] | None = None
) -> DataFrame:
    """Number time-ordered blocks of at most ``points`` rows within each ``by`` and time unit.

    Adds ``block`` (start of the unit) and ``part``. A busy series has many rows per unit, so
    the unit alone would not bound what is collected into one row.
    """
    timed = df.where(F.col("timestamp").isNotNull()).withColumn("block", F.date_trunc(block, "timestamp"))
    placed = chunking.row_positions(timed, ["timestamp"], [*by, "block"], "__at", bounds)
    return placed.withColumn("part", F.floor((F.col("__at") - 1) / points)).drop("__at")


def aligned_arrays(
    df: DataFrame,
    keys: Sequence[str] | None = None,
    block: str = "day",
    points: int = POINTS_PER_ROW,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Per series and block: the time vector and one vector per measurement, gaps kept null.

    A whole series would not fit one row at scale, so vectors come in bounded blocks.
    """
    keys = measurement_keys(df) if keys is None else keys
    entry = F.struct(F.col("timestamp"), *[_value(k, "num").alias(k) for k in keys])
    blocks = (
        in_blocks(df, ["series_id"], block, points, bounds)
        .groupBy("series_id", "block", "part")
        .agg(F.array_sort(F.array_agg(entry)).alias("rows"))
    )
    return blocks.select(
        "series_id", "block", "part",
        F.col("rows.timestamp").alias("timestamps"),
        *[F.col(f"rows.{k}").alias(k) for k in keys],
    )


def sorted_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in sorted(df.columns)])


def union_records(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of tables with different columns; what a table lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def plot_table(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Flattened, synthetic and unreadable times dropped, time-sorted."""
    from tidewell.operators.query import real_timestamps

    return flatten(real_timestamps(df), keys).orderBy("timestamp")
