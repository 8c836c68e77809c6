"""Resampling into a gap-free time grid, and price bars."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.operators.columns import as_timestamp
from tidewell.plans import chunking
from tidewell.plans.quantiles import grouped_quantiles, known

# Seconds per unit of the frequency text.
SECONDS = {
    "s": 1, "S": 1, "min": 60, "T": 60, "h": 3600, "H": 3600, "D": 86400, "d": 86400,
}
# Calendar units, labelled with the last day of the period; weeks end on Sunday.
CALENDAR = {
    "W": "week", "M": "month", "ME": "month", "Q": "quarter", "QE": "quarter",
    "Y": "year", "YE": "year", "A": "year",
}
NUMERIC_ONLY = {"mean", "sum", "median", "std", "var"}
SPINE_BLOCK = 4096
#: bin numbers that one task looks at for the next bin of a table without groups, a power of two
NEXT_RANGE = 1 << 16


@dataclass(frozen=True)
class Grid:
    """Maps a timestamp to a bin number and a bin number to its label."""

    unit: str
    n: int
    origin: int  # first midnight in epoch seconds, or first calendar period number

    def bin_of(self, ts: Column) -> Column:
        if self.unit == "seconds":
            return F.floor((F.unix_seconds(ts) - self.origin) / self.n).cast("long")
        return F.ceil((period_number(ts, self.unit) - self.origin) / self.n).cast("long")

    def label(self, number: Column) -> Column:
        if self.unit == "seconds":
            return F.timestamp_seconds(self.origin + number * self.n)
        period = (self.origin + number * self.n).cast("int")
        if self.unit == "week":
            return F.date_add(F.lit("1970-01-04").cast("date"), period * 7).cast("timestamp")
        months = {"month": 1, "quarter": 3, "year": 12}[self.unit]
        last_month = (period + 1) * months - 1
        day = F.last_day(F.add_months(F.lit("1970-01-01").cast("date"), last_month))
        return day.cast("timestamp")


def period_number(ts: Column, unit: str) -> Column:
    """Weeks (ending Sunday), months, quarters or years since 1970."""
    if unit == "week":
        sunday = F.next_day(F.date_sub(ts.cast("date"), 1), "SUN")
        return (F.datediff(sunday, F.lit("1970-01-04").cast("date")) / 7).cast("long")
    months = (F.year(ts) - 1970) * 12 + F.month(ts) - 1
    return F.floor(months / {"month": 1, "quarter": 3, "year": 12}[unit])


def parse_frequency(freq: str) -> tuple[str, int]:
    match = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", freq)
    if not match:
        raise ValueError(f"unknown frequency {freq!r}")
    n, unit = int(match.group(1) or 1), match.group(2)
    if n < 1:
        raise ValueError(f"unknown frequency {freq!r}")
    if unit in SECONDS:
        return "seconds", n * SECONDS[unit]
    if unit in CALENDAR:
        return CALENDAR[unit], n
    raise ValueError(f"unknown frequency {freq!r}")


def grid_for(df: DataFrame, column: str, freq: str) -> Grid | None:
    """The grid anchored at midnight of the first day; None for a table without times.

    Widths that divide a day, and single calendar periods, are the same for any first day and
    need no look at the data.
    """
    unit, n = parse_frequency(freq)
    if (unit == "seconds" and 86400 % n == 0) or (unit != "seconds" and n == 1):
        return Grid(unit, n, 0)
    first = F.min(column)
    start = F.unix_seconds(F.date_trunc("day", first)) if unit == "seconds" else period_number(first, unit)
    origin = df.agg(start.alias("o")).first()["o"]
    return None if origin is None else Grid(unit, n, origin)


def _aggregate(method: str, column: str, text: bool, order: Sequence[str]) -> Column:
    value = F.col(column) if text else known(column)
    rank = F.struct(*[F.col(o) for o in order])
    present = F.when(value.isNotNull(), rank)
    match method:
        case "mean":
            return F.avg(value)
        case "sum":
            return F.sum(value)
        case "max":
            return F.max(value)
        case "min":
            return F.min(value)
        case "count":
            return F.count(value)
        case "std":
            return F.stddev_samp(value)
        case "var":
            return F.var_samp(value)
        case "first":
            return F.min_by(value, present)
        case "last":
            return F.max_by(value, present)
    raise ValueError(f"unknown resample method {method!r}")


def with_empty_bins(grouped: DataFrame, by: Sequence[str], number: str, values: Sequence[str]) -> DataFrame:
    """Add a row without values for every bin missing between a group's first and last one.

    Each bin is followed by the gap up to the next, so the table is neither scanned again nor
    joined. The window sees aggregated rows only; their number depends on the grid, not on the
    data. Gaps are exploded in blocks, so no row ever holds a long array.
    """
    following = F.lead(number).over(chunking.along(by, [number]))
    ahead = grouped.withColumn("__next", following) if by else _with_next_bin(grouped, number)
    reach = ahead.withColumn("__hi", F.coalesce(F.col("__next") - 1, F.col(number))).withColumnRenamed(number, "__lo")
    first, last = F.floor(F.col("__lo") / SPINE_BLOCK), F.floor(F.col("__hi") / SPINE_BLOCK)
    blocks = reach.withColumn("__b", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("__lo"), F.col("__b") * SPINE_BLOCK)
    high = F.least(F.col("__hi"), (F.col("__b") + 1) * SPINE_BLOCK - 1)
    bins = blocks.withColumn(number, F.explode(F.sequence(low, high)))
    own = F.col(number) == F.col("__lo")
    return bins.select(*by, number, *[F.when(own, F.col(v)).alias(v) for v in values])


def _with_next_bin(grouped: DataFrame, number: str) -> DataFrame:
    """``__next``: the bin after each one, of a table without groups, cut into ranges of ``NEXT_RANGE`` numbers.

    The last bin of a range is followed by the first one of a later range, which joins it as an edge row. Which
    range that is comes from the first bins alone, in the same way one level up; at the top all ranges are one.
    """
    shift = NEXT_RANGE.bit_length() - 1
    # numbers from 0, so that three levels hold all of them
    key = F.shiftright(F.col(number) + (1 << 3 * shift - 1), shift)
    ranged = grouped.withColumn("__range", key)
    heads = ranged.groupBy("__range").agg(F.min(number).alias("__head"))
    upper = heads.withColumn("__up", F.shiftright("__range", shift))
    tops = upper.groupBy("__up").agg(F.min("__head").alias("__head")).withColumn("__top", F.shiftright("__up", shift))
    top_edges = tops.select("__up", F.lead("__head").over(Window.partitionBy("__top").orderBy("__up")).alias("__head"))
    both = upper.withColumn("__edge", F.lit(0)).unionByName(
        top_edges.where("__head IS NOT NULL").withColumns({"__range": F.lit(None).cast("long"), "__edge": F.lit(1)})
    )
    in_upper = Window.partitionBy("__up").orderBy("__edge", "__range")
    edges = both.withColumn("__next_head", F.lead("__head").over(in_upper)).where("__edge = 0 AND __next_head IS NOT NULL")
    edge_rows = edges.select("__range", F.col("__next_head").alias(number), F.lit(1).alias("__edge"))
    rows = ranged.withColumn("__edge", F.lit(0)).unionByName(edge_rows, allowMissingColumns=True)
    in_range = Window.partitionBy("__range").orderBy(number)
    return rows.withColumn("__next", F.lead(number).over(in_range)).where("__edge = 0").drop("__edge", "__range")


def resample(
    df: DataFrame,
    column: str = "timestamp",
    freq: str = "1H",
    method: str | dict[str, str] = "mean",
    by: Sequence[str] = (),
    values: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Aggregate into bins and add the empty bins between the first and last one.

    Empty bins give null, or 0 for ``sum`` and ``count``. With ``by`` every group gets its
    own first and last bin on one common grid. Rows without a time are dropped.
    """
    by = list(by)
    if isinstance(method, dict):
        values = list(method)
    values = list(values or [c for c in df.columns if c != column and c not in by])
    how = method if isinstance(method, dict) else {v: method for v in values}
    text = {v for v in values if isinstance(df.schema[v].dataType, T.StringType)}
    for v in values:
        if v in text and how[v] in NUMERIC_ONLY:
            raise ValueError(f"{how[v]} needs numbers, {v} is text")
    order = list(order or [column])
    extra = [o for o in order if o not in (column, *by, *values)]
    timed = (
        df.withColumn(column, as_timestamp(df, column))
        .where(F.col(column).isNotNull())
        .select(column, *by, *values, *extra)
    )
    grid = grid_for(timed, column, freq)
    if grid is None:
        return timed.select(column, *by, *values).limit(0)
    number = "__bin"
    binned = timed.withColumn(number, grid.bin_of(F.col(column)))
    keys = [*by, number]
    medians = [v for v in values if how[v] == "median"]
    plain = [_aggregate(how[v], v, v in text, order).alias(v) for v in values if v not in medians]
    grouped = binned.groupBy(*keys).agg(F.count("*").alias("__rows"), *plain)
    out = with_empty_bins(grouped, by, number, [v for v in values if v not in medians])
    for v in medians:
        out = _left(out, grouped_quantiles(binned, keys, v, {v: 0.5}), keys)
    zero = {"sum": 0.0, "count": 0}
    filled = [
        F.coalesce(F.col(v), F.lit(zero[how[v]])).alias(v) if how[v] in zero else F.col(v)
        for v in values
    ]
    return out.select(grid.label(F.col(number)).alias(column), *by, *filled)


def _left(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on keys that may be null."""
    marked = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(marked, same, "left").drop(*[f"__r_{k}" for k in keys])


def ohlcv_bars(
    df: DataFrame,
    column: str,
    value: str,
    freq: str = "1D",
    by: Sequence[str] = (),
    volume: str | None = None,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Open, high, low, close and volume per bin that has data; ``up`` where close >= open."""
    order = list(order or [column])
    rank = F.struct(*[F.col(o) for o in order])
    timed = df.withColumn(column, as_timestamp(df, column)).where(F.col(column).isNotNull())
    grid = grid_for(timed, column, freq)
    if grid is None:
        raise ValueError("no row has a time")
    bars = timed.groupBy(*by, grid.bin_of(F.col(column)).alias("__bin")).agg(
        F.min_by(value, rank).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, rank).alias("close"),
        F.sum(volume or value).alias("vol"),
    )
    labelled = bars.withColumn(column, grid.label(F.col("__bin")))
    return with_direction(labelled.select(*by, column, "open", "high", "low", "close", "vol"))


def with_direction(df: DataFrame) -> DataFrame:
    return df.withColumn("up", F.col("close") >= F.col("open"))
