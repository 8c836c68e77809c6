"""Exact linear-interpolated quantiles whose memory does not grow with the data.

Spark's ``percentile`` is exact but keeps every distinct value of a group in one task.
``exact_quantiles`` uses it only below a checked row count. Beyond, each round cuts the cells that
hold a wanted rank into finer ones, for all columns and ranks at once: one aggregate gives the cuts,
one counts the cells. What is left in the cells at the end is ranked by running counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import floor, inf, isfinite, nextafter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.plans import chunking

SMALL_ROWS = 2_000_000
CELLS = 512

#: (least value, greatest value, rows below, rows inside)
Cell = tuple[float, float, int, int]


def known(column: str | Column) -> Column:
    """Non-null, non-NaN: pandas treats both as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    small_rows: int | None = None,
) -> dict[str, list[float | None]]:
    """``{column: [quantile, ...]}`` over the non-missing values, equal to pandas ``quantile``.

    The number of jobs does not depend on the number of columns or ranks.
    """
    small_rows = SMALL_ROWS if small_rows is None else small_rows
    numbers = df.select(*[known(c).alias(c) for c in columns])
    counts = numbers.agg(*[F.count(c).alias(c) for c in columns]).first()
    result: dict[str, list[float | None]] = {}
    small = [c for c in columns if counts[c] <= small_rows]
    if small:
        row = numbers.agg(*[F.percentile(c, list(probs)).alias(c) for c in small]).first()
        result.update({c: list(row[c]) if row[c] is not None else [None] * len(probs) for c in small})
    large = [c for c in columns if c not in result]
    if large:
        result.update(_by_ranks(numbers.select(*large), {c: counts[c] for c in large}, probs, small_rows // 100))
    return result


def _by_ranks(df: DataFrame, counts: dict[str, int], probs: Sequence[float], last_rows: int) -> dict[str, list[float]]:
    """The quantiles of all columns; cells of at most ``last_rows`` rows are ranked value by value."""
    rows = df.toDF(*[f"x{i}" for i in range(len(counts))])
    spots = [[p * (n - 1) for p in probs] for n in counts.values()]
    at: dict[tuple[int, int], float] = {}
    cells: list[dict[Cell, set[int]]] = [
        {(-inf, inf, 0, n): {r for s in own for r in (floor(s), min(floor(s) + 1, n - 1))}}
        for own, n in zip(spots, counts.values(), strict=True)
    ]
    while any(cells):
        narrower = None
        if any(cell[3] > last_rows for own in cells for cell in own):
            narrower = _narrowed(rows, cells, at)
        if narrower is None or narrower == cells:
            at.update(_ranked(rows, cells))
            break
        cells = narrower
    out = {}
    for i, (c, n) in enumerate(counts.items()):
        ends = [(at[i, floor(s)], at[i, min(floor(s) + 1, n - 1)], s - floor(s)) for s in spots[i]]
        out[c] = [low + (high - low) * share if low != high else low for low, high, share in ends]
    return out


def _inside(i: int, cell: Cell) -> Column:
    return F.col(f"x{i}").between(F.lit(cell[0]), F.lit(cell[1]))


def _holding(counted: DataFrame, cells: list[dict[Cell, set[int]]], by: list[str], order: str, below: Column):
    """Rows of ``counted`` (``n`` each) that hold a wanted rank, with ``upto`` and those ``ranks``."""
    along = Window.partitionBy(*by).orderBy(order).rowsBetween(*chunking.FIRST_TO_HERE)
    wanted = F.create_map(
        *[x for i, own in enumerate(cells) if own
          for x in (F.lit(i), F.array(*[F.lit(r).cast("long") for r in sorted(set().union(*own.values()))]))]
    )
    upto = counted.withColumn("upto", below + F.sum("n").over(along))
    ranks = F.filter(wanted[F.col("i")], lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))
    return upto.withColumn("ranks", ranks).where(F.size("ranks") > 0).collect()  # at most one row per rank


def _narrowed(rows: DataFrame, cells: list[dict[Cell, set[int]]], at: dict) -> list[dict[Cell, set[int]]]:
    """Finer cells around all wanted ranks; ranks in a cell of one value are put into ``at``."""
    probs = [k / CELLS for k in range(1, CELLS)]
    cuts = [
        F.percentile_approx(F.when(_inside(i, cell), F.col(f"x{i}")), probs, 20 * CELLS).alias(f"q{i}_{k}")
        for i, own in enumerate(cells) for k, cell in enumerate(own)
    ]
    found = rows.agg(*cuts).first()
    open_columns = [i for i, own in enumerate(cells) if own]
    splits = []
    for i in open_columns:
        ends = {e for low, high, _, _ in cells[i] for e in (low, nextafter(high, inf))} | {nextafter(-inf, inf)}
        edges = [e for k in range(len(cells[i])) for e in found[f"q{i}_{k}"] or []]
        splits.append([-inf, *sorted(e for e in ends | set(chunking.isolate_repeats(edges)) if isfinite(e)), inf])
    cut = Bucketizer(
        splitsArray=splits, inputCols=[f"x{i}" for i in open_columns], outputCols=[f"cell{i}" for i in open_columns],
        handleInvalid="keep",
    ).transform(rows)
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"cell{i}").alias("cell"), F.col(f"x{i}").alias("x")) for i in open_columns])
    counted = (
        cut.select(F.explode(each).alias("c")).select("c.*").where("x IS NOT NULL")
        .groupBy("i", "cell").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    )
    narrower: list[dict[Cell, set[int]]] = [{} for _ in cells]
    for r in _holding(counted, cells, ["i"], "cell", F.lit(0)):
        if r["low"] == r["high"]:
            at.update({(r["i"], rank): r["low"] for rank in r["ranks"]})
        else:
            narrower[r["i"]][r["low"], r["high"], r["upto"] - r["n"], r["n"]] = set(r["ranks"])
    return narrower


def _ranked(rows: DataFrame, cells: list[dict[Cell, set[int]]]) -> dict[tuple[int, int], float]:
    """The values at the wanted ranks, by running counts of the values inside each cell."""
    each = F.array(
        *[F.when(_inside(i, cell), F.struct(F.lit(i).alias("i"), F.lit(cell[2]).cast("long").alias("below"), F.col(f"x{i}").alias("x")))
          for i, own in enumerate(cells) for cell in own]
    )
    counted = rows.select(F.explode(F.array_compact(each)).alias("c")).groupBy("c.i", "c.below", "c.x").agg(F.count("*").alias("n"))
    held = _holding(counted, cells, ["i", "below"], "x", F.col("below"))
    return {(r["i"], rank): r["x"] for r in held for rank in r["ranks"]}


def grouped_quantiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    probs: dict[str, float],
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """One row per ``by`` with the exact quantiles named in ``probs``; no group is held in memory.

    Equal values are counted before the shuffle; ranks come from running counts that are
    cut into chunks along the value, so one heavy group still spreads over many tasks.
    """
    value, count, upto, total = "__v", "__n", "__upto", "__total"
    by = list(by)
    if not by:
        raise ValueError("use exact_quantiles for the whole table")
    values = df.select(*by, known(column).alias(value)).where(F.col(value).isNotNull())
    if bounds is None:
        bounds = chunking.chunk_bounds(values, value)
    counted = values.groupBy(*by, value).agg(F.count("*").alias(count))
    ranked = chunking.running_totals(counted, {upto: F.col(count)}, [value], by, bounds)
    sizes = counted.groupBy(*by).agg(F.sum(count).alias(total))
    # null group keys must meet, hence the null-safe condition
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by]
    joined = ranked.alias("r").join(sizes.alias("s"), same, "inner")
    hits = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col(total) - 1)
        for side, rank in (("lo", F.floor(spot)), ("hi", F.least(F.floor(spot) + 1, F.col(total) - 1))):
            inside = (F.col(upto) > rank) & (F.col(upto) - F.col(count) <= rank)
            hits.append(F.max(F.when(inside, F.col(value))).alias(f"{name}__{side}"))
    picked = joined.groupBy(*[F.col(f"r.{k}").alias(k) for k in by]).agg(
        *hits, F.max(total).alias(total)
    )
    out = [F.col(k) for k in by]
    for name, p in probs.items():
        spot = F.lit(float(p)) * (F.col(total) - 1)
        lo, hi = F.col(f"{name}__lo"), F.col(f"{name}__hi")
        out.append((lo + (hi - lo) * (spot - F.floor(spot))).alias(name))
    return picked.select(*out)
