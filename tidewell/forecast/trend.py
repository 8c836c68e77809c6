"""Per-series forecasts from a linear trend with seasonal levels.

The model ``y = level[season] + slope * t`` has a closed least-squares form in sums per
(series, season). Spark's mergeable regression aggregates compute them with partial
aggregation, so a long series is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators.resample import SPINE_BLOCK, parse_frequency

# Fixed value: normal quantile of an 80 % interval.
Z80 = 1.2815515655446004


def fit(df: DataFrame, season_length: int, origin: int, width: int, by: str = "series_id") -> DataFrame:
    """One row per (series, season): slope, centre of the season, residual deviation."""
    t = ((F.unix_micros("ds") / 1e6 - origin) / width).alias("t")
    placed = df.where(F.col("ds").isNotNull() & F.col("y").isNotNull()).select(
        by, t, F.col("y").cast("double").alias("y"), "ds"
    )
    season = F.pmod(F.floor("t"), F.lit(season_length)).cast("long")
    per_season = placed.groupBy(by, season.alias("season")).agg(
        F.regr_count("y", "t").alias("n"),
        F.regr_avgx("y", "t").alias("mean_t"),
        F.regr_avgy("y", "t").alias("mean_y"),
        F.regr_sxx("y", "t").alias("sxx"),
        F.regr_sxy("y", "t").alias("sxy"),
        F.regr_syy("y", "t").alias("syy"),
        F.max("ds").alias("last_ds"),
    )
    whole = per_season.groupBy(by).agg(
        F.sum("sxx").alias("xx"), F.sum("sxy").alias("xy"), F.sum("syy").alias("yy"),
        F.sum("n").alias("rows"), F.count("*").alias("seasons"), F.max("last_ds").alias("last_ds"),
        F.avg("mean_y").alias("base"),
    )
    slope = F.coalesce(F.try_divide("xy", "xx"), F.lit(0.0))
    free = F.greatest(F.col("rows") - F.col("seasons") - 1, F.lit(1))
    spread = F.sqrt(F.greatest(F.col("yy") - slope * F.col("xy"), F.lit(0.0)) / free)
    return per_season.drop("last_ds").join(
        whole.select(by, slope.alias("slope"), spread.alias("sigma"), "last_ds"), by
    )


def forecast(
    df: DataFrame, periods: int = 30, frequency: str = "D", season_length: int = 7, by: str = "series_id"
) -> DataFrame:
    """History and ``periods`` future rows: (series, ds, yhat, yhat_lower, yhat_upper).

    ``df`` holds (series, ds, y). Seasons count grid steps of the frequency. A season never
    seen takes the series' mean level along the trend.
    """
    unit, width = parse_frequency(frequency)
    if unit != "seconds":
        raise ValueError("use a fixed step: seconds, minutes, hours or days")
    origin = 0
    model = fit(df, season_length, origin, width, by)
    ends = model.groupBy(by).agg(F.max("last_ds").alias("last_ds"))
    blocks = ends.select(
        by, "last_ds", F.explode(F.sequence(F.lit(0), F.lit((periods - 1) // SPINE_BLOCK))).alias("b")
    )
    steps = blocks.select(
        by, "last_ds",
        F.explode(
            F.sequence(F.col("b") * SPINE_BLOCK + 1, F.least((F.col("b") + 1) * SPINE_BLOCK, F.lit(periods)))
        ).alias("i"),
    )
    ahead = steps.select(
        by, F.timestamp_micros(F.unix_micros("last_ds") + F.col("i").cast("long") * width * 1_000_000).alias("ds")
    )
    wanted = df.where(F.col("ds").isNotNull()).select(by, "ds").unionByName(ahead)
    t = (F.unix_micros("ds") / 1e6 - origin) / width
    placed = wanted.withColumn("t", t).withColumn(
        "season", F.pmod(F.floor("t"), F.lit(season_length)).cast("long")
    )
    levels = model.groupBy(by).agg(
        (F.sum(F.col("mean_y") * F.col("n")) / F.sum("n")).alias("all_y"),
        (F.sum(F.col("mean_t") * F.col("n")) / F.sum("n")).alias("all_t"),
        F.max("slope").alias("all_slope"), F.max("sigma").alias("all_sigma"),
    )
    joined = placed.join(levels, by).join(
        model.select(by, "season", "mean_t", "mean_y"), [by, "season"], "left"
    )
    centre_y, centre_t = F.coalesce("mean_y", "all_y"), F.coalesce("mean_t", "all_t")
    yhat = centre_y + F.col("all_slope") * (F.col("t") - centre_t)
    margin = Z80 * F.col("all_sigma")
    return joined.select(
        by, "ds", yhat.alias("yhat"), (yhat - margin).alias("yhat_lower"), (yhat + margin).alias("yhat_upper")
    )
