"""Forecasts with a trend that may bend, and smooth seasons: ridge regression on mergeable sums.

Features are a line, a hinge at each change point and sine and cosine terms. All that a fit needs are the sums
of their products, which batches add up on their own and one grouping merges; a model is a row per series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.forecast.trend import Z80
from tidewell.operators.resample import SPINE_BLOCK, parse_frequency

#: added to the squares of level and slope, so that a series of one point has a model
LEAST_RIDGE = 1e-6


class Terms:
    """The features of a row: level, slope, hinges, and for each season its waves."""

    def __init__(self, changepoints: int, share: float, seasons: Sequence[tuple[float, int]], ridge: float):
        self.bends = [share * j / changepoints for j in range(1, changepoints + 1)]
        self.waves = [(period, f) for period, count in seasons for f in range(1, count + 1)]
        self.size = 2 + len(self.bends) + 2 * len(self.waves)
        self.ridge = np.array([LEAST_RIDGE] * 2 + [ridge] * (self.size - 2))

    def arrays(self, part: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Rows of features, by the share of the history that has passed and the number of the time step."""
        turns = [2 * math.pi * f * np.mod(step, period) / period for period, f in self.waves]
        hinges = [np.maximum(part - b, 0.0) for b in self.bends]
        return np.stack([np.ones_like(part), part, *hinges, *[g(x) for x in turns for g in (np.sin, np.cos)]], axis=1)

    def columns(self, part: Column, step: Column) -> list[Column]:
        """The same as columns."""
        turns = [2 * math.pi * f * (step - F.floor(step / period) * period) / period for period, f in self.waves]
        hinges = [F.greatest(part - b, F.lit(0.0)) for b in self.bends]
        return [F.lit(1.0), part, *hinges, *[g(x) for x in turns for g in (F.sin, F.cos)]]


def _sums(terms: Terms):
    """Per batch and series: the sums of products of features, of features with y, of y squared, and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch["name"].dictionary_encode()
            code = names.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            y = batch["y"].to_numpy(zero_copy_only=False)[order]
            x = terms.arrays(*(batch[c].to_numpy(zero_copy_only=False)[order] for c in ("part", "step")))
            own, start = np.unique(code[order], return_index=True)
            wide = np.concatenate([x, y[:, None]], axis=1)
            ends = np.append(start[1:], len(y))
            values = [np.append((w := wide[a:b]).T @ w, b - a) for a, b in zip(start, ends, strict=True)]
            count = len(values[0])
            yield pa.RecordBatch.from_arrays(
                [
                    names.dictionary.take(pa.array(np.repeat(own, count))).cast(pa.string()),
                    pa.array(np.tile(np.arange(count, dtype=np.int32), len(own))),
                    pa.array(np.concatenate(values)),
                ],
                ["name", "at", "value"],
            )

    return run


def _solved(terms: Terms):
    kind = pa.struct([("beta", pa.list_(pa.float64())), ("sigma", pa.float64())])

    def run(sums: pa.Array) -> pa.Array:
        out = []
        for own in sums.to_pylist():
            k, n = terms.size, own[-1]
            both = np.array(own[:-1]).reshape(k + 1, k + 1)
            a, b = both[:k, :k], both[:k, k]
            beta = np.linalg.solve(a + np.diag(terms.ridge), b)
            rest = both[k, k] - 2 * beta @ b + beta @ a @ beta
            out.append({"beta": beta.tolist(), "sigma": math.sqrt(max(rest, 0.0) / max(n - k, 1))})
        return pa.array(out, kind)

    return F.arrow_udf(run, "beta array<double>, sigma double")


def forecast_changepoints(
    df: DataFrame,
    periods: int = 30,
    frequency: str = "D",
    changepoints: int = 10,
    share: float = 0.8,
    seasons: Sequence[tuple[float, int]] = ((7, 3),),
    ridge: float = 0.1,
    by: str = "series_id",
) -> DataFrame:
    """History and ``periods`` future rows: (series, ds, yhat, yhat_lower, yhat_upper).

    ``df`` holds (series, ds, y). The trend may change its slope at ``changepoints`` evenly placed in the first
    ``share`` of each history; a season is (length in grid steps, number of waves). ``ridge`` is added to the
    squares of changes and waves. Rows without y are forecast and not fitted; rows without a time take no
    part; rows without a series are one series. A series without any y has null forecasts.
    """
    unit, width = parse_frequency(frequency)
    if unit != "seconds":
        raise ValueError("use a fixed step: seconds, minutes, hours or days")
    terms = Terms(changepoints, share, seasons, ridge)
    rows = df.where(F.col("ds").isNotNull()).select(F.col(by).cast("string").alias("name"), "ds", F.col("y").cast("double").alias("y"))
    known = F.col("y").isNotNull() & ~F.isnan("y")
    spans = rows.groupBy("name").agg(
        F.min(F.when(known, F.unix_micros("ds"))).alias("first"), F.max(F.when(known, F.unix_micros("ds"))).alias("last"),
        F.max("ds").alias("last_ds"),
    )
    at = F.unix_micros("ds")
    part = F.coalesce(F.try_divide((at - F.col("first")).cast("double"), (F.col("last") - F.col("first")).cast("double")), F.lit(0.0))
    step = at / 1e6 / width

    def placed(wanted: DataFrame, models: DataFrame) -> DataFrame:
        other = models.withColumnRenamed("name", "_name")
        return wanted.join(other, F.col("name").eqNullSafe(F.col("_name"))).drop("_name").withColumns({"part": part, "step": step})

    key = F.coalesce(F.concat(F.lit("="), "name"), F.lit("")).alias("name")  # a series without a name is a key too
    fitted = placed(rows.where(known), spans).select(key, "part", "step", "y")
    sums = fitted.mapInArrow(_sums(terms), "name string, at int, value double").groupBy("name", "at").agg(F.sum("value").alias("value"))
    own = sums.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("sums"))
    named = F.when(F.col("name") != "", F.substr("name", F.lit(2))).alias("name")
    models = own.select(named, _solved(terms)(F.transform("sums", lambda s: s["value"])).alias("m")).select("name", "m.*")
    models = spans.join(models.withColumnRenamed("name", "_name"), F.col("name").eqNullSafe(F.col("_name")), "left").drop("_name")
    blocks = spans.select("name", "last_ds", F.explode(F.sequence(F.lit(0), F.lit((periods - 1) // SPINE_BLOCK))).alias("b"))
    steps = F.sequence(F.col("b") * SPINE_BLOCK + 1, F.least((F.col("b") + 1) * SPINE_BLOCK, F.lit(periods)))
    ahead = blocks.select("name", "last_ds", F.explode(steps).alias("i")).select(
        "name", F.timestamp_micros(F.unix_micros("last_ds") + F.col("i").cast("long") * width * 1_000_000).alias("ds")
    )
    wanted = rows.select("name", "ds") if periods < 1 else rows.select("name", "ds").unionByName(ahead)
    out = placed(wanted, models)
    yhat = sum((F.get("beta", F.lit(i)) * x for i, x in enumerate(terms.columns(F.col("part"), F.col("step")))), F.lit(0.0))
    margin = Z80 * F.col("sigma")
    return out.withColumn("yhat", yhat).select(
        F.col("name").alias(by), "ds", "yhat", (F.col("yhat") - margin).alias("yhat_lower"), (F.col("yhat") + margin).alias("yhat_upper")
    )
