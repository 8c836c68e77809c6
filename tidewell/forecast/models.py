"""Feature scaling and Spark ML models over feature columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.plans.quantiles import known
from tidewell.session import written

SEED = 42
#: values of a feature that rows are gathered by before trees are grown
VALUES = 256


def scale(df: DataFrame, columns: Sequence[str], scaler: str = "standard") -> DataFrame:
    """``standard`` (sample deviation), ``minmax`` to 0..1, or ``none``; a constant column becomes 0."""
    if scaler == "none":
        return df
    if scaler not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {scaler!r}")
    if scaler == "standard":
        pair = [(F.avg(c), F.stddev_samp(c)) for c in columns]
    else:
        pair = [(F.min(c), F.max(c) - F.min(c)) for c in columns]
    row = df.agg(
        *[a.alias(f"a{i}") for i, (a, _) in enumerate(pair)],
        *[b.alias(f"b{i}") for i, (_, b) in enumerate(pair)],
    ).first()
    scaled = {}
    for i, c in enumerate(columns):
        shift, width = row[f"a{i}"], row[f"b{i}"]
        moved = F.col(c) - F.lit(shift).cast("double")
        scaled[c] = moved / F.lit(float(width)) if width else moved
    return df.withColumns(scaled)


@dataclass
class Regression:
    predictions: DataFrame
    rmse: float
    importance: dict[str, float]
    model: object


def _vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The rows without a null feature, as vectors."""
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(df)


def _predicted(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All rows of ``df`` with ``prediction``, null where a feature is missing."""
    missing = F.lit(False)
    for f in features:
        missing = missing | F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
    known = model.transform(_vectors(df.where(~missing), features)).drop("features")
    return known.unionByName(df.where(missing), allowMissingColumns=True)


def boosted_trees(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    order: Sequence[str],
    last: int = 30,
    rounds: int = 100,
    test_share: float = 0.2,
) -> Regression:
    """Fit on a random 80 % of the labelled rows, measure on the rest, predict the last ``last`` rows of all.

    Rows without a label are predicted too; a row with a missing feature has a null prediction. A feature takes its
    next of at most ``VALUES`` quantiles, all its values if these are few. Rows of equal features are then one for the
    trees, with the mean of their labels and their number as weight, which gives the same splits and leaves.
    """
    features = list(features)
    labelled = df.withColumn("label", F.col(target).cast("double")).dropna(subset=["label"])
    for f in features:
        labelled = labelled.where(known(f).isNotNull())
    train, test = labelled.randomSplit([1 - test_share, test_share], seed=SEED)
    cuts = _cuts(labelled, features)
    sides = [_gathered(part, features, cuts).withColumn("held", F.lit(held)) for part, held in ((train, False), (test, True))]
    gathered = written(sides[0].unionByName(sides[1]), "gathered")
    # depth 5 allows 32 leaves
    trees = GBTRegressor(maxIter=rounds, stepSize=0.05, maxDepth=5, seed=SEED, weightCol="n")
    model = trees.fit(_vectors(gathered.where("NOT held"), features))
    scored = model.transform(_vectors(gathered.where("held"), features))
    squares = F.sum("spread") + F.sum(F.col("n") * (F.col("label") - F.col("prediction")) ** 2)
    squared = scored.agg(squares / F.sum("n")).first()[0]
    rmse = float("nan") if squared is None else sqrt(squared)
    recent = df.orderBy(*[F.desc(o) for o in order]).limit(last)
    names = {f"__f{i}": f for i, f in enumerate(features)}
    snapped = _snapped(recent.withColumns({k: F.col(f) for k, f in names.items()}), features, cuts)
    recent = _predicted(model, snapped, features).drop(*features).withColumnsRenamed(names)
    weights = dict(zip(features, model.featureImportances.toArray().tolist()))
    return Regression(recent.select(*order, "prediction"), rmse, weights, model)


def _cuts(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Up to ``VALUES`` quantiles of each feature, with its greatest value, from one aggregate."""
    probs = [i / VALUES for i in range(1, VALUES)]
    each = [F.percentile_approx(known(f), probs, 20 * VALUES).alias(f"q{i}") for i, f in enumerate(features)]
    row = df.agg(*each, *[F.max(known(f)).alias(f"m{i}") for i, f in enumerate(features)]).first()
    return [sorted({*(row[f"q{i}"] or []), *([] if row[f"m{i}"] is None else [row[f"m{i}"]])}) for i in range(len(features))]


def _snapped(df: DataFrame, features: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """Each feature as the least of its ``cuts`` that is not below it, the greatest beyond them; missing ones stay."""

    def snapped(f: str, own: list[float]) -> Column:
        if not own:
            return known(f)
        passed = F.arrow_udf(lambda x: pa.array(np.searchsorted(own, x.to_numpy(zero_copy_only=False))), "bigint")
        at = F.least(passed(F.coalesce(known(f), F.lit(0.0))), F.lit(len(own) - 1))
        return F.when(known(f).isNotNull(), F.get(F.lit(own), at.cast("int")))

    return df.withColumns({f: snapped(f, own) for f, own in zip(features, cuts, strict=True)})


def _gathered(df: DataFrame, features: Sequence[str], cuts: list[list[float]]) -> DataFrame:
    """One row per values of the features: ``n`` rows, the mean ``label`` and the squares ``spread`` around it."""
    label = F.col("label")
    n = F.count("*").cast("double")
    return _snapped(df.select(*features, "label"), features, cuts).groupBy(*features).agg(
        n.alias("n"), F.avg(label).alias("label"), (F.var_pop(label) * n).alias("spread")
    )


def linear_regression(
    df: DataFrame, features: Sequence[str], target: str, train_share: float = 0.8
) -> Regression:
    """With a ``train_share`` of 1 the model is fitted to, and its error taken over, all rows."""
    rows = _vectors(df.withColumn("label", F.col(target).cast("double")).dropna(subset=["label"]), features)
    train, test = rows.randomSplit([train_share, 1 - train_share], seed=SEED) if train_share < 1 else (rows, rows)
    model = LinearRegression().fit(train)
    predicted = model.transform(test)
    rmse = RegressionEvaluator(metricName="rmse").evaluate(predicted)
    weights = dict(zip(features, model.coefficients.toArray().tolist()))
    return Regression(predicted.select(*features, "label", "prediction"), rmse, weights, model)


def clusters(df: DataFrame, features: Sequence[str], k: int = 3) -> tuple[DataFrame, object]:
    """All rows with ``cluster``, null where a feature is missing."""
    model = KMeans(k=k, seed=SEED).fit(_vectors(df, features))
    return _predicted(model, df, features).withColumnRenamed("prediction", "cluster"), model
