"""Leaf-wise boosting against a plain version that tries every split of every leaf."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidewell.forecast import boosting


def naive_tree(x, y, leaves, least):
    """Values of the rows: the split of the largest gain of any leaf first, missing ones on the better side."""

    def best(rows):
        top = (1e-9, None, None)
        for f in range(x.shape[1]):
            own = x[rows, f]
            for threshold in np.unique(own[~np.isnan(own)]):
                for missing_left in (True, False):
                    goes = np.where(np.isnan(own), missing_left, own <= threshold)
                    a, b = rows[goes], rows[~goes]
                    if min(len(a), len(b)) >= least:
                        gain = y[a].sum() ** 2 / len(a) + y[b].sum() ** 2 / len(b) - y[rows].sum() ** 2 / len(rows)
                        if gain > top[0] * (1 + 1e-9):
                            top = (gain, a, b)
        return top

    parts = [(*best(np.arange(len(y))), np.arange(len(y)))]
    while len(parts) < leaves:
        k = max(range(len(parts)), key=lambda i: parts[i][0])
        if parts[k][1] is None:
            break
        _, a, b, _ = parts.pop(k)
        parts += [(*best(a), a), (*best(b), b)]
    out = np.zeros(len(y))
    for *_, rows in parts:
        out[rows] = y[rows].mean()
    return out


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    x[rng.random((400, 3)) < 0.1] = np.nan
    y = np.where(x[:, 0] > 7, 30.0, 0.0) + np.nan_to_num(x[:, 1], nan=20.0) * np.where(x[:, 2] > 4, 3, -1) + rng.normal(0, 1, 400)
    return x, y


@pytest.mark.parametrize("leaves, least", [(2, 1), (8, 20), (31, 5)])
def test_trees_equal_the_plain_version(spark, numbers, leaves, least):
    x, y = numbers
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, id=range(len(y)))
    df = spark.createDataFrame(pdf).repartition(3)
    model = boosting.boost(df, ["a", "b", "c"], "y", rounds=2, leaves=leaves, rate=0.5, least_rows=least)
    want = np.full(len(y), y.mean())
    for _ in range(2):
        want += 0.5 * naive_tree(x, y - want, leaves, least)
    got = model.predict(df).toPandas().sort_values("id")["prediction"].to_numpy()
    assert got == pytest.approx(want)
    assert sum(f < 0 for f in model.trees[0].feature) == leaves
    assert sum(model.importance().values()) == pytest.approx(1)


def test_expression_and_arrays_of_a_tree_agree(spark, numbers):
    x, y = numbers
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y))
    model = boosting.boost(df, ["a", "b", "c"], "y", rounds=1, leaves=20, least_rows=3)
    coded = boosting._coded(df, ["a", "b", "c"], model.edges)
    rows = coded.select("__c0", "__c1", "__c2", model.trees[0].column().alias("v")).toPandas()
    assert model.trees[0].values(rows[["__c0", "__c1", "__c2"]].to_numpy()) == pytest.approx(rows["v"].to_numpy())


def test_error_is_below_that_of_trees_that_grow_by_depth(spark):
    rng = np.random.default_rng(9)
    x = rng.random((4000, 2)).round(3)
    # all that varies lies in one corner, which takes more than five splits in a row
    y = np.where((x[:, 0] > 0.8) & (x[:, 1] > 0.8), np.floor(x[:, 0] * 100) % 7 * 5 + np.floor(x[:, 1] * 50) % 3, 0.0)
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(y=y))
    # one tree each, as the first tree of Spark counts in full whatever the step size; depth 5 allows 32 leaves
    model = boosting.boost(df, ["a", "b"], "y", rounds=1, leaves=32, rate=1.0, least_rows=1)
    ours = model.predict(df).agg(F.avg((F.col("y") - F.col("prediction")) ** 2)).first()[0] ** 0.5
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df).withColumn("label", F.col("y"))
    spark_trees = GBTRegressor(maxIter=1, maxDepth=5, seed=1, maxBins=255).fit(rows)
    theirs = RegressionEvaluator(metricName="rmse").evaluate(spark_trees.transform(rows))
    assert ours < theirs


def test_odd_tables(spark):
    schema = "a double, b double, y double, id long"
    empty = spark.createDataFrame([], schema)
    assert boosting.boost(empty, ["a"], "y").trees == []
    rows = [(None, 1.0, 5.0, 1), (float("nan"), float("inf"), 5.0, 2), (1.0, None, None, 3), (2.0, 2.0, float("nan"), 4)]
    df = spark.createDataFrame(rows, schema)
    model = boosting.boost(df, ["a", "b"], "y", rounds=3)
    assert model.trees == [] and {r.prediction for r in model.predict(df).collect()} == {5.0}
    fitted = boosting.leafwise_trees(df, ["a", "b"], "y", ["id"], last=2, rounds=2)
    assert [r.id for r in fitted.predictions.collect()] == [4, 3]
