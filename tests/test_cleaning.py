"""Cleaning steps on small tables with known results."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.functions.condition import BadExpression, column_of
from tidewell.operators import columns, duplicates, missing, outliers, profile
from tidewell.operators.resample import resample
from tidewell.operators.steps import STEPS, clean


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def values(df, column="v", key="i"):
    return [r[column] for r in df.orderBy(key).collect()]


@pytest.fixture(scope="module")
def gaps(spark):
    v = [None, 1.0, None, None, 4.0, None, None]
    return spark.createDataFrame(list(enumerate(v)), "i int, v double")


def test_interpolate_linear(gaps):
    out = missing.interpolate(gaps, ["v"], ["i"], bounds=[])
    assert values(out) == [None, 1.0, 2.0, 3.0, 4.0, 4.0, 4.0]


def test_interpolate_nearest(gaps):
    out = missing.interpolate(gaps, ["v"], ["i"], method="nearest", bounds=[])
    assert values(out) == [None, 1.0, 1.0, 4.0, 4.0, None, None]


def test_fill_both_ways(gaps):
    assert values(missing.fill_along(gaps, ["i"])) == [None, 1.0, 1.0, 1.0, 4.0, 4.0, 4.0]
    assert values(missing.fill_along(gaps, ["i"], backward=True)) == [1.0, 1.0, 4.0, 4.0, 4.0, None, None]


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(0, 2.0), (1, float("nan")), (2, None), (3, 4.0)], "i int, v double")
    assert values(missing.fill_mean(df, ["v"])) == [2.0, 3.0, 3.0, 4.0]
    assert values(missing.fill_along(df, ["i"])) == [2.0, 2.0, 2.0, 4.0]
    assert missing.drop_missing(df).count() == 2


def test_fill_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, None)], "i int, v string")
    assert values(missing.fill_mode(df, ["v"])) == ["b", "a", "a"]
    empty = spark.createDataFrame([(0, None)], "i int, v double")
    assert values(missing.fill_mode(empty, ["v"])) == [0.0]


def test_duplicates_treat_nulls_as_equal(spark):
    df = spark.createDataFrame([(0, None, 1), (1, None, 1), (2, "x", 1), (3, "y", 2), (4, "y", 2)], "i int, a string, b int")
    keep = lambda k: sorted(r["i"] for r in duplicates.remove_duplicates(df, ["a", "b"], k, ["i"]).collect())
    assert keep("first") == [0, 2, 3]
    assert keep("last") == [1, 2, 4]
    assert keep(False) == [2]
    assert duplicates.duplicate_rows(df.drop("i")).first()[0] == 2


def test_duplicates_of_maps(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1)")
    assert duplicates.remove_duplicates(df).count() == 1
    assert duplicates.duplicate_rows(df).first()[0] == 1


def test_iqr_is_sequential(spark):
    pdf = pd.DataFrame({"a": [1, 2, 3, 4, 100, 3, 2, 3], "b": [1, 1, 2, 9, 2, 2, 1, 2]}).astype(float)
    want = pdf
    for c in ("a", "b"):
        q1, q3 = want[c].quantile(0.25), want[c].quantile(0.75)
        want = want[(want[c] >= q1 - 1.5 * (q3 - q1)) & (want[c] <= q3 + 1.5 * (q3 - q1))]
    got = outliers.remove_outliers_iqr(spark.createDataFrame(pdf), ["a", "b"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.values))


def test_zscore_of_a_constant_keeps_nothing(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert outliers.remove_outliers_zscore(df).count() == 0


def test_round_half_even(spark):
    df = spark.createDataFrame([(0, 2.5), (1, 3.5), (2, -2.5)], "i int, v double")
    assert values(columns.round_values(df, ["v"], 0)) == [2.0, 4.0, -2.0]
    df = spark.createDataFrame([(0, 0.125), (1, 0.375), (2, 2.675), (3, 1.005)], "i int, v double")
    assert values(columns.round_values(df, ["v"], 2)) == pd.Series([0.125, 0.375, 2.675, 1.005]).round(2).tolist()


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, -1.0), (2, 9.0)], "i int, v double")
    assert values(columns.clip_values(df, "v", low=0.0)) == [None, 0.0, 9.0]
    assert values(columns.clip_values(df, "v", high=5.0)) == [None, -1.0, 5.0]


@pytest.mark.parametrize(
    ("condition", "kept"),
    [
        ("> 1", [2, 3]), ("!= 2", [0, 1, 3]), ("== 2 or v == 3", [2, 3]), ("in [1, 3]", [1, 3]),
        ("not in [1, 3]", [0, 2]), (">= 1 & v < 3", [1, 2]), ("> 1 and not (v > 2)", [2]),
    ],
)
def test_filter_conditions(spark, condition, kept):
    df = spark.createDataFrame([(0, None), (1, 1.0), (2, 2.0), (3, 3.0)], "i int, v double")
    assert [r["i"] for r in columns.filter_rows(df, "v", condition).orderBy("i").collect()] == kept


@pytest.mark.parametrize("text", ["__import__('os')", "v.real", "f(v)", "unknown > 1", "v >", "[v for v in v]"])
def test_other_expressions_are_refused(spark, text):
    with pytest.raises(BadExpression):
        column_of(text, spark.createDataFrame([(1.0,)], "v double"))


def test_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).withColumn("v", F.col("id") * 1.0).write.parquet(str(tmp_path / "t"))
    plan = columns.filter_rows(spark.read.parquet(str(tmp_path / "t")), "v", "> 3 and id < 8")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(v,3.0)" in text and "LessThan(id,8)" in text


def test_arithmetic(spark):
    df = spark.createDataFrame([(0, -7.0, 2.0), (1, 7.0, -2.0), (2, 1.0, 0.0)], "i int, a double, b double")
    out = df
    for name, text in {"div": "a / b", "whole": "a // b", "rest": "a % b", "power": "a ** 2"}.items():
        out = columns.add_column(out, name, expression=text)
    assert values(out, "div") == [-3.5, -3.5, None]
    assert values(out, "whole") == [-4, -4, None]
    assert values(out, "rest") == [1.0, -1.0, None]
    assert values(out, "power") == [49.0, 49.0, 1.0]


def test_convert_int_refuses_fractions(spark):
    df = spark.createDataFrame([("1",), ("x",), ("2.5",)], "v string")
    with pytest.raises(columns.NotConvertible):
        columns.convert_type(df, "v", "int")
    whole = spark.createDataFrame([(0, "1"), (1, "x"), (2, "2.0"), (3, "1e3")], "i int, v string")
    assert values(columns.convert_type(whole, "v", "int")) == [1, None, 2, 1000]


def test_steps_are_skipped_and_reported(gaps):
    done = clean(
        gaps,
        [
            {"operation": "drop_na", "params": {"subset": ["nope"]}},
            {"operation": "unheard_of"},
            {"operation": "filter_rows", "params": {"column": "v", "condition": "> ("}},
            {"operation": "fill_na", "params": {"method": "value", "value": None}},
            {"operation": "fill_na", "params": {"method": "value", "value": 0.0}},
        ],
        order_by=["i"],
    )
    assert [s.applied for s in done.report] == [False, False, False, False, True]
    assert values(done.df) == [0.0, 1.0, 0.0, 0.0, 4.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        clean(gaps, [{"operation": "drop_na", "params": {"subset": ["nope"]}}], on_error="raise")


def test_all_steps_exist():
    assert len(STEPS) == 14


@pytest.mark.parametrize("freq", ["1h", "7h", "3D", "W", "2W", "ME", "2ME", "QE", "YE", "30min"])
@pytest.mark.parametrize("method", ["mean", "sum", "count", "first", "last", "median", "std", "min", "max"])
def test_resample_equals_pandas(spark, freq, method):
    times = [day(3, 5), day(3, 8), day(9), day(14, 23), day(31, 12), dt.datetime(2024, 2, 29, 3), dt.datetime(2024, 5, 1)]
    pdf = pd.DataFrame({"timestamp": times, "v": [1.0, None, 2.5, 4.0, 8.0, 1.5, None]})
    if freq == "30min":
        pdf = pdf.head(3)
    want = pdf.set_index("timestamp").resample(freq).agg(method).reset_index()
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    got = resample(df, "timestamp", freq, method).orderBy("timestamp").toPandas()
    pd.testing.assert_frame_equal(got, want[got.columns], check_dtype=False)


def test_resample_refuses_means_of_text(spark):
    df = spark.createDataFrame([(day(1), "x")], "timestamp timestamp, v string")
    with pytest.raises(ValueError):
        resample(df, "timestamp", "1D", "mean")


def test_describe_equals_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0, None], "b": [3.0, 3.0, 3.0, 3.0]})
    got = profile.describe_numeric(spark.createDataFrame(pdf)).toPandas().set_index("column_name")
    want = pdf.describe()
    for c in pdf:
        assert got.loc[c, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].tolist() == pytest.approx(want[c].tolist())


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [tuple(r) for r in profile.histogram(df, "v").collect()] == [(0, 2.0, 2)]


def test_long_gaps_are_filled_in_blocks(spark):
    df = spark.createDataFrame([(day(1, 0), 1.0), (day(1, 3), 2.0)], "timestamp timestamp, v double")
    out = resample(df, "timestamp", "1s", "sum")
    total = out.agg(F.count("*"), F.countDistinct("timestamp"), F.sum("v"), F.count_if(F.col("v") == 0)).first()
    assert tuple(total) == (10801, 10801, 3.0, 10799)


def test_resample_scans_once(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(day(1), "a", 1.0)], "timestamp timestamp, s string, v double").write.parquet(path)
    plan = resample(spark.read.parquet(path), "timestamp", "1h", "mean", ["s"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan") == 1 and "Join" not in text


def test_resample_and_interpolate_as_steps(spark):
    df = spark.createDataFrame([(day(1, 0), "a", 1.0), (day(1, 2), "a", 3.0)], "timestamp timestamp, s string, v double")
    done = clean(
        df,
        [{"operation": "resample", "params": {"freq": "1H"}}, {"operation": "interpolate", "params": {}}],
        partition_by=["s"],
    )
    assert [s.applied for s in done.report] == [True, True]
    assert values(done.df, key="timestamp") == [1.0, 2.0, 3.0]
    text = clean(df.drop("v"), [{"operation": "resample", "params": {"freq": "1H"}}])
    assert not text.report[0].applied
