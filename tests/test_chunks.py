"""Chunked evaluation must equal the plain one, also when one series holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell.operators import limiter, missing, reshape
from tidewell.operators import resample as resampling
from tidewell.operators.steps import clean
from tidewell.plans import chunking, quantiles

ORDER = ["ts", "id"]


@pytest.fixture(scope="module")
def skewed(spark):
    """One hot series, bursts of equal times, null keys and long runs of missing values."""
    rng = np.random.default_rng(3)
    n = 1500
    series = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c", ""], n))
    seconds = np.sort(rng.integers(0, 4000, n)) // 7 * 7
    value = np.where(rng.random(n) < 0.6, np.nan, rng.integers(0, 50, n).astype(float))
    value[200:420] = np.nan
    pdf = pd.DataFrame(
        {
            "id": np.arange(n),
            "s": [None if s == "" else s for s in series],
            "ts": pd.Timestamp("2024-03-01") + pd.to_timedelta(seconds, unit="s"),
            "v": value,
        }
    )
    df = spark.createDataFrame(pdf, "id long, s string, ts timestamp, v double").withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return df.cache()


def rows(df, key="id"):
    return df.orderBy(key).toPandas()


@pytest.mark.parametrize("by", [["s"], []])
@pytest.mark.parametrize("method", ["linear", "time", "nearest", "ffill", "bfill"])
def test_interpolation(skewed, by, method):
    bounds = chunking.chunk_bounds(skewed, "ts", 100)
    assert len(bounds) > 8
    plain = missing.interpolate(skewed, ["v"], ORDER, by, method, bounds=[])
    cut = missing.interpolate(skewed, ["v"], ORDER, by, method, bounds=bounds)
    pd.testing.assert_frame_equal(rows(plain), rows(cut))


@pytest.mark.parametrize("by", [["s"], []])
def test_positions(skewed, by):
    bounds = chunking.chunk_bounds(skewed, "ts", 100)
    plain = chunking.row_positions(skewed, ORDER, by, bounds=[])
    cut = chunking.row_positions(skewed, ORDER, by, bounds=bounds)
    pd.testing.assert_frame_equal(rows(plain), rows(cut)[plain.columns])


def test_no_task_sees_a_whole_hot_series(skewed):
    bounds = chunking.chunk_bounds(skewed, "ts", 100)
    sizes = chunking.with_chunk(skewed, "ts", bounds).groupBy("s", chunking.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] < 250


@pytest.fixture(scope="module")
def tied(skewed):
    """Half the rows share one day, a fifth have none."""
    day = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 2 == 0, F.lit("2024-03-05")).otherwise(
        F.date_add(F.lit("2024-03-01").cast("date"), (F.col("id") % 11).cast("int")).cast("string")
    )
    return skewed.withColumn("ts", day).cache()


@pytest.mark.parametrize("kind", ["timestamp", "date", "string", "double"])
def test_equal_first_keys_are_cut_along_the_second(tied, kind):
    first = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") if kind == "double" else F.col("ts").cast(kind)
    df = tied.withColumn("ts", first)
    bounds = chunking.chunk_bounds(df, ORDER, 100)
    assert -1 in bounds.inner and len(bounds.inner) > 1
    cut = chunking.with_chunk(df, ORDER, bounds)
    assert cut.groupBy(chunking.CHUNK).count().agg(F.max("count")).first()[0] < 250
    spans = cut.groupBy(chunking.CHUNK).agg(F.min(F.struct(*ORDER)).alias("lo"), F.max(F.struct(*ORDER)).alias("hi"))
    ends = [(r["lo"], r["hi"]) for r in spans.orderBy(chunking.CHUNK).collect()]
    flat = [tuple((x is not None, x or 0) for x in e) for pair in ends for e in pair]
    assert flat == sorted(flat)
    for by in (["s"], []):
        for method in ("linear", "nearest", "ffill", "bfill"):
            plain = missing.interpolate(df, ["v"], ORDER, by, method, bounds=[])
            pd.testing.assert_frame_equal(rows(plain), rows(missing.interpolate(df, ["v"], ORDER, by, method, bounds=bounds)))


def test_missing_first_keys_alone_are_cut(spark):
    df = spark.range(400).select(F.lit(None).cast("timestamp").alias("ts"), "id", (F.col("id") % 7).alias("v"))
    bounds = chunking.chunk_bounds(df, ORDER, 50)
    assert bounds and not len(bounds)
    assert chunking.with_chunk(df, ORDER, bounds).groupBy(chunking.CHUNK).count().agg(F.max("count")).first()[0] < 120
    assert [r.position for r in chunking.row_positions(df, ORDER, bounds=bounds).orderBy("id").collect()] == list(range(1, 401))


def test_large_keys_that_doubles_cannot_tell_apart_stay_together(spark):
    df = spark.range(400).select((F.lit(2**60) + F.col("id") % 3).alias("ts"), (-F.col("id")).alias("id"))
    bounds = chunking.chunk_bounds(df, ORDER, 50)
    assert not bounds.inner


def test_more_chunks_than_one_aggregate_gives(skewed, monkeypatch):
    monkeypatch.setattr(chunking, "MAX_CHUNKS", 4)
    bounds = chunking.chunk_bounds(skewed, ORDER, 50)
    assert len(bounds) > 20
    sizes = chunking.with_chunk(skewed, ORDER, bounds).groupBy(chunking.CHUNK).count()
    assert sizes.agg(F.max("count")).first()[0] < 150
    plain = missing.interpolate(skewed, ["v"], ORDER, ["s"], "linear", bounds=[])
    pd.testing.assert_frame_equal(rows(plain), rows(missing.interpolate(skewed, ["v"], ORDER, ["s"], "linear", bounds=bounds)))


def test_all_columns_and_ranks_at_once(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {
            "a": rng.normal(size=5000),
            "b": rng.integers(0, 3, 5000).astype(float),
            "c": np.where(rng.random(5000) < 0.5, np.nan, rng.random(5000)),
            "d": [1e300] * 5000,
        }
    )
    probs = [0, 0.01, 0.25, 0.5, 0.99, 1.0]
    df = spark.createDataFrame(pdf)
    for small in (0, 100, 20_000):
        got = quantiles.exact_quantiles(df, list("abcd"), probs, small)
        for c in "abcd":
            assert got[c] == pytest.approx(pdf[c].quantile(probs).tolist())
    ends = spark.createDataFrame([(float("-inf"),)] * 90 + [(float(k),) for k in range(20)] + [(float("inf"),)] * 90, "v double")
    assert quantiles.exact_quantiles(ends, ["v"], [0.0, 0.5, 1.0], 0)["v"] == [float("-inf"), 9.5, float("inf")]


def test_next_bins_across_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    numbers = sorted(rng.choice(np.arange(-2000, 2000), 300, replace=False).tolist())
    df = spark.createDataFrame([(n, float(n)) for n in numbers], "b long, v double")
    for size in (1 << 16, 1 << 4):
        monkeypatch.setattr(resampling, "NEXT_RANGE", size)
        ahead = resampling._with_next_bin(df, "b")
        assert {r.b: r["__next"] for r in ahead.collect()} == dict(zip(numbers, [*numbers[1:], None], strict=True))
        assert "SinglePartition" not in ahead._jdf.queryExecution().executedPlan().toString()
    assert resampling.with_empty_bins(df, [], "b", ["v"]).count() == numbers[-1] - numbers[0] + 1


def replay(events, window, limit):
    """The limiter, one event after the other."""
    opened, used, out = {}, {}, {}
    for e in sorted(events, key=lambda e: (e["ts"], e["id"])):
        k = e["s"]
        if k not in opened or (e["ts"] - opened[k]).total_seconds() >= window:
            opened[k], used[k] = e["ts"], 0
        used[k] += 1
        out[e["id"]] = (opened[k], used[k] <= limit, max(limit - used[k], 0))
    return out


@pytest.mark.parametrize("window", [10, 70, 500])
@pytest.mark.parametrize("size", [None, 90])
def test_fixed_window_equals_replay(skewed, window, size):
    events = skewed.where(F.col("s").isNotNull())
    bounds = chunking.chunk_bounds(events, "ts", size) if size else []
    got = limiter.fixed_window(events, "s", "ts", 3, window, ["id"], bounds).collect()
    want = replay([r.asDict() for r in events.collect()], window, 3)
    assert {r["id"]: (r["window_start"], r["allowed"], r["remaining"]) for r in got} == want


@pytest.mark.parametrize("size", [None, 90])
def test_quiet_gap_equals_replay(skewed, size):
    events = skewed.where(F.col("s").isNotNull())
    bounds = chunking.chunk_bounds(events, "ts", size) if size else []
    got = limiter.quiet_gap(events, "s", "ts", 2, 30, ["id"], bounds).collect()
    last, count, want = {}, {}, {}
    for e in sorted((r.asDict() for r in events.collect()), key=lambda e: (e["ts"], e["id"])):
        k = e["s"]
        quiet = k not in last or (e["ts"] - last[k]).total_seconds() >= 30
        count[k] = 1 if quiet else count[k] + 1
        last[k] = e["ts"]
        want[e["id"]] = count[k] <= 2
    assert {r["id"]: r["allowed"] for r in got} == want


def test_quantiles_by_brackets(spark):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(20_000) < 0.4, 7.25, rng.normal(0, 100, 20_000).round(2))
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    probs = [0.0, 0.1, 0.25, 0.5, 0.501, 0.75, 1.0]
    want = pd.Series(values).quantile(probs).tolist()
    assert quantiles.exact_quantiles(df, ["v"], probs, small_rows=50)["v"] == pytest.approx(want)
    assert quantiles.exact_quantiles(df, ["v"], probs)["v"] == pytest.approx(want)


@pytest.mark.parametrize("size", [None, 60])
def test_grouped_quantiles(skewed, size):
    bounds = chunking.chunk_bounds(skewed.where("v is not null"), "v", size) if size else []
    got = quantiles.grouped_quantiles(skewed, ["s"], "v", {"q1": 0.25, "med": 0.5}, bounds).toPandas()
    want = skewed.toPandas().groupby("s", dropna=False)["v"].quantile([0.25, 0.5]).unstack()
    assert len(got) == len(want)
    for _, r in got.iterrows():
        w = want.loc[[r["s"]]] if r["s"] is not None else want[want.index.isna()]
        assert (r["q1"], r["med"]) == pytest.approx(tuple(w.iloc[0]))


@pytest.mark.parametrize("size", [None, 100])
def test_arrays_are_bounded_and_whole(skewed, size):
    value = F.create_map(F.lit("v"), F.struct(F.col("v").alias("num"), F.col("v").cast("string").alias("raw")))
    records = skewed.select(F.col("s").alias("series_id"), F.col("ts").alias("timestamp"), value.alias("measurements"))
    bounds = chunking.chunk_bounds(records, "timestamp", size) if size else []
    got = reshape.aligned_arrays(records, ["v"], "day", 50, bounds).toPandas()
    assert got["timestamps"].map(len).max() == 50
    assert got["timestamps"].map(len).sum() == skewed.count()
    assert all(list(t) == sorted(t) for t in got["timestamps"])


@pytest.mark.parametrize("by", [["s"], []])
@pytest.mark.parametrize("method", ["linear", "ffill", "bfill"])
def test_text_order_keys_work_at_any_size(skewed, by, method, monkeypatch):
    texts = skewed.withColumn("ts", F.date_format("ts", "yyyy-M-d HH:m:s"))
    plain = missing.interpolate(texts, ["v"], ORDER, by, method, bounds=[])
    monkeypatch.setattr(chunking, "ROWS_PER_CHUNK", 100)
    assert len(chunking.chunk_bounds(texts, "ts")) > 8
    cut = missing.interpolate(texts, ["v"], ORDER, by, method)
    pd.testing.assert_frame_equal(rows(plain), rows(cut))


def test_cut_points_of_texts(spark, monkeypatch):
    keys = [f"{i:04d}é" for i in range(500)]
    df = spark.createDataFrame([(k,) for k in [*keys, None, ""]], "k string")
    bounds = keys[1::3]
    got = {r["k"]: r[chunking.CHUNK] for r in chunking.with_chunk(df, "k", bounds).collect()}
    assert got == {None: -1, "": 0, **{k: sum(b <= k for b in bounds) for k in keys}}


def test_cleaning_steps_apply_above_the_chunk_size(skewed, monkeypatch):
    texts = skewed.withColumn("ts", F.col("ts").cast("string"))
    monkeypatch.setattr(chunking, "ROWS_PER_CHUNK", 100)
    done = clean(texts, [{"operation": "fill_na", "params": {"method": "ffill"}}], ORDER, ["s"])
    assert [r.applied for r in done.report] == [True]
