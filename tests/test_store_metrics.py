"""Metrics that the store keeps as columns: same answers, filters that reach the files."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators import query, store

SCHEMA = "series_id string, timestamp timestamp, measurements map<string, struct<num: double, raw: string>>, metadata map<string, string>"


def record(series, minute, **numbers):
    held = {k: {"num": v, "raw": str(v)} for k, v in numbers.items()}
    return series, None if minute is None else dt.datetime(2024, 5, 1 + minute % 3, 0, minute % 60), held, {"user": "u"}


@pytest.fixture
def stores(spark, tmp_path):
    """The same records stored with and without promoted metrics, written in two waves."""
    first = spark.createDataFrame([record("a", k, close=float(k), load=1.0) for k in range(40)], SCHEMA)
    late = [record("a", k, close=k + 100.0) for k in range(30, 50)] + [record("b", 5, load=2.0), record("b", None, close=500.0)]
    paths = {}
    for name, metrics in (("plain", ()), ("promoted", ("close", "cpu.load"))):
        paths[name] = str(tmp_path / name)
        store.save(first, paths[name], metrics)
        store.upsert(spark, paths[name], spark.createDataFrame(late, SCHEMA))
    return {name: store.stored(spark, path) for name, path in paths.items()}


def shown(df):
    return sorted(df.select("series_id", F.col("timestamp").cast("string")).collect(), key=repr)


def test_readers_agree(stores):
    plain, promoted = stores["plain"], stores["promoted"]
    assert store.promoted_metrics(promoted) == ["close", "cpu.load"] and plain.count() == promoted.count()
    for name, bound in (("close", 35), ("close", 120), ("load", 0.5), ("cpu.load", 0)):
        assert shown(query.measurement_above(plain, name, bound)) == shown(query.measurement_above(promoted, name, bound))
    for name in ("close", "load", "absent"):
        both = [sorted(query.metric_values(d, name).select("series_id", "value").collect(), key=repr) for d in (plain, promoted)]
        assert both[0] == both[1]
    assert shown(query.ohlcv(plain)) == shown(query.ohlcv(promoted)) == []


def test_filter_reaches_the_files(stores):
    plan = query.measurement_above(stores["promoted"], "close", 35)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(__metric_close,35.0)" in plan
    # what is not projected is not read, so the map stays in the files
    narrow = query.metric_values(stores["promoted"], "close")._jdf.queryExecution().executedPlan().toString()
    assert "measurements" not in narrow
