"""Work that must not be repeated per mention, per cut point, per row of equal codes or per light key."""

import pytest
from pyspark.sql import functions as F

from tidewell.forecast import boosting, models
from tidewell.operators import limiter
from tidewell.operators import records as rec
from tidewell.plans import chunking
from tidewell.sources import formats, protocols


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def accepted(df):
    return rec.split(rec.check_canonical(df)).accepted


def test_a_json_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"series_id": "s", "timestamp": "2024-01-01", "measurements": {"v": 1}}\n')
    out = accepted(formats.read_records(spark, str(tmp_path), "jsonl"))
    assert plan(out).count("parseJson") == 1
    assert [r.series_id for r in out.collect()] == ["s"]


STOOQ = "TICKER,PER,DATE,TIME,OPEN,HIGH,LOW,CLOSE,VOL,OPENINT\nA,D,20240101,000000,1,2,0.5,1.5,7,0\n"


@pytest.mark.parametrize(
    ("fmt", "files"),
    [
        ("csv", ["series_id,timestamp,v\na,2024-01-01,1\n"]),
        ("csv", ["series_id,timestamp,v\na,2024-01-01,1\n", "v,timestamp,series_id\n2,2024-01-02,b\n"]),
        ("txt", ["SYMBOL;DATE;v\na;2024-01-01;1\n", "v|DATE|SYMBOL\n2|2024-01-02|b\n"]),
        ("stooq", [STOOQ]),
    ],
)
def test_filters_do_not_repeat_what_cells_cost(spark, tmp_path, fmt, files):
    for i, content in enumerate(files):
        (tmp_path / f"f{i}.{fmt}").write_text(content)
    out = accepted(formats.read_records(spark, str(tmp_path), fmt))
    filters = [line for line in plan(out).split("\n") if " Filter " in f" {line.lstrip(' +-:*()0123456789')}"]
    assert filters and not any("RLIKE" in line for line in filters)
    assert out.count() == len(files)


def test_a_protocol_line_is_matched_once(spark):
    lines = spark.createDataFrame([('m,a=b t="x \\"q\\" , y = z",k=2i 12000',), ('m t="open 5',)], "value string")
    out = protocols.line_protocol_records(lines)
    assert plan(out).count(protocols._LINE) == 1
    good, bad = out.collect()
    assert good.measurements["t"].raw == 'x "q" , y = z' and good.measurements["k"].num == 2 and good.error is None
    assert bad.error == "Not a line protocol line"


def test_inner_cuts_do_not_grow_the_plan(spark):
    df = spark.range(200).select(F.lit(1.0).alias("a"), F.when(F.col("id") % 9 > 0, F.col("id").cast("double")).alias("b"))
    bounds = chunking.Cuts([1.0, 2.0], {1: [i / 20 for i in range(3000)]})
    cut = chunking.with_chunk(df, ["a", "b"], bounds)
    assert len(plan(cut)) < 5_000
    for r in cut.collect():
        passed = 0 if r.b is None else min(3000, int(r.b * 20) + 1)
        assert r[chunking.CHUNK] == chunking.INNER_CHUNKS + passed


def test_rows_of_equal_codes_are_one_row_for_the_trees(spark, monkeypatch):
    sizes = []
    for module in (boosting, models):
        plain = getattr(module, "written", boosting.written)
        monkeypatch.setattr(module, "written", lambda df, name="x", f=plain: (out := f(df, name), sizes.append(out.count()))[0], raising=False)
    df = spark.range(600).select("id", (F.col("id") % 6).cast("double").alias("a"), (F.col("id") % 6 * 10 + F.col("id") % 7).alias("y"))
    model = boosting.boost(df, ["a"], "y", rounds=2, leaves=4, least_rows=1)
    assert max(sizes) == 6 and model.trees[0].rows[0] == 600
    del sizes[:]
    fitted = models.boosted_trees(df, ["a"], "y", ["id"], 3, rounds=2)
    assert sizes == [12] and fitted.rmse > 0 and fitted.predictions.count() == 3


def test_light_keys_are_not_cut(spark, monkeypatch):
    df = spark.range(900).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 30).alias("k"), F.timestamp_seconds(F.col("id") * 7 % 500).alias("ts"))
    want = limiter.fixed_window(df, "k", "ts", 2, 60, ["id"], []).orderBy("id").collect()
    monkeypatch.setattr(chunking, "ROWS_PER_CHUNK", 100)  # only the null key has more
    assert limiter.fixed_window(df, "k", "ts", 2, 60, ["id"]).orderBy("id").collect() == want
    monkeypatch.setattr(limiter, "_open_on_entry", None)
    light = df.where("k IS NOT NULL")
    assert limiter.fixed_window(light, "k", "ts", 2, 60, ["id"]).orderBy("id").collect() == [r for r in want if r.k is not None]
