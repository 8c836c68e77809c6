import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import sharding, topk


def brute_top(rows, asked, k, scale=64):
    def own(v):
        if not v or any(x is None or not np.isfinite(x) for x in v):
            return None
        return tuple(int(np.floor(scale * np.float64(np.float32(x)))) for x in v)

    rows = {(i, own(v)) for i, v in rows if i is not None and own(v)}
    out = []
    for q in {i for i, v in asked if i is not None and own(v)}:
        scores = {
            (-sum(x * y for x, y in zip(v, w, strict=True)), i)
            for p, v in rows if p == q for i, w in rows if i != q and len(v) == len(w)
        }
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def vectors(seed, n=160, dims=6, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in (rng.normal(0, spread, dims).astype(np.float32))]) for i in rng.permutation(n)]


@pytest.mark.parametrize(("seed", "spread", "blocks"), [(1, 1.0, 1000), (2, 0.02, 40), (3, 300.0, 17)])
def test_top_k_agrees_with_brute_force(spark, seed, spread, blocks):
    rows = vectors(seed, spread=spread)  # a small spread gives many ties
    rows += [(500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (503, [float("nan")] * 6), (504, [float("inf")] * 6)]
    rows += [(None, [1.0] * 6), (520, [1.0, 2.0]), (540, [3.0, -1.0]), rows[0], rows[1]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 20 = 0")
    got = topk.top_k(df, asked, k=7, rows_per_block=blocks, queries_per_block=3)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, [r for r in rows if r[0] is not None and r[0] % 20 == 0], 7)


def test_fewer_rows_than_k_and_none(spark):
    df = spark.createDataFrame(vectors(4, n=5), "vec_id long, embedding array<float>")
    assert topk.top_k(df, df.where("vec_id = 0"), k=20).count() == 4
    assert topk.top_k(df.limit(0), df.limit(0)).collect() == []


def test_large_components(spark):
    rows = [(i, [x * 3e6 for x in v]) for i, v in vectors(5, n=40)]
    df = spark.createDataFrame([(i, v, "x", i) for i, v in rows], "vec_id long, embedding array<float>, id string, v long")
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows, [r for r in rows if r[0] % 20 == 0], 5)
    for x, said in ((1e9, "does not fit 64 bits"), (1e30, "does not fit 62 bits")):
        df = spark.createDataFrame([(0, [x, x]), (1, [x, 0.0])], "vec_id long, embedding array<double>")
        with pytest.raises(Exception, match=said):
            topk.top_k(df, df).collect()


def test_digits_and_slices():
    for v in range(-300, 300):
        assert sum(s << b for b, s in topk.signed_digits(v)) == v
    rng = np.random.default_rng(1)
    values = rng.integers(-70, 70, (131, 5))
    slices, low, bits = topk.slices_of(values)
    index = topk.BitSlices(np.arange(131), slices, low, bits)
    for q in ([0] * 5, [1, -1, 63, -64, 5], [0, 0, 7, 0, 0]):
        total, constant = index.add(q)
        got = [constant + sum(int(b[i // 64] >> np.uint64(i % 64) & np.uint64(1)) << w for w, b in total.items()) for i in range(131)]
        assert got == (values @ np.array(q)).tolist()


@pytest.mark.parametrize(("limit", "bits"), [(400, 1), (2000, 4), (10**9, 4)])
def test_shards_agree_with_sql(spark, odd_documents, limit, bits):
    rng = random.Random(2)
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(200)] + [(1000, "y" * 5000), (7, "same"), (7, "same")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(odd_documents.select("doc_id", "text"))
    out = sharding.assign_shards(docs, max_bytes=limit, bits_per_round=bits).drop("text")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    result = con.execute(sharding.shard_sql(limit))
    names = [c[0] for c in result.description]
    assert sorted((tuple(r[n] for n in names) for r in out.collect()), key=repr) == sorted(result.fetchall(), key=repr)
    assert out.count() == docs.count()
    for r in out.collect():
        assert r.shard_bytes <= limit or r.oversize


def test_shards_are_prefixes_that_cover_everything(spark, odd_documents, no_documents):
    out = sharding.assign_shards(odd_documents, max_bytes=100).collect()
    shards = {r["shard"] for r in out}
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert sharding.assign_shards(no_documents).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * 50) for i in range(100)], "doc_id long, text string")
    sharding.write_shards(docs, str(tmp_path / "shards"), max_bytes=500)
    back = spark.read.option("basePath", str(tmp_path / "shards")).parquet(str(tmp_path / "shards"))
    assert back.count() == 100
    assert back.selectExpr("sum(octet_length(text)) OVER (PARTITION BY shard) AS b").where("b > 500").isEmpty()


def test_repeated_rows_are_dealt_out(spark, tmp_path):
    """A thousand copies of one row are no shard of their own size."""
    docs = spark.range(0, 1000, 1, 7).select(F.lit(5).cast("long").alias("doc_id"), F.lit("x" * 1000).alias("text"))
    docs = docs.union(spark.range(40).selectExpr("id AS doc_id", "repeat('y', 500) AS text"))
    out = sharding.assign_shards(docs, max_bytes=20_000)
    held = out.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n"), F.max("shard_bytes").alias("said"), F.max("shard_rows").alias("rows"))
    rows = held.collect()
    assert all(r.b <= 20_000 and r.b == r.said and r.n == r["rows"] for r in rows) and sum(r.n for r in rows) == 1040
    names = [r.shard for r in rows]
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert out.where("oversize").isEmpty()
