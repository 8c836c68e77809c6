import base64
import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.brute import brute_pipeline_stage
from tidewell.llm import language, packing
from tidewell.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def model(documents):
    return language.fit_languages(documents)


def test_held_out_accuracy(documents, model):
    out = language.identify_languages(documents, model).where(language.held_out())
    rows = out.select("lang", "lang_pred", "score", "rejected").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_held_out_rule(documents):
    ids = documents.select("doc_id", language.held_out().alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in ids)


def test_labels_of_held_out_documents_teach_nothing(documents, model):
    wrong = documents.withColumn("lang", F.when(language.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = language.fit_languages(wrong)
    assert again.languages == model.languages and (again.table == model.table).all()


def test_odd_texts(odd_documents, no_documents, model):
    out = language.identify_languages(odd_documents, model)
    assert out.columns == [*odd_documents.columns, "lang_pred", "rejected"]
    by = {r.doc_id: r for r in out.where("doc_id IS NOT NULL").collect()}
    assert [(by[i].lang_pred, float(by[i].score), by[i].rejected) for i in (1, 2, 8)] == [("und", 0.0, True)] * 3
    assert by[3].lang_pred == "en" and by[6].lang_pred in model.languages
    assert language.identify_languages(no_documents, model).collect() == []
    assert language.fit_languages(no_documents) is None
    assert {r.lang_pred for r in language.identify_languages(odd_documents, None).collect()} == {"und"}


def test_blocks_give_the_same_logits(model, monkeypatch):
    text = ("the thing and the other " * 300).encode()
    want = model.logits(text)
    monkeypatch.setattr(language, "BLOCK", 50)
    assert abs(model.logits(text) - want).max() < 1e-4


UNLEARNED = {
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki.",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "code": "def find(raw, size):\n    out, key = [], np.zeros(len(raw))\n    for n in GRAMS:\n        if len(raw) < n: break",
    "base64": base64.b64encode(random.Random(3).randbytes(120)).decode(),
}


def test_texts_in_no_learned_language_go(spark, documents, model):
    held = [r.text for r in documents.where(language.held_out()).where("n_chars > 40").orderBy("doc_id").limit(200).collect()]
    shuffled = ["".join(random.Random(i).sample(t, len(t))) for i, t in enumerate(held)]
    mixed = [f"{a[:300]} {b[:300]}" for a, b in zip(held, held[1:])]
    short = [t[:40] for t in held]
    kinds = {"unlearned": list(UNLEARNED.values()), "shuffled": shuffled, "whole": held, "mixed": mixed, "short": short}
    rows = spark.createDataFrame([(k, t) for k, texts in kinds.items() for t in texts], "kind string, text string")
    said = language.identify_languages(rows, model).groupBy("kind").agg(F.avg(F.col("rejected").cast("int")).alias("gone"))
    gone = {r.kind: r.gone for r in said.collect()}
    assert gone["unlearned"] == 1 and gone["shuffled"] >= 0.95
    assert gone["whole"] <= 0.01 and gone["mixed"] <= 0.01 and gone["short"] <= 0.02


def brute_fit(pieces, capacity):
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [
            (capacity - sum(x[0] for x in own) - length, i) for i, own in enumerate(bins)
            if sum(x[0] for x in own) + length <= capacity and sum(x[0] for x in own) < capacity
            and not any(x[1] & source or x[2] & cluster for x in own)
        ]
        if fits:
            own = min(fits)[1]
        else:
            own = len(bins)
            bins.append([])
        bins[own].append((length, source, cluster))
        out.append(own)
    return out


def test_best_fit_agrees_with_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        pieces = sorted(
            ((rng.randint(1, 30), 1 << rng.randint(0, 4) if rng.random() < 0.8 else 0, 1 << rng.randint(0, 9)) for _ in range(60)),
            reverse=True,
        )
        assert packing.best_fit(pieces, 40) == brute_fit(pieces, 40)


def test_packing(spark, documents, odd_documents, no_documents):
    docs = documents.select("doc_id", "text", "source").union(odd_documents.select("doc_id", "text", "source"))
    out = packing.pack_documents(docs, capacity=300, rows_per_group=100).collect()
    size, bins = {}, {}
    for r in out:
        size[r.doc_id, r.copy, r.piece, r.bin] = r.n_tokens
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    words = {}
    for r in docs.collect():
        words.setdefault(r.doc_id, []).append(len((r.text or "").split()))
    total = {}
    for r in out:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert total == {d: sum(n) for d, n in words.items()}
    source = {r.doc_id: r.source for r in docs.collect() if r.doc_id is not None}
    for own in bins.values():
        own.sort(key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))]
        assert sum(r.n_tokens for r in own) <= 300
        held = [source[r.doc_id] for r in own if r.doc_id is not None]
        assert len(held) == len(set(held))
    assert packing.pack_documents(no_documents).collect() == []


def test_copies_never_share_a_bin(spark):
    rows = [(i, "same few words", f"s{i}") for i in range(30)] + [(99, "repeated row", "t")] * 200
    out = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == 230 and len({(r.doc_id, r.copy) for r in out}) == 230
    for want in ({*range(30)}, {99}):
        own = [r.bin for r in out if r.doc_id in want]
        assert len(own) == len(set(own))


def test_pipeline_stages_agree_with_brute_force(spark, odd_documents):
    docs = table(spark, SF, "documents").where("doc_id < 150").union(
        odd_documents.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
        .withColumn("doc_id", F.col("doc_id") + 5000)
    )
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        out = spark.createDataFrame(out.collect(), out.schema)
        brute_pipeline_stage(name, docs.collect(), out.collect(), items)
        docs = out


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "copy", "piece", "bin", "start", "n_tokens"] and out.count() > 100
