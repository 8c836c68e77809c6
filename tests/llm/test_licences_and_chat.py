import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, licences
from tidewell.llm.licences import Template
from tidewell.llm.queries import _LOWER, _WORDS, SQL, op3_chat_formatting


def same(df, tables, sql):
    con = duckdb.connect()
    for name, table in tables.items():
        con.register(name, table.toArrow())
    result = con.execute(sql)
    names, rows = [c[0] for c in result.description], result.fetchall()
    got = [tuple(r[n] for n in names) for r in df.select(*names).collect()]
    assert sorted(got, key=repr) == sorted(rows, key=repr)


NOTICES = [
    "under the mit license",
    "Released UNDER -- the... MIT License, under the mit license",
    "under the mit licenses",
    "xunder the mit license",
    "the mit license under",
    "under under the mit license the mit license",
    "Apache License, Version 2",
    "apache license version 2.0 CC BY-NC cc by nc",
    "SPDX-License-Identifier: Apache-2.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "granted free of charge to any person obtaining a copy of this software and associated",
    "Redistribution and use in source and binary forms, with or without changes",
    "free and unencumbered software released into",
    "Kelvin cc by nK",
    "license " * 3000 + "under the mit license " * 50,
    "GNU General Public License",
]


def test_licences_agree_with_sql(spark, odd_documents):
    more = spark.createDataFrame(list(enumerate(NOTICES, 100)), "doc_id long, text string")
    docs = odd_documents.select("doc_id", "text").union(more)
    out = licences.scan_licences(docs)
    short = "doc_id IS NULL OR doc_id NOT IN (6, 114)"  # the SQL copies the words for every place
    same(out.where(short), {"documents": docs.where(short)}, SQL["op2_license_scan"])
    by = {r.doc_id: r for r in out.collect()}
    assert (by[101].n_base, by[101].first_word, by[101].last_word, by[101].base_labels) == (2, 1, 5, "mit")
    assert (by[102].n_base, by[102].first_word, by[102].labels, by[102].score) == (0, None, "", 0.0)
    assert by[9].base_labels == "apache-2,cc-by-nc"
    assert by[109].labels == "mit" and by[109].base_labels == "" and 0 < by[109].score < 1
    assert by[114].n_base == 50 and by[1].n_words == 0


@pytest.mark.parametrize("rare", [1, 3, 9])
def test_result_does_not_depend_on_the_rare_words(spark, rare):
    templates = [Template("a", "x y x z"), Template("b", "y", base=True), Template("c", "q x y r", phrase="x y")]
    texts = ["x y x z", "y y y", "q x y r x y", "z x y x", "x y x y x z", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sql = licences.licence_sql(_WORDS, _LOWER, templates)
    same(licences.scan_licences(docs, templates=templates, rare=rare), {"documents": docs}, sql)


def test_every_notice_is_found_whole_and_in_part(spark):
    """All notices in a row and each cut short before its phrase ends, among words of the same templates."""
    texts = [t.text for t in licences.TEMPLATES] + [" ".join(t.words[: t.mandatory[1] - 1]) for t in licences.TEMPLATES]
    texts += ["x " + t.text + " y " + t.text for t in licences.TEMPLATES]
    texts += [" the ".join(t.words) for t in licences.TEMPLATES] + [" ".join(t.text for t in licences.TEMPLATES)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(licences.TEMPLATES) >= 40
    out = licences.scan_licences(docs, keep=["doc_id"])
    same(out, {"documents": docs}, SQL["op2_license_scan"])
    by = {r.doc_id: r for r in out.collect()}
    for n, t in enumerate(licences.TEMPLATES):
        assert by[n].score == 1.0 and t.label in by[n].labels.split(",")
    assert set(by[len(texts) - 1].labels.split(",")) == {t.label for t in licences.TEMPLATES}


def test_plan_does_not_grow_with_the_templates(spark):
    docs = spark.createDataFrame([(1, "text of w7 x y and w8 x")], "doc_id long, text string")
    nodes = []
    for n in (10, 400):
        out = licences.scan_licences(docs, templates=[Template(f"l{i}", f"w{i} x y") for i in range(n)])
        nodes.append(out._jdf.queryExecution().analyzed().expressions().size())
        assert out.first().labels == "l7"
    assert nodes[0] == nodes[1]


def test_columns_pass_through(odd_documents, no_documents):
    out = licences.scan_licences(odd_documents)
    assert [c for c in out.columns if c not in odd_documents.columns] == [
        "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"
    ][1:]
    assert out.schema["N_WORDS"].dataType.simpleString() == "bigint"
    assert licences.scan_licences(no_documents).collect() == []


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", ""),
    (1, 3, "ann", ""), (1, 2, "bob", "tie"), (1, None, "carl x\ty", "no number"), (1, 600, "ann", "late"),
    (2, 0, "system", "alone"), (3, 5, None, "nameless"), (None, 1, "ann", "no conversation"), (None, 1, None, None),
    (4, -1, "assistant", "é\nü"), (4, -600, "user", "early"),
]


def test_rotation_agrees_with_sql(spark, tmp_path):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    folder = str(tmp_path)
    turns.write.parquet(f"{folder}/conversations.parquet")
    same(op3_chat_formatting(spark, folder), {"conversations": turns}, SQL["op3_chat_formatting"])


def test_rotation(spark):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumnsRenamed({"conv_id": "perspective", "text": "block"})
    rows = chat.rotate_perspectives(turns, conv_id="perspective", text="block").collect()
    own = {(r.conv_id, r.perspective, r.block): r for r in rows}
    ann = own[1, "ann", 0]
    assert (ann.n_turns, ann.n_rows) == (7, 8)
    assert ann.text.startswith(
        "<|im_start|>user name=carl_x_y\nno number<|im_end|>\n<|im_start|>system\nbe kind<|im_end|>\n"
        "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.mask] == ["hi < |im_end|><|im_end|>", "<|im_end|>", "late<|im_end|>"]
    assert "<|im_start|>user name=ann\n" in own[1, "bob", 0].text
    assert own[2, None, 0].mask == [] and own[3, None, 0].text == "<|im_start|>user\nnameless<|im_end|>\n"
    assert {k[1] for k in own if k[0] is None} == {"ann"} and {k[2] for k in own} == {0}


def test_blocks_follow_places_not_numbers(spark):
    rows = [(7, 1_700_000_000 + 1000 * k, ("ann", "bob")[k % 2], f"turn {k}") for k in range(6)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.rotate_perspectives(turns).collect()
    assert sorted((r.perspective, r.block, r.n_turns, len(r.mask)) for r in out) == [("ann", 0, 6, 3), ("bob", 0, 6, 3)]
    cut = chat.rotate_perspectives(turns, turns_per_block=4).collect()
    assert sorted((r.perspective, r.block, r.n_turns) for r in cut) == [(p, b, n) for p in ("ann", "bob") for b, n in ((0, 4), (1, 2))]


def test_spans_of_a_large_block_are_summed_once(spark):
    n = 20_000
    turns = spark.range(n).select(
        F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"),
        F.concat(F.lit("r"), F.col("id") % 3).alias("role"), F.concat(F.lit("text é "), F.col("id")).alias("text"),
    )
    out = chat.rotate_perspectives(turns)
    assert "aggregate(slice(" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    assert {r.perspective for r in rows} == {"r0", "r1", "r2"} and max(r.n_turns for r in rows) == 512
    for i in range(3):
        own = sorted((r for r in rows if r.perspective == f"r{i}"), key=lambda r: r.block)
        said = [r.text[s.start : s.end].removesuffix(chat.END) for r in own for s in r.mask]
        assert said == sorted(f"text é {k}" for k in range(i, n, 3))


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate_perspectives(none).collect() == []


def test_no_python_in_the_native_plans(spark, odd_documents):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    for df in (licences.scan_licences(odd_documents), chat.rotate_perspectives(turns)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
