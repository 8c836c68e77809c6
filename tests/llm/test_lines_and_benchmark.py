import hashlib
import random
import re

from pyspark.sql import functions as F

from tidewell.llm import decontamination, line_dedup

LOWER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_lines(rows, least=10, docs=2):
    top = 1 << 63
    key = lambda line: line.strip("\t\n\x0b\x0c\r ").translate(LOWER)
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(top if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = top if doc is None else doc
        kept = [x for x in lines if len(holders.get(key(x), ())) < docs or own == min(holders[key(x)])]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_lines_agree_with_brute_force(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    for docs in (2, 3):
        out = line_dedup.dedup_lines(odd_documents, min_docs=docs)
        assert out.columns == [*odd_documents.columns, "n_lines", "n_dropped"]
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
        assert got == brute_lines(rows, docs=docs)


def test_no_lines(no_documents):
    assert line_dedup.dedup_lines(no_documents).collect() == []


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_hits(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        if name is None or not own:
            continue
        size = min(window, len(own))
        wins = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_automaton_agrees_with_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        vocabulary = "abc"[: rng.randint(1, 3)]
        line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, n)))  # noqa: E731, B023
        items = [(str(i), line(12)) for i in range(rng.randint(0, 4))]
        window = rng.randint(1, 5)
        automaton = decontamination.Automaton(((n, list(decontamination.words_of(t.encode()))) for n, t in items), window)
        for _ in range(5):
            text = line(30)
            n, spans, found = automaton.scan(decontamination.words_of(text.encode()))
            assert (n, sum(b - a for a, b in spans), sorted(found)) == brute_hits(text, items, window)


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away today"),
    (2, "own line"),
    (3, None),
    (4, " ...!"),
    (None, "the"),
    (5, "a b c"),
    (5, "12 the"),
]


def test_documents_agree_with_brute_force(spark, odd_documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    want = sorted(((d, *brute_hits(t, ITEMS, 6)) for d, t in rows), key=repr)
    for size in (500_000, 8):  # one automaton, and one for a few items each
        out = decontamination.decontaminate(odd_documents, items, window=6, words_per_automaton=size)
        got = out.collect()
        assert sorted(((r.doc_id, int(r.N_WORDS), r.n_hit, list(r["items"])) for r in got), key=repr) == want
        for r in got:
            assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= int(r.N_WORDS))
            if r.doc_id == 4:
                assert words(r.text) == ["of", "four"] or r.n_hit != 28
            if r.doc_id == 1:
                assert r.text is None


def test_repeated_and_long_items_in_many_automata(spark):
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    long = line(300)
    items = [(i, long) for i in range(3)] + [(i, line(rng.randint(0, 30))) for i in range(3, 20)] * 2 + [(0, line(20))]
    texts = [line(rng.randint(0, 60)) + " " + long[2 * k : 2 * k + 2 * rng.randint(0, 50)] for k in range(0, 300, 20)] + ["", long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    stored = decontamination.build_automata(tests.select(F.col("item_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("text")), 8, 100)
    assert stored.count() >= 10
    # a piece, its overlap, and what was there before the last piece
    sizes = [max(decontamination._loaded(bytes(r["stored"]))[0].length) for r in stored.collect()]
    assert max(sizes) <= 12 + 7
    want = sorted((d, *brute_hits(t, set(items), 8)) for d, t in enumerate(texts))
    for most, pass_bytes in ((100, 1 << 28), (300, 2500)):
        out = decontamination.decontaminate(docs, tests, window=8, words_per_automaton=most, bytes_per_pass=pass_bytes)
        assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()) == want


def test_all_automata_in_one_pass_over_the_documents(spark, odd_documents):
    items = spark.createDataFrame([(i, f"w{i} the own line") for i in range(60)], "item_id long, text string")
    out = decontamination.decontaminate(odd_documents, items, window=4, words_per_automaton=12)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "scanned" not in plan and not any("scanned" in f for f in out.inputFiles())


def test_cut_text_has_no_hits_left(spark, odd_documents):
    items = spark.createDataFrame([ITEMS[0]], "item_id long, text string")
    out = decontamination.decontaminate(odd_documents, items, window=13)
    kept = {r.doc_id: r.text for r in out.collect()}
    assert kept[4] == "\nown line of four\n"
    assert kept[2] == "" and kept[6] == "word " * 120_000
    again = decontamination.decontaminate(out.select("doc_id", "text"), items, window=13)
    assert {r.n_hit for r in again.collect()} == {0}


def test_no_items_or_documents(spark, odd_documents, no_documents):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontamination.decontaminate(odd_documents, none)
    assert out.where("n_hit > 0").isEmpty() and out.count() == odd_documents.count()
    assert decontamination.decontaminate(no_documents, none).collect() == []


def test_line_key():
    assert line_dedup.line_key(b" short \n", 10) is None
    assert line_dedup.line_key("ééééé".encode(), 10) is None  # ten bytes, five code points
    assert line_dedup.line_key(b"\tTEN POINTS\r", 10) == hashlib.md5(b"ten points").digest()
