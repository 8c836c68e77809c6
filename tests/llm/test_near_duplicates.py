import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import components as C
from tidewell.llm import jaccard
from tidewell.llm import shingles as S


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(d, brute_set(t)) for d, t in rows]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted((d, len(x), find(d) if x else d) for d, x in sets)


def corpus(seed, groups=14, copies=9):
    """Groups of copies with a few to many words changed, a passage that many share, sizes from 1 to 300 words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(groups):
        size = rng.choice([1, 3, 5, 8, 20, 40, 90, 200, 300])
        base = [word() for _ in range(size)]
        if rng.random() < 0.5:
            base[size // 2 : size // 2] = passage
        for _ in range(rng.randint(1, copies)):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                own[rng.randrange(len(own))] = word()
            if rng.random() < 0.3:
                own += [word() for _ in range(rng.randint(0, len(own) // 4 + 1))]
            rows.append(" ".join(own))
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(
    ("seed", "options", "few"),
    [(1, {}, 16), (2, {"fine": 8}, 16), (3, {"fine": 8, "spread": 30.0}, 3), (4, {"fine": 16}, 1)],
)
def test_components_agree_with_brute_force(spark, monkeypatch, seed, options, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "SIDE", 4)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.near_duplicates(docs, **options).collect())
    assert got == brute_components(rows)
    assert any(c < d for d, _, c in got)


def test_odd_documents(odd_documents):
    out = jaccard.near_duplicates(odd_documents).collect()
    assert len(out) == odd_documents.count()
    by = {}
    for r in out:
        by.setdefault(r.doc, set()).add((r.n_shingles, r.component_id))
    assert by[1] == {(0, 1)} and by[2] == {(0, 2)}
    assert by[3] == {(9, 3)}
    assert by[6] == {(1, 6)}
    unnamed = sorted((n, c) for d, own in by.items() if d >= jaccard.UNNAMED for n, c in own)
    assert unnamed[0][0] == 0 and unnamed[-1] == (9, 3)  # the copy without an id belongs to 3


def test_id_with_several_texts_ties_them(spark):
    one, two = "a b c d e f g h", "p q r s t u v w"
    docs = spark.createDataFrame([(7, one), (7, two), (9, one), (8, two), (5, "x")], "doc_id long, text string")
    assert {r.doc: r.component_id for r in jaccard.near_duplicates(docs).collect()} == {7: 7, 8: 7, 9: 7, 5: 5}


def test_one_document_of_each_group_stays(spark, odd_documents, no_documents):
    kept = jaccard.drop_near_duplicates(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r.doc_id, r.text is None) for r in kept.where("doc_id IS NOT NULL").select("doc_id", "text").collect())
    assert ids == [(i, i == 1) for i in range(1, 10)]
    assert jaccard.drop_near_duplicates(no_documents).collect() == []


def test_a_link_at_the_very_threshold(spark):
    base = [f"w{i}" for i in range(20)]  # 16 shingles
    other = base[2:] + ["z1", "z2"]  # 14 shared of 18
    third = base[3:] + ["y1", "y2"]
    docs = spark.createDataFrame(enumerate([" ".join(x) for x in (base, other, third)]), "doc_id long, text string")
    assert brute_components([tuple(r) for r in docs.collect()]) == sorted(
        tuple(r) for r in jaccard.near_duplicates(docs).collect()
    )


def test_sketches_differ_in_no_more_parts_than_sets():
    rng = random.Random(5)
    for _ in range(200):
        words = [str(rng.random()) for _ in range(rng.randint(5, 80))]
        other = list(words)
        for _ in range(rng.randint(1, 4)):
            other[rng.randrange(len(other))] = "x" + str(rng.random())
        a, b = (S.shingles(" ".join(x).encode()) for x in (words, other))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        for parts in (0, 3, 17, 60):
            x, y = (set(S.sketch_tokens(s, parts).tolist()) for s in (a, b))
            assert max(len(x - y), len(y - x)) <= apart


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(20, 60)] + [(3, 7), (200, 201), (201, 200)]
    links += [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    rng.shuffle(links)
    got = {r.node: r.root for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert C.components(spark.createDataFrame([(1, 1)], "a long, b long").where(F.lit(False))).collect() == []


def test_crowded_group_verifies_few_pairs(spark, monkeypatch):
    """Near copies of one text share most of their parts; parity bits leave about the links to verify."""
    pick = random.Random(17)
    words = [f"w{k}" for k in range(150)]
    rows = []
    for doc in range(150):
        own = list(words)
        for k in pick.sample(range(150), pick.randrange(2, 11)):
            own[k] = f"x{doc}-{k}"
        rows.append((doc, " ".join(own)))
    seen = []
    plain = jaccard._verify

    def counted(pairs, *rest):
        out = plain(pairs, *rest)
        seen.append((out.count(), out.where("linked").count()))
        return out

    monkeypatch.setattr(jaccard, "_verify", counted)
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    verified, linked = (sum(x) for x in zip(*seen, strict=True))
    assert verified <= linked + 20


def test_bit_distance_is_a_lower_bound():
    pick = np.random.default_rng(5)
    for size in (1, 5, 100, 3000):
        a = np.unique(pick.integers(0, 1 << 63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[: size // 2], pick.integers(0, 1 << 63, size // 3).astype(np.uint64)]))
        apart = len(np.setxor1d(a, b))
        for x, y in ((512, 512), (512, 4096), (8192, 1024)):
            assert S.distance(S.bit_sketch(a, x), S.bit_sketch(b, y)) <= apart
        assert S.distance(S.bit_sketch(a, 1 << 20), S.bit_sketch(b, 1 << 20)) >= 0.95 * apart
