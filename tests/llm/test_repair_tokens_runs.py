"""Conversation repair, token counts and periodic runs against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, document
from tidewell.llm import conversation_repair, queries, runs, token_counts

BLANKS = " \t\n\x0b\x0c\r"
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def brute_repair(rows):
    """Every way through the rows as a string of edits; the cheapest that sorts first."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        inner = text.strip(BLANKS)
        faults.append("b" if not inner else "d" if (role, text) in seen else "t" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    ways = {0: (0, "", ())}

    def inserted(ways):
        out = dict(ways)
        for _ in range(3):
            for state, (cost, audit, made) in list(out.items()):
                role = "assistant" if state == 2 else "user"
                way = (cost + 3, audit + "I", (*made, f"{role}:"))
                to = NEXT[state, role[0]]
                out[to] = min(out.get(to, way), way)
        return out

    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def offer(to, way, new=new):
            new[to] = min(new.get(to, way), way)

        for state, (cost, audit, made) in inserted(ways).items():
            offer(state, (cost + 4, audit + "D", made))
            if fault in ("", "t"):
                extra = 3 * (fault == "t")
                if to := NEXT.get((state, role[:1])):
                    offer(to, (cost + extra, audit + "K", (*made, f"{role}:{text}")))
                other = "assistant" if state == 2 else "user"
                offer(NEXT[state, other[0]], (cost + extra + 3, audit + "R", (*made, f"{other}:{text}")))
        ways = new
    cost, audit, made = min(w for s, w in inserted(ways).items() if s in (0, 3))
    turns = [t for t, _, _ in rows if t is not None]
    firsts = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        faults.count("b"),
        faults.count("d"),
        faults.count("t"),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(made).encode()).hexdigest(),
    )


def repaired(rows):
    edits, summary = conversation_repair.repair_conversations(rows)
    texts = {r.name: (r.audit, r.repaired_sha256) for r in conversation_repair.digests(edits).collect()}
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, *texts[None if r.conv_id is None else str(r.conv_id)])
        for r in summary.collect()
    }


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block, joined", [(4096, 1024), (4, 3)])
def test_repair_equals_all_ways(spark, monkeypatch, block, joined):
    monkeypatch.setattr(conversation_repair, "BLOCK_ROWS", block)
    monkeypatch.setattr(conversation_repair, "BLOCKS_JOINED", joined)
    pick = random.Random(7)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Yes.", "No!", "Why", " \t", "", None, "Well? \n", "ok", "é.", "12"]
    data = {}
    for conv in [None, *range(40)]:
        size = pick.choice([1, 2, 3, 6, 12, 60])
        data[conv] = [
            (pick.choice([None, *range(2 * size)]), pick.choice(roles), pick.choice(texts) if pick.random() < 0.5 else f"{pick.random()}.")
            for _ in range(size)
        ]
    data[99] = [(-(2**62), "user", "One."), (2**62, "assistant", "Two.")]
    data[100] = [(5, "tool", "Same.")] * 200 + [(6, "user", "")] * 30
    rows = [(c, *r) for c, own in data.items() for r in own]
    got = repaired(spark.createDataFrame(rows, TURNS).repartition(5))
    assert got == {c: brute_repair(own) for c, own in data.items()}


def test_repair_orders_edits_and_shows_texts(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "tool", "cut"), (1, 9, "user", "")]
    extra = spark.createDataFrame([(*r, "x", 1) for r in rows], TURNS + ", seq string, COPIES int")
    edits, summary = conversation_repair.repair_conversations(extra)
    got = [(r.edit, r.copies, r.turn, r.role, r.text) for r in edits.orderBy("seq", "step").collect()]
    assert got == [
        ("K", 1, 0, "system", "Be kind."),
        ("K", 1, 1, "user", "Hi?"),
        ("D", 1, 1, None, None),
        ("D", 1, 2, None, None),
        ("D", 1, 9, None, None),
        ("I", 1, 9, "assistant", ""),
    ] or [e[0] for e in got] == list("KKDRD")
    assert summary.first().gaps == 6


def test_repair_of_nothing(spark):
    edits, summary = conversation_repair.repair_conversations(spark.createDataFrame([], TURNS))
    assert edits.count() == summary.count() == 0


def brute_damage(rows):
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if fault == 1 else "".join(c for c in text if c not in ".!?") if fault == 2 else text
        for _ in range(0 if fault == 0 else 2 if fault == 3 else 1):
            yield conv, turn, "user" if fault == 4 else role, text


def test_repair_query_returns_every_conversation(spark, tmp_path):
    pick = random.Random(3)
    rows = [(c, t, pick.choice(["user", "assistant", None]), pick.choice(["A.", "b", None])) for c in [None, *range(60)] for t in [None, 0, 1]]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 160)]
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    own = {}
    for row in rows:
        own.setdefault(row[0], [])
    for conv, *rest in brute_damage(rows):
        own[conv].append(tuple(rest))
    got = {r[0]: tuple(r)[1:] for r in queries.QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert got == {c: brute_repair(r) for c, r in own.items()}
    assert any(not r for r in own.values())


def library_counts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [len(x) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("long_bytes", [4 << 20, 40])
def test_token_counts_equal_the_library(spark, odd_documents, long_bytes):
    pick = random.Random(5)
    parts = [" ", "  ", "\n", "\t ", " ", " ", "\x1c", "\x85", "a", "don't", "'s", "<|endoftext|>", "<|end", "é", "12", "!?", "漢字", "🙂", "​", "word"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(60))) for _ in range(400)] + ["x" * 5000, "<|endoftext|>" * 30]
    df = spark.createDataFrame([document(k, t) for k, t in enumerate(texts)], SCHEMA).withColumnRenamed("n_chars", "n_tokens")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(df, long_bytes=long_bytes).collect()}
    want = library_counts(texts)
    assert got == {k: (len(t.encode()), n, n > 1024) for k, (t, n) in enumerate(zip(texts, want, strict=True))}
    odd = token_counts.count_tokens(odd_documents, long_bytes=long_bytes).collect()
    assert len(odd) == odd_documents.count()
    assert [r.n_tokens for r in odd] == library_counts([r.text or "" for r in odd])
    assert token_counts.count_tokens(odd_documents.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_token_counts_of_other_tokenizers(spark, odd_documents, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    rows = token_counts.count_tokens(odd_documents, tokenizer=path, long_bytes=1000).collect()
    texts = [r.text or "" for r in rows]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    else:
        from tokenizers import Tokenizer

        want = [len(x) for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [r.n_tokens for r in rows] == want


def test_pieces_join_to_the_text():
    text = "one  two\nthree " * 50 + "x" * 100 + "  y z"
    parts = list(token_counts.pieces(text, 16))
    assert "".join(parts) == text and len(parts) > 20
    assert sum(library_counts(parts)) == library_counts([text])[0]


def brute_runs(words, least=24, times=3):
    found = {}
    for period in range(1, len(words) // times + 1):
        at = 0
        while at + period < len(words):
            if words[at] != words[at + period]:
                at += 1
                continue
            start = at
            while at + period < len(words) and words[at] == words[at + period]:
                at += 1
            if at + period - start >= max(least, times * period):
                found.setdefault((start, at + period - start), period)  # the smallest period comes first
    return sorted((s, n, p) for (s, n), p in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("least, times", [(24, 3), (6, 2), (5, 3)])
def test_runs_equal_brute_force(least, times):
    pick = random.Random(least)
    cases = [[pick.randrange(k) for _ in range(n)] for k in (1, 2, 3) for n in (0, 1, 5, 24, 60, 150)] * 3
    cases += [fibonacci(400), [0] * 100, [0, 1] * 80 + [0, 0, 1] * 40, list(range(30)) * 4]
    for _ in range(60):
        base = [pick.randrange(4) for _ in range(pick.randrange(1, 12))]
        cases.append([pick.randrange(3) for _ in range(pick.randrange(9))] + base * pick.randrange(2, 9) + base[: pick.randrange(9)] + cases[pick.randrange(18)])
    for words in cases:
        assert runs.find_periodic(np.array(words, np.int64), least, times) == brute_runs(words, least, times)


def test_runs_of_odd_documents(spark, odd_documents, no_documents):
    rows = runs.find_runs(odd_documents.withColumnRenamed("n_chars", "runs")).collect()
    assert len(rows) == odd_documents.count()
    for r in rows:
        words = [w for w in (r.text or "").encode().split()]
        want = [(0, 120_000, 1)] if len(words) == 120_000 else brute_runs(words)
        assert [tuple(x) for x in r.runs] == want and r["N_WORDS"] == len(words)
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r.collapsed.encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
    assert runs.find_runs(no_documents).count() == 0


def test_runs_query_equals_brute_force(spark, tmp_path):
    pick = random.Random(11)
    rows = [(k, " ".join(pick.choices(["a", "b", "cé"], k=pick.randrange(120)))) for k in range(150)] + [(None, "a " * 40), (151, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()}
    for doc, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        want = brute_runs(words)
        top = min(want, key=lambda r: (-r[1] / r[2], r[0], r[2])) if want else None
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert got[doc] == (
            len(want),
            *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4),
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest(),
        )
