"""Benchmark passages in documents, found by a generalised suffix automaton of the test items.

The words of a document run through the automaton once. Its state tells the longest stretch that ends
here and stands in some item, so each occurrence of a window is seen when its last word is read.
Tasks build automata of bounded size from the distinct items and store them as rows.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Hashable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import WORD_BYTES, packed, unpacked, utf8
from tidewell.session import written

_WORD = re.compile(rb"[^ ]+")
#: bytes from which on a text is walked word by word instead of being split at once
LONG_TEXT = 1 << 22


def words_of(text: bytes | None) -> Iterable[bytes]:
    lowered = (text or b"").translate(WORD_BYTES)
    return lowered.split() if len(lowered) < LONG_TEXT else (m[0] for m in _WORD.finditer(lowered))


class Automaton:
    """Suffix automaton of several word sequences, with the items of each window."""

    def __init__(self, items: Iterable[tuple[Hashable, list[bytes]]], window: int):
        self.window = window
        self.step: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        for _, words in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self._find_windows(items)

    def _state(self, length: int, step: dict[bytes, int], link: int) -> int:
        self.step.append(step)
        self.length.append(length)
        self.link.append(link)
        return len(self.step) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state of ``p`` followed by ``w`` alone, cut off from the longer ``q``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.step[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.step[last]:
            return self._split(last, self.step[last][w], w)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.step[p][w], w)
        return new

    def _at(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of ``state``."""
        while self.length[self.link[state]] >= length > 0:
            state = self.link[state]
        return state

    def _find_windows(self, items: list[tuple[Hashable, list[bytes]]]) -> None:
        held: dict[int, set[Hashable]] = {}
        whole: dict[int, set[tuple[int, Hashable]]] = {}
        for name, words in items:
            state = 0
            for i, w in enumerate(words, 1):
                state = self.step[state][w]
                if i >= self.window:
                    held.setdefault(self._at(state, self.window), set()).add(name)
            if len(words) < self.window:
                whole.setdefault(self._at(state, len(words)), set()).add((len(words), name))
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        #: state -> items of the window that ends here; state -> whole short items that end here
        self.windows: dict[int, set[Hashable]] = {}
        self.shorts: dict[int, set[tuple[int, Hashable]]] = {}
        for s in order:
            if self.length[s] >= self.window:
                self.windows[s] = held.get(s) or self.windows.get(self.link[s], set())
            if own := self.shorts.get(self.link[s], set()) | whole.get(s, set()):
                self.shorts[s] = own
        self.least = min([self.window, *(n for short in whole.values() for n, _ in short)])

    def scan(self, words: Iterable[bytes]) -> tuple[int, list[tuple[int, int]], set[Hashable]]:
        """Number of words, merged spans [first, end) of hit words, and the items found."""
        step, link, length, least, window = self.step, self.link, self.length, self.least, self.window
        spans, found = [], set()
        state = matched = 0
        i = -1
        for i, w in enumerate(words):  # noqa: B007
            here = step[state]
            if w in here:
                state = here[w]
                matched += 1
            elif state:
                while state and w not in step[state]:
                    state = link[state]
                matched = length[state]
                if w in step[state]:
                    state = step[state][w]
                    matched += 1
            if matched >= least:
                if matched >= window:
                    found |= self.windows[state]
                    spans.append((i + 1 - window, i + 1))
                for n, name in self.shorts.get(state, ()):
                    if n <= matched:
                        found.add(name)
                        spans.append((i + 1 - n, i + 1))
        return i + 1, merged(spans), found


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given spans of words."""
    kept, at, rest = [], 0, iter(spans)
    span = next(rest, None)
    for i, m in enumerate(_WORD.finditer(text.translate(WORD_BYTES))):
        if span and i == span[0]:
            kept.append(text[at : m.start()])
        if span and i == span[1] - 1:
            at = m.end()
            span = next(rest, None)
            if span is None:
                break
    return b"".join([*kept, text[at:]])


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", _SPANS), ("items", pa.list_(pa.string()))])
#: bytes of text that are scanned by one automaton after the other before the next texts are taken
BATCH_BYTES = 1 << 25


def _cut(window: int, most: int):
    """Word sequences of at most ``most`` + ``window`` - 1 words; each window of an item is in one of its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, names in zip(batch["text"].to_pylist(), batch["names"].to_pylist(), strict=True):
                words = list(words_of(text))
                for at in range(0, max(1, len(words) - window + 1), most) if words else ():
                    own = words[at : at + most + window - 1]
                    columns = [pa.array([names]), pa.array([b" ".join(own)]), pa.array([len(own) + len(names)])]
                    yield pa.RecordBatch.from_arrays(columns, ["names", "words", "size"])

    return run


def stored_automaton(pieces: list[tuple[list[str], list[bytes]]], window: int) -> bytes:
    """The automaton of the pieces, and the names of each, in bytes."""
    automaton = Automaton(((i, words) for i, (_, words) in enumerate(pieces)), window)
    return zlib.compress(pickle.dumps((vars(automaton), [names for names, _ in pieces]), pickle.HIGHEST_PROTOCOL), 1)


def _loaded(stored: bytes) -> tuple[Automaton, list[list[str]]]:
    state, names = pickle.loads(zlib.decompress(stored))
    automaton = Automaton.__new__(Automaton)
    vars(automaton).update(state)
    return automaton, names


@functools.lru_cache(maxsize=1)
def _only(stored: bytes) -> tuple[Automaton, list[list[str]]]:
    """The same, kept by the worker for its next tasks."""
    return _loaded(stored)


def _built(window: int, most: int):
    """Automata of the pieces of a task, each closed when its pieces reach ``most`` words and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, size = [], 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([stored_automaton(own, window)], pa.binary())], ["stored"])

        for batch in batches:
            for names, words in zip(batch["names"].to_pylist(), batch["words"].to_pylist(), strict=True):
                own.append((names, words.split(b" ")))
                size += len(own[-1][1]) + len(names)
                if size >= most:
                    yield closed()
                    own, size = [], 0
        if own:
            yield closed()

    return run


def build_automata(tests: DataFrame, window: int, most: int) -> DataFrame:
    """One row (``stored``) per automaton over the items (name, text); none holds more than about twice ``most`` words and names.

    Equal texts are one sequence with several names, of which a group holds about ``most`` / 8; items longer than that are cut.
    """
    piece = max(window, most // 8)
    distinct = written(tests.distinct(), "items")
    salts = max(1, -(-distinct.count() // piece))
    named = distinct.groupBy("text", F.pmod(F.xxhash64("name"), F.lit(salts)).alias("salt")).agg(F.collect_list("name").alias("names"))
    pieces = named.select("text", "names").mapInArrow(_cut(window, piece), "names array<string>, words binary, size long")
    pieces = written(pieces, "item_pieces")
    parts = max(1, -(-(pieces.agg(F.sum("size")).first()[0] or 0) // most))
    dealt = pieces.repartition(parts, F.xxhash64("words", "names"))
    return written(dealt.select("names", "words").mapInArrow(_built(window, most), "stored binary"), "automata")


def _passes(automata: DataFrame, window: int, most_bytes: int) -> Iterator[list[bytes]]:
    """The stored automata in groups of about ``most_bytes``, which is all that the driver holds; one without items if there are none."""
    own, size, none = [], 0, True
    for row in automata.toLocalIterator():
        if own and size + len(row["stored"]) > most_bytes:
            yield own
            own, size = [], 0
        own.append(bytes(row["stored"]))
        size, none = size + len(own[-1]), False
    if own or none:
        yield own or [stored_automaton([], window)]


def _scanner(shared):
    def gathered(batches: Iterator[pa.Array], least: int) -> Iterator[list[pa.Array]]:
        own = []
        for batch in batches:
            own.append(batch)
            if sum(x.nbytes for x in own) >= least:
                yield own
                own = []
        if own:
            yield own

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automata = shared.value
        load, least = (_only, 0) if len(automata) == 1 else (_loaded, BATCH_BYTES)
        for group in gathered(batches, least):
            texts = [raw for batch in group for raw in batch.to_pylist()]
            out = [{"n_words": 0, "spans": [], "items": set()} for _ in texts]
            for stored in automata:
                automaton, names = load(stored)
                for raw, own in zip(texts, out, strict=True):
                    own["n_words"], spans, found = automaton.scan(words_of(raw))
                    own["spans"] += spans
                    own["items"].update(name for i in found for name in names[i])
                del automaton, names  # one at a time
            for own in out:
                own.update(spans=[{"first": a, "end": b} for a, b in merged(own["spans"])], items=list(own["items"]))
            at = 0
            for batch in group:
                yield pa.array(out[at : at + len(batch)], _FOUND)
                at += len(batch)

    return F.arrow_udf(run, "n_words long, spans array<struct<first: long, end: long>>, items array<string>")


def _settler():
    kind = pa.struct([("n_hit", pa.int64()), ("text", pa.string())])

    def run(text: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for raw, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            own = merged((s["first"], s["end"]) for s in found)
            clean = without(raw, own) if own else raw
            out.append({"n_hit": sum(b - a for a, b in own), "text": None if clean is None else clean.decode("utf-8", "replace")})
        return pa.array(out, kind)

    return F.arrow_udf(run, "n_hit long, text string")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    words_per_automaton: int = 500_000,
    percent: int = 5,
    bytes_per_pass: int = 1 << 28,
) -> DataFrame:
    """The documents with hit spans cut from the text, and ``n_words``, ``n_hit``, ``items``, ``contaminated``.

    A window is ``window`` consecutive words of an item, a shorter item is one window. Words of a document
    inside any occurrence are hit; ``contaminated`` when hit words reach ``percent`` of all words. ``items``
    are the ids (as text, sorted) of the items with occurring windows. A null text has no words and stays
    null. Items without id or words take no part; several texts under one id are one item, repeated items
    count once. Without items nothing is hit, without documents there are no rows. Repeated rows each give
    their row. Extra columns pass through.

    Tasks build the automata, of about ``words_per_automaton`` item words each, and store them. The documents
    are read once for every ``bytes_per_pass`` of stored automata; a task goes through them one at a time.
    """
    spark = docs.sparkSession
    tests = items.select(F.col(item_id).cast("string").alias("name"), utf8(F.col(item_text)).alias("text")).where(
        "name IS NOT NULL AND text IS NOT NULL"
    )
    automata = build_automata(tests, window, words_per_automaton)
    base = packed(docs, text=utf8(F.col(text))).withColumns(
        {"n_words": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<struct<first: long, end: long>>)"),
         "items": F.expr("cast(array() as array<string>)")}
    )
    shared = None
    for stored in _passes(automata, window, bytes_per_pass):
        if shared is not None:
            base = written(base, "scanned")
            shared.unpersist()
        shared = spark.sparkContext.broadcast(stored)
        scanned = base.withColumn("found", _scanner(shared)("text"))
        base = scanned.select(
            "_row",
            "text",
            F.col("found.n_words").alias("n_words"),
            F.concat("spans", "found.spans").alias("spans"),
            F.array_union("items", "found.items").alias("items"),
        )
    out = base.withColumn("settled", _settler()("text", "spans"))
    hit = F.col("settled.n_hit")
    return unpacked(
        out,
        **{text: F.col("settled.text")},
        n_words=F.col("n_words"),
        n_hit=hit,
        items=F.array_sort("items"),
        contaminated=(hit > 0) & (hit * 100 >= F.col("n_words") * percent),
    )
