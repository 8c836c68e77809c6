"""Language of a text: the mean of hashed subword embeddings, and a linear softmax over it.

The model is fitted by stochastic gradient descent on the driver from a bounded sample. Mean and softmax
are both linear in the subwords, so a task needs one number per subword and language. The softmax is sure of
one of its languages for any text, so it cannot tell what is in none of them: one more number per subword,
the log of its share in the sample, does, against the least mean that was calibrated for that much text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import packed, unpacked

UNKNOWN = "und"
GRAMS = (1, 2, 3, 4)
#: bytes of text whose subwords are looked at together
BLOCK = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)

_BYTE = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def normal(text: bytes) -> np.ndarray:
    """Bytes of a lower-cased text with one blank around each run of letters."""
    raw = _BYTE[np.frombuffer(b" " + text + b" ", np.uint8)]
    blank = raw == 32
    return raw[~(blank & np.concatenate([[False], blank[:-1]]))]


def buckets(raw: np.ndarray, size: int, before: int = 0) -> np.ndarray:
    """Hash buckets of all subwords of 1 to 4 bytes that do not end in the first ``before`` bytes."""
    wide = raw.astype(np.uint64)
    out, key = [], np.zeros(len(raw), np.uint64)
    for n in GRAMS:
        if len(raw) < n:
            break
        key = key[: len(raw) - n + 1] * np.uint64(257) + wide[n - 1 :] + np.uint64(1)
        out.append((key[max(0, before - n + 1) :] * _ODD) >> np.uint64(64 - size))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    """``table``: for each bucket what it adds to the mean logit of each language, and last the log of its share.

    ``floors``: the least mean of that last number by the log2 of the distinct buckets, as two rows; None
    where nothing could be calibrated.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    floors: np.ndarray | None

    @property
    def bits(self) -> int:
        return (len(self.table) - 1).bit_length()

    def means(self, text: bytes) -> tuple[np.ndarray, int]:
        """Mean over all subwords, block by block, so a very long text needs no more memory; distinct buckets."""
        raw = normal(text)
        total, count = np.zeros(self.table.shape[1]), 0
        seen = np.zeros(len(self.table), bool)
        over = max(GRAMS) - 1
        for start in range(0, max(len(raw), 1), BLOCK):
            first = max(0, start - over)
            own = buckets(raw[first : start + BLOCK], self.bits, start - first)
            total += np.bincount(own, minlength=len(self.table)) @ self.table if len(own) > 1 << 14 else self.table[own].sum(0)
            count += len(own)
            seen[own] = True
        return total / max(count, 1), int(seen.sum())

    def logits(self, text: bytes) -> np.ndarray:
        return self.means(text)[0][:-1] + self.bias

    def predict(self, text: bytes) -> tuple[str, float, bool]:
        """Language, its probability, and whether the text is as familiar as texts of its size have to be."""
        mean, distinct = self.means(text)
        p = softmax((mean[:-1] + self.bias)[None] / self.temperature)[0]
        best = int(p.argmax())
        known = self.floors is None or bool(mean[-1] >= np.interp(np.log2(max(distinct, 1)), *self.floors))
        return self.languages[best], float(p[best]), known


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(text: bytes, rng: np.random.Generator) -> Iterable[bytes]:
    """The whole text and a few stretches of it, so that short texts are learned as well."""
    yield text
    for size in (24, 60, 200):
        if len(text) > size:
            start = int(rng.integers(0, len(text) - size))
            yield text[start : start + size]


def _familiar(shares: np.ndarray) -> np.ndarray:
    """Log of the mean share of each bucket over languages, each of the same weight."""
    mean = shares.sum(axis=0) / max(shares.sum(), 1e-9)
    return np.log(mean + 1e-3 / len(mean)).astype(np.float32)


def _floors(aside: list[tuple[bytes, int]], shares: np.ndarray, rejected: float, rng: np.random.Generator) -> np.ndarray | None:
    """The least familiarity by the amount of text, from pieces that must stay and pieces that must go.

    Stay: stretches of the texts kept aside, and two of them in a row, whatever their languages. Go: the same
    letters shuffled, and a language that the shares have not seen. The floor is what all but the share
    ``rejected`` of the first reach, moved halfway to the middle of the second where that lies lower. The amount
    is the number of distinct buckets: a word that is repeated says no more than once.
    """
    bits = (shares.shape[1] - 1).bit_length()
    whole = _familiar(shares)
    aside = [aside[i] for i in rng.permutation(len(aside))[:1000]]
    several = np.count_nonzero(shares.any(axis=1)) > 1
    without = {y: _familiar(np.delete(shares, y, axis=0)) for y in {y for _, y in aside}} if several else {}
    rounds = max(1, 500 // max(len(aside), 1))
    stay, go = [], []

    def add(to: list, piece: bytes, known: np.ndarray) -> None:
        own = buckets(normal(piece), bits)
        if len(own):
            to.append((np.log2(len(np.unique(own))), known[own].mean()))

    for _ in range(rounds):
        before = b""
        for text, y in aside:
            for size in (6, 12, 24, 48, 100, 300, 1000, len(text)):
                start = int(rng.integers(0, max(len(text) - size, 0) + 1))
                piece = text[start : start + size]
                add(stay, piece, whole)
                letters = np.array(list(piece.decode("utf-8", "ignore")))
                add(go, "".join(rng.permutation(letters)).encode(), whole)
                if y in without:
                    add(go, piece, without[y])
            add(stay, before[:150] + b" " + text[:150], whole)
            before = text
    if not stay:
        return None
    stay, go = np.array(stay), np.array(go)
    places, floors = [], []
    for at in np.arange(0, bits + 1, 1.0):
        here, there = (x[np.abs(x[:, 0] - at) <= 0.75][:, 1] for x in (stay, go))
        if len(here) >= 50:
            low = np.quantile(here, rejected)
            far = np.median(there) if len(there) else low
            places.append(at)
            floors.append(min(low, (low + far) / 2))
    # more text never has to be less familiar
    return np.array([places, np.minimum.accumulate(floors[::-1])[::-1]]) if places else None


def train(
    sample: list[tuple[bytes, str]],
    bits: int = 14,
    width: int = 16,
    epochs: int = 6,
    rate: float = 8.0,
    batch: int = 64,
    rejected: float = 0.001,
    seed: int = 7,
) -> Model:
    """Fit on (lower-cased text, language); every fifth text is kept aside to calibrate.

    The temperature makes the mean log loss of the texts kept aside smallest; ``rejected`` is the share of
    pieces of them that may be less familiar than the floors. A text that mixes languages is still a text, so
    its probability rejects nothing.
    """
    languages = sorted({lang for _, lang in sample})
    rng = np.random.default_rng(seed)
    rows, where, target, aside = [], {n: i for i, n in enumerate(languages)}, [], []
    shares = np.zeros((len(languages), 1 << bits))
    for i, (text, lang) in enumerate(sample):
        if i % 5 == 4:
            aside.append((text, where[lang]))
            continue
        own = buckets(normal(text), bits)
        shares[where[lang]] += np.bincount(own, minlength=1 << bits) / max(len(own), 1)
        for piece in _pieces(text, rng):
            own = buckets(normal(piece), bits)
            if len(own):
                rows.append(np.unique(own, return_counts=True) + (len(own),))
                target.append(where[lang])
    embed = rng.uniform(-1 / width, 1 / width, (1 << bits, width)).astype(np.float32)
    weight = np.zeros((width, len(languages)), np.float32)
    weight += rng.normal(0, 0.1, weight.shape).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps = max(1, epochs * -(-len(rows) // batch))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            x = np.zeros((len(own), 1 << bits), np.float32)
            for k, i in enumerate(own):
                x[k, rows[i][0]] = rows[i][1] / rows[i][2]
            mean = x @ embed
            p = softmax(mean @ weight + bias)
            p[np.arange(len(own)), [target[i] for i in own]] -= 1
            p /= len(own)
            now = rate * (1 - step / steps)
            back = p @ weight.T
            weight -= now * (mean.T @ p) / 4
            bias -= now * p.sum(0) / 40
            used = np.unique(np.concatenate([rows[i][0] for i in own]))
            embed[used] -= now * width * (x[:, used].T @ back)
            step += 1
    shares /= np.maximum(shares.sum(axis=1, keepdims=True), 1e-9)
    table = np.column_stack([embed @ weight, _familiar(shares)]).astype(np.float32)
    model = Model(languages, table, bias, 1.0, None)
    if aside:
        logits = np.array([model.logits(t) for t, _ in aside])
        own = np.arange(len(aside)), np.array([y for _, y in aside])
        heats = np.geomspace(0.05, 20, 60)
        loss = [-np.log(softmax(logits / h)[own] + 1e-12).mean() for h in heats]
        model.temperature = float(heats[int(np.argmin(loss))])
        model.floors = _floors(aside, shares, rejected, np.random.default_rng(seed))
    return model


def _usable(text: str):
    value = F.col(text).cast("string")
    return F.lower(value).cast("binary"), F.coalesce(value.rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_languages(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 400,
    most_languages: int = 200,
    most_bytes: int = 20_000,
) -> Model | None:
    """A model from a bounded sample of the labelled documents that are not held out; None without any.

    The bounds: about ``per_language`` documents of each of the ``most_languages`` most frequent languages,
    none above ``most_bytes``. Documents are taken by a hash of their id, over the whole table.
    """
    lowered, letters = _usable(text)
    rows = docs.select(
        F.col(doc_id).cast("string").alias("id"), F.col(lang).cast("string").alias("lang"), lowered.alias("text"), letters.alias("ok"),
        held_out(doc_id).alias("out"),
    )
    rows = rows.where("NOT out AND ok AND id IS NOT NULL AND lang IS NOT NULL").where(F.octet_length("text") <= most_bytes)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).collect()
    if not counts:
        return None
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["n"])))])
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / (1 << 30)
    chosen = rows.where(place < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("text", "lang")
    sample = chosen.limit(2 * per_language * len(counts)).collect()
    return train(sorted((bytes(r["text"]), r["lang"]) for r in sample)) if sample else None


def identify_languages(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` (its probability) and ``rejected``.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is everything without a
    model. ``rejected`` is set too where the subwords are less familiar than calibrated for that much text, as
    in an unlearned language, code or letter junk; ``lang_pred`` and ``score`` stay the best guess there. Whole texts are read. Repeated rows each give their row, extra columns pass
    through.
    """
    lowered, letters = _usable(text)
    base = packed(docs, text=F.when(letters, lowered))
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        out, model = [], held.value
        for raw in texts:
            if not raw.is_valid or model is None:
                out.append({"lang": UNKNOWN, "score": 0.0, "rejected": True})
                continue
            lang, score, known = model.predict(raw.as_py())
            out.append({"lang": lang, "score": score, "rejected": not known})
        return pa.array(out, kind)

    said = F.arrow_udf(run, "lang string, score double, rejected boolean")
    out = base.withColumn("said", said("text"))
    return unpacked(out, lang_pred=F.col("said.lang"), score=F.col("said.score"), rejected=F.col("said.rejected"))
