"""Token counts of whole texts under a public tokenizer, as its library gives them.

Texts are encoded in batches of bounded bytes inside Arrow functions that return lengths only. A byte-level
pair encoding never merges across a blank that follows a non-blank, so texts are cut there: equal stretches
of a batch are encoded once, and a text above ``long_bytes`` goes to several tasks piece by piece.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import packed, unpacked
from tidewell.session import written

#: bytes given to the library at once
BATCH_BYTES = 1 << 20
#: counts of stretches that a worker remembers
KNOWN = 300_000

# A blank of any kind before a space: the space is then no safe place.
_UNSURE = re.compile(r"\s ")
_SAFE = re.compile(r"(?<=\S)(?=[ \t-\r])")


def _sliced(texts: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """The texts in slices of about ``most`` bytes; a longer text is a slice of its own."""
    part: list[str] = []
    size = 0
    for text in texts:
        if part and size + len(text) > most:
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text) if text.isascii() else len(text.encode())
    if part:
        yield part


def _in_slices(encode: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    return lambda texts: [n for part in _sliced(texts) for n in encode(part)]


class _Stretches:
    """Counts texts as the sum over what stands between safe places; each distinct stretch is encoded once."""

    def __init__(self, encode: Callable[[list[str]], list[int]]) -> None:
        self.encode = encode
        self.known: dict[str, int] = {}

    @staticmethod
    def cut(text: str) -> list[str]:
        """Stretches between safe places, which joined again give the text."""
        if _UNSURE.search(text):
            return _SAFE.split(text)
        first, *others = text.split(" ")
        return [first, *[f" {x}" for x in others]]

    def __call__(self, texts: list[str]) -> list[int]:
        cut = [self.cut(t) for t in texts]
        new = list({s for own in cut for s in own if s not in self.known})
        if len(self.known) + len(new) > KNOWN:
            self.known.clear()
            new = list({s for own in cut for s in own})
        self.known.update(zip(new, self.encode(new), strict=True))
        return [sum(map(self.known.__getitem__, own)) for own in cut]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to counts, and whether texts may be cut at safe places."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return _in_slices(lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    encode = _in_slices(lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    rule = kind.get("pre_tokenizer") or {}
    cuts = rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    whole = all(not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in kind.get("added_tokens", []))
    if cuts and whole and not kind.get("normalizer"):
        return _Stretches(encode), True
    return encode, False


def _place(path: str | None) -> str:
    """The vocabulary file, looked up where the task runs."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(text: str, most: int) -> Iterator[str]:
    """Stretches of about ``most`` characters, cut at safe places; one without such a place stays whole."""
    start = 0
    while len(text) - start > most and (m := _SAFE.search(text, start + most)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


def _lengths(path: str | None):
    def run(text: pa.Array) -> pa.Array:
        count, _ = counter(_place(path))
        out: list[int] = []
        for part in _sliced([t or "" for t in text.to_pylist()]):
            out += count(part)
        return pa.array(out, pa.int64())

    return F.arrow_udf(run, "long")


def _cut(path: str | None, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cuts = counter(_place(path))
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                for piece in pieces(text.as_py(), most) if cuts else (text.as_py(),):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()], pa.string()), pa.array([piece], pa.string())], ["key", "piece"]
                    )

    return run


def count_tokens(
    docs: DataFrame, text: str = "text", tokenizer: str | None = None, limit: int = 1024, long_bytes: int = 4 << 20
) -> DataFrame:
    """The documents with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``tokenizer`` is the path of a ``.json`` file (tokenizers) or a ``.model`` file (sentencepiece) that every
    executor has; None is the 50 k byte-level vocabulary. No begin, end or other tokens are added; special
    strings inside a text are what the library makes of them by default. Nothing is cut off or padded: the
    count is that of the whole text. Texts above ``long_bytes`` are cut at safe places into pieces that
    spread over the cluster, equal ones once; where a tokenizer has no safe places they are counted whole. A null
    text counts as empty, with 0 bytes and 0 tokens. Every row gives its row, repeated ones too; ids play
    no part. Extra columns pass through; one named as a new column is replaced. An empty table gives no rows.
    """
    base = packed(docs, text=F.coalesce(F.col(text).cast("string"), F.lit(""))).withColumn(
        "n_bytes", F.octet_length("text").cast("long")
    )
    count = _lengths(tokenizer)
    short = base.where(F.col("n_bytes") <= long_bytes).select("_row", "n_bytes", count("text").alias("n_tokens"))
    long = base.where(F.col("n_bytes") > long_bytes).withColumn("key", F.sha2("text", 256))
    spread = (
        long.select("key", "text").dropDuplicates(["key"]).mapInArrow(_cut(tokenizer, long_bytes // 4), "key string, piece string")
    )
    spread = spread.repartition(F.xxhash64("piece")).select("key", count("piece").alias("n"))
    totals = written(spread.groupBy("key").agg(F.sum("n").alias("n_tokens")), "long_texts")
    out = short.unionByName(long.join(totals, "key").select("_row", "n_bytes", "n_tokens"))
    return unpacked(
        out, n_bytes=F.col("n_bytes"), n_tokens=F.col("n_tokens"), over_limit=F.col("n_tokens") > limit
    )
