"""Stretches of a text whose words repeat with a period, found among its suffixes.

Suffixes that agree on many words are united first: edges between neighbours of the sorted suffixes are
taken by decreasing common length, as in Kruskal's algorithm. Each class keeps its positions in order, and
positions that become neighbours within their common length start a run.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import packed, unpacked, utf8

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeats(ids: np.ndarray, size: int) -> bool:
    """Whether some ``size`` consecutive ids may stand at two places; never False where they do."""
    if len(ids) <= size:
        return False
    with np.errstate(over="ignore"):
        grams = (ids.astype(np.uint64) + np.uint64(1)) * _FACTOR
        grams ^= grams >> np.uint64(29)
        have = 1
        while have < size:
            step = min(have, size - have)
            grams = grams[:-step] * _FACTOR + (grams[step:] ^ (grams[step:] >> np.uint64(32)))
            have += step
    grams.sort()
    return bool((grams[1:] == grams[:-1]).any())


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, and how many ids each shares with the one after it."""
    n = len(ids)
    ranks = [np.unique(ids, return_inverse=True)[1].astype(np.int64) + 1]
    width = 1
    while width < n and ranks[-1].max() < n:
        after = np.zeros(n, np.int64)
        after[: n - width] = ranks[-1][width:]
        ranks.append(np.unique(ranks[-1] * (n + 1) + after, return_inverse=True)[1].astype(np.int64) + 1)
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    left, right = order[:-1].copy(), order[1:].copy()
    shared = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        size = 1 << level
        inside = np.maximum(left, right) + size <= n
        same = np.zeros(n - 1, bool)
        same[inside] = ranks[level][left[inside]] == ranks[level][right[inside]]
        step = np.where(same, size, 0)
        shared += step
        left += step
        right += step
    return order, shared


def seeds(order: np.ndarray, shared: np.ndarray, least: int):
    """(position, distance, common length) of positions that become neighbours, by decreasing common length.

    Classes are stretches of ``order``; an edge unites those on its two sides, the smaller into the larger.
    Neighbours are those of the united class, and pairs further apart than their common length are left out.
    """
    edges = np.flatnonzero(shared >= least)
    edges = edges[np.argsort(-shared[edges], kind="stable")]
    root: dict[int, int] = {}
    places: dict[int, list[int]] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while (up := root.get(x, x)) != top:
            root[x], x = top, up
        return top

    for edge, common in zip(edges.tolist(), shared[edges].tolist(), strict=True):
        a, b = find(edge), find(edge + 1)
        large = places.pop(a, None) or [int(order[a])]
        small = places.pop(b, None) or [int(order[b])]
        if len(large) < len(small):
            a, b, large, small = b, a, small, large
        root[b] = a
        for k, place in enumerate(small):
            at = bisect_left(large, place)
            if at and (not k or small[k - 1] < large[at - 1]) and place - large[at - 1] <= common:
                yield large[at - 1], place - large[at - 1], common
            if at < len(large) and (k + 1 == len(small) or small[k + 1] > large[at]) and large[at] - place <= common:
                yield place, large[at] - place, common
        if 8 * len(small) < len(large):
            for place in small:
                insort(large, place)
        else:
            large += small
            large.sort()
        places[a] = large


def find_periodic(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least ``least`` ids and ``times`` periods, by start and period.

    In such a run, the first position and the one a period later share all but one period of it, at least
    ``least - least // times`` ids, and no other position of the same content stands between them. So they
    become neighbours, before any later pair of the same run: the first seed of an end and period is the run.
    """
    shortest = least - least // times
    if len(ids) < least or not repeats(ids, shortest):
        return []
    found: dict[tuple[int, int], int] = {}
    for place, period, common in seeds(*suffix_order(ids), shortest):
        found.setdefault((place + period + common, period), place)
    runs = [(start, end - start, period) for (end, period), start in found.items()]
    return sorted((r for r in runs if r[1] >= max(least, times * r[2])), key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _finder(least: int, times: int):
    kind = pa.struct([("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])

    def run(text: pa.Array) -> pa.Array:
        out = []
        for raw in text:
            words = (raw.as_py() or b"").split()
            known: dict[bytes, int] = {}
            ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
            runs = find_periodic(ids, least, times)
            kept = collapsed(words, runs) if runs else words
            out.append(
                {
                    "n_words": len(words),
                    "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs],
                    "collapsed": b" ".join(kept).decode("utf-8", "replace"),
                }
            )
        return pa.array(out, kind)

    return F.arrow_udf(run, "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def find_runs(docs: DataFrame, text: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """The documents with ``n_words``, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a stretch of words with smallest period q and at least ``least`` words and ``times`` periods
    (2 or more, at most ``least``) that no neighbouring word extends keeping q. ``collapsed`` are the words, joined by one blank,
    without those that some run holds after its first q words. Words are what stands between ASCII blanks,
    compared byte by byte. Null and empty texts have no words, no runs and an empty ``collapsed``. Every row
    gives its row, repeated ones too; ids play no part. Extra columns pass through; one named as a new column
    is replaced. An empty table gives no rows. A text is searched by one task; where it repeats ``least`` words,
    this takes 8 bytes for each word and each doubling of the longest repeated length.
    """
    if not 2 <= times <= least:
        raise ValueError("times must be 2 or more, and at most least")
    out = packed(docs, text=utf8(F.col(text))).withColumn("found", _finder(least, times)("text"))
    return unpacked(out, n_words=F.col("found.n_words"), runs=F.col("found.runs"), collapsed=F.col("found.collapsed"))


def best_run() -> Column:
    """The run of greatest length/period, ties to the smallest start, then period; null where there is none."""

    def better(a, b):
        """Runs come by start and period, so the first of equals stays."""
        over = b["length"].cast("decimal(19,0)") * a["period"] - a["length"].cast("decimal(19,0)") * b["period"]
        return F.when(a.isNull() | (over > 0), b).otherwise(a)

    nothing = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate("runs", nothing, better)
