"""Word shingles of a text as 64-bit hashes, and their parity sketches, computed on whole byte arrays."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

SIZE = 5
#: bytes of a text that are hashed at once; longer texts are cut at a blank
BLOCK = 1 << 20

_U = np.uint64
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + _U(1)
_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_CUT = re.compile(rb"[ \t-\r]")
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were asked for so far."""

    up = down = np.ones(1, np.uint64)

    @staticmethod
    def _row(base: int, size: int) -> np.ndarray:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up, cls.down = cls._row(_BASE, size), cls._row(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def _blocks(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > BLOCK and (m := _CUT.search(text, start + BLOCK)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word, A-Z lower-cased; words are what stands between blanks."""
    out = []
    for block in _blocks(text):
        raw = np.frombuffer(block, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _BLANK[raw], [True]])))
        up, down = _Powers.of(len(raw) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LOWER[raw] * up[: len(raw)], dtype=np.uint64)])
        start, end = edges[0::2], edges[1::2]
        out.append(mix((sums[end] - sums[start]) * down[start]))
    return np.concatenate(out)


_PLACE = mix(np.arange(1, SIZE + 1, dtype=np.uint64)) | _U(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingle hashes, ascending. Fewer words than a shingle has are one shingle, none give none."""
    words = word_hashes(text or b"")
    n = len(words)
    if n == 0:
        return words
    if n < SIZE:
        return mix((words * _PLACE[:n]).sum(keepdims=True) + _U(n))
    total = words[: n - SIZE + 1] * _PLACE[0]
    for k in range(1, SIZE):
        total = total + words[k : n - SIZE + 1 + k] * _PLACE[k]
    return np.unique(mix(total + _U(SIZE)))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    pair = np.array([hashes.sum(dtype=np.uint64), mix(hashes ^ _U(_BASE)).sum(dtype=np.uint64)])
    return tuple(pair.view(np.int64).tolist())


def sketch_tokens(hashes: np.ndarray, parts: int) -> np.ndarray:
    """A 64-bit token per part of the parity sketch that is not zero; with 0 parts a token per shingle.

    Each shingle flips one bit of one part, so sets differ in at most as many bits, and parts, as shingles. A
    part has 2**32 bits, few of them set: it is kept as the exclusive or of a random number for each set bit,
    which is updated by the shingle and tells equal parts from others.
    """
    if not parts:
        return mix(hashes ^ _U(0xD6E8FEB86659FD93))
    at = ((hashes >> _U(32)) * _U(parts)) >> _U(32)
    sketch = np.zeros(parts, np.uint64)
    np.bitwise_xor.at(sketch, at.astype(np.int64), mix((hashes & _U(0xFFFFFFFF)) + _U(_BASE)))
    own = np.flatnonzero(sketch)
    return mix(sketch[own] ^ mix(own.astype(np.uint64) * _U(_BASE) + _U(parts)))


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def bit_sketch(hashes: np.ndarray, bits: int) -> bytes:
    """A parity bit per place: each shingle flips one of ``bits`` (a power of two) places.

    Sets differ in at least as many shingles as their sketches differ in bits.
    """
    at = (mix(hashes ^ _U(0xA0761D6478BD642F)) & _U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").tobytes()


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch (64-bit words) that the same set has on fewer places."""
    while len(sketch) > words:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ, on the places that both have: a lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
