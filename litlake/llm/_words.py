"""Words and five-word shingles of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

#: Words of a shingle.
WIDTH = 5
#: Odd constants of a polynomial over characters and of a finalising mixer.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers without visible structure."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


_cache: list[np.ndarray] = [*_powers(1)]


def lower(text: str) -> str:
    """Lower case with every character in its place."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _word_table() -> np.ndarray:
    t = np.ones(0x3100, bool)
    t[:128] = [chr(c).isalnum() for c in range(128)]
    for a, b in ((0x80, 0xA9), (0xAB, 0xB2), (0xB4, 0xB5), (0xB6, 0xB9), (0xBB, 0xC0), (0xD7, 0xD8), (0xF7, 0xF8), (0x1680, 0x1681), (0x2000, 0x2070), (0x2190, 0x2C00), (0x3000, 0x3005), (0x3008, 0x3021)):
        t[a:b] = False
    return t


#: True for code points that are part of words: ASCII letters and digits, and all others but spaces, punctuation and symbols.
WORD_CHARS = _word_table()


@dataclass
class Words:
    """Words of a list of texts. ``first[d]`` is text d's first word; starts and ends are code points within its text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def of(self, d: int) -> slice:
        return slice(int(self.first[d]), int(self.first[d + 1]))


def words(texts: Sequence[str | None]) -> Words:
    """Maximal runs of word characters of the lower-cased texts; null: no word. Equal words have equal hashes."""
    low = [lower(t) if t else "" for t in texts]
    joined = "\n".join([*low, ""])
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(cp)
    if len(_cache[0]) < n + 1:
        _cache[:] = _powers(n + 1)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = WORD_CHARS[np.minimum(cp, len(WORD_CHARS) - 1)]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((cp + np.uint32(1)).astype(np.uint64) * _cache[0][:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _cache[1][starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(t) + 1 for t in low), np.int64, len(low))
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    first = np.searchsorted(starts, offsets)
    back = np.repeat(offsets[:-1], np.diff(first))
    return Words(hashes, starts - back, ends - back, first)


def shingles(w: Words, d: int) -> np.ndarray:
    """Hashes of text d's five-word shingles by first word; a text of one to four words is one shingle."""
    h = w.hashes[w.of(d)]
    return shingles_of(h)


def shingles_of(h: np.ndarray) -> np.ndarray:
    if not len(h):
        return h
    k = min(WIDTH, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = out * _BASE + h[i : i + n]
    return mix(out)
