"""Rolling hashes of words, lines and word n-grams over whole batches of texts, in numpy.

All arithmetic is modulo 2**64. A span's hash is a difference of prefix sums of
``T[byte] * P**i``, moved back by ``P**-start``; equal spans have equal hashes wherever
they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
P = 0x9E3779B97F4A7C55 | 1
P_INVERSE = pow(P, -1, 1 << 64)
Q = 0xD6E8FEB86659FD93


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = x + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
    return z ^ (z >> U(31))


BYTE = mix(np.arange(256, dtype=U), 7)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: 1 where a code point begins.
HEAD = np.array([(b & 0xC0) != 0x80 for b in range(256)], np.int64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, 1 << max(16, int(n).bit_length()))[:n]


class Texts:
    """Words of a run of texts. ``data``: their UTF-8 bytes; ``off``: where each begins."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off, self.n = data, off, len(off) - 1
        size = len(data)
        self.prefix = np.zeros(size + 1, U)
        np.cumsum(BYTE[data] * powers(P, size), out=self.prefix[1:])
        self.points = np.zeros(size + 1, np.int64)
        np.cumsum(HEAD[data], out=self.points[1:])
        inside = ~SPACE[data]
        some = off[:-1] < off[1:]
        first, last = off[:-1][some], off[1:][some] - 1
        edge = inside.copy()
        edge[1:] &= ~inside[:-1]
        edge[first] = inside[first]
        self.start = np.flatnonzero(edge)
        edge = inside
        keep = edge[last].copy()
        edge[:-1] &= SPACE[data[1:]] if size else False
        edge[last] = keep
        self.end = np.flatnonzero(edge) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        self.chars = self.points[self.end] - self.points[self.start]

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of byte spans; their lengths take part."""
        moved = (self.prefix[end] - self.prefix[start]) * powers(P_INVERSE, len(self.data) + 1)[start]
        return mix(moved ^ ((end - start).astype(U) << U(40)))

    def words(self) -> np.ndarray:
        return self.spans(self.start, self.end)

    def per_doc(self, doc: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        out = np.bincount(doc, weight, self.n)
        return out if weight is None else np.rint(out).astype(np.int64)


def ngram(words: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all runs of n words, over text borders too."""
    m = max(len(words) - n + 1, 0)
    out = np.zeros(m, U)
    for k in range(n):
        out += words[k : k + m] * U(pow(Q, k, 1 << 64))
    return out


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key stands more than once."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(len(keys), bool)
    twice = np.unique(twice)
    at = np.searchsorted(twice, keys)
    at[at == len(twice)] = 0
    return twice[at] == keys
