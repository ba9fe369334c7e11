"""Words of texts as numpy arrays: byte tables, word limits and 64-bit hashes, a batch at a time.

A word is a run of bytes that are digits, letters a-z (A-Z are lower-cased) or not ASCII; this equals the pattern
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` on text whose A-Z are lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True
_WEIGHTS = np.random.default_rng(20240607).integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHINGLE = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Words:
    """Words of a list of texts. ``first[d]:first[d + 1]`` are the words of text d; ``lo``, ``hi`` limit each in ``data``."""

    def __init__(self, texts: list):
        parts = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.n_docs = len(parts)
        self.data = LOWER[np.frombuffer(b"\x00".join(parts), np.uint8)]
        begin = np.zeros(self.n_docs + 1, np.int64)
        np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
        self.begin = begin
        inside = IS_WORD[self.data]
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.lo, self.hi = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.first = np.searchsorted(self.lo, begin)
        size = self.hi - self.lo
        if len(self.lo):
            at = np.concatenate(([0], np.cumsum(size)[:-1]))
            place = np.arange(int(size.sum())) - np.repeat(at, size)
            terms = (self.data[inside].astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 0xFFFF]
            self.hash = mix(np.add.reduceat(terms, at) + size.astype(np.uint64))
        else:
            self.hash = np.zeros(0, np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def word(self, i: int) -> bytes:
        return self.data[self.lo[i] : self.hi[i]].tobytes()

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of k words, and where the runs of each text begin (n_docs + 1 limits). A text of fewer
        words, but not none, has one run of all its words."""
        n, counts = len(self.hash), self.counts
        full = np.zeros(max(0, n - k + 1), np.uint64)
        for j in range(k if n >= k else 0):
            full += self.hash[j : n - k + 1 + j] * _SHINGLE[j]
        per = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
        limits = np.concatenate(([0], np.cumsum(per)))
        out = np.zeros(int(limits[-1]), np.uint64)
        long_docs = counts >= k
        if long_docs.any():
            take = np.repeat(self.first[:-1][long_docs] - limits[:-1][long_docs], per[long_docs])
            put = np.repeat(long_docs, per)
            where = np.flatnonzero(put)
            out[where] = full[where + take]
        for d in np.flatnonzero((counts > 0) & ~long_docs):
            h = self.hash[self.first[d] : self.first[d + 1]]
            out[limits[d]] = (h * _SHINGLE[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))
        return mix(out), limits


def chunks(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Split a batch so that no part has many more than ``most`` characters; a longer text is a part of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)
