"""Distinct word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import caches

_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit integers (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words; the most common ones are remembered."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        from xxhash import xxh3_64_intdigest

        self.most, self.digest = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.digest(word)
        if len(self) < self.most:
            self[word] = h
        return h


_WORDS: list[WordHashes] = []
caches.register("shingles", _WORDS.clear)


def shingle_sets(texts: pa.Array, width: int = 5, at_once: int = 200_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) for runs of rows; the set of a row is sorted and lies between its bounds.

    Words are runs of other than ASCII white space, A-Z in lower case. A text of fewer words than the width has one shingle,
    the sequence of all; one without words has none.
    """
    caches.take("shingles")
    if not _WORDS:
        _WORDS.append(WordHashes())
    known, n_rows, at = _WORDS[0].__getitem__, len(texts), 0
    while at < n_rows:
        words, counts = [], []
        end, total = at, 0
        while end < n_rows and total < at_once:
            text = texts[end].as_py()
            own = text.encode("utf-8", "surrogatepass").lower().split() if text else []
            words.append(own)
            counts.append(len(own))
            total += len(own)
            end += 1
        n = np.array(counts, np.int64)
        h = np.fromiter((known(w) for own in words for w in own), np.uint64, total)
        starts = np.concatenate(([0], np.cumsum(n)))[:-1]
        rolled = np.zeros(max(0, total), np.uint64)
        for j in range(width):  # words beyond a text count only where it is too short to have this shingle
            part = mixed(h[j:] + _MULT[j % 5])
            if j == 0:
                rolled[:] = part
            else:
                rolled[: max(0, total - j)] = mixed(rolled[: max(0, total - j)] * np.uint64(0x9FB21C651E98DF25) + part)
        m = np.where(n >= width, n - width + 1, 0)
        upto = np.concatenate(([0], np.cumsum(m)))
        rows = np.repeat(np.arange(len(n)), m)
        values = rolled[np.repeat(starts, m) + np.arange(upto[-1]) - upto[:-1][rows]]
        short = np.flatnonzero((n > 0) & (n < width))
        if len(short):
            alone = np.array([known(b"\x00".join(words[i]) + b"\x00%d" % n[i]) for i in short], np.uint64)
            rows, values = np.concatenate((rows, short)), np.concatenate((values, alone))
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        rows, values = rows[new], values[new]
        yield at, values, np.searchsorted(rows, np.arange(len(n) + 1))
        at = end
