"""Word shingles of whole texts as 64-bit hashes, computed for many texts at once in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.  A text's set holds its distinct ``k``-word shingles;
with fewer words than ``k`` the whole sequence is its one shingle; a text without words has an empty set.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[raw]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    cut = offsets[(offsets < n)]
    starts[cut] = inside[cut]
    at = np.flatnonzero(starts)
    doc = np.searchsorted(offsets, at, "right") - 1
    count = np.bincount(doc, minlength=len(offsets) - 1)
    if not len(at):
        return np.zeros(0, np.uint64), count
    # eight bytes at a time: the rank of a byte within its word chooses its lane and its round
    value = (_LOWER[raw].astype(np.uint64) + np.uint64(1)) * inside
    rank = np.arange(n) - np.repeat(at, np.diff(np.append(at, n))) if at[0] == 0 else np.concatenate([np.zeros(at[0], np.int64), np.arange(at[0], n) - np.repeat(at, np.diff(np.append(at, n)))])
    weight = _powers(int(rank.max()) + 1)[rank]
    return mix(np.add.reduceat(value * weight, at) + np.uint64(BASE)), count


_POWERS = np.zeros(0, np.uint64)


def _powers(n: int) -> np.ndarray:
    """Pseudo-random odd weights, one for each place in a word."""
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = mix(np.arange(max(64, 2 * n), dtype=np.uint64) * np.uint64(BASE) + np.uint64(12345)) | np.uint64(1)
    return _POWERS


def shingle_hashes(words: np.ndarray, count: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle with repeats, number of shingles of each text)."""
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    total = int(size.sum())
    if total == 0:
        return np.zeros(0, np.uint64), size
    first = np.cumsum(count) - count
    begin = np.arange(total) + np.repeat(first - (np.cumsum(size) - size), size)
    length = np.repeat(np.minimum(count, k), size)
    out = np.zeros(total, np.uint64)
    for j in range(k):
        ok = length > j
        out[ok] = mix(out[ok] * np.uint64(3) + words[begin[ok] + j] + np.uint64(j + 1))
    return out, size


def distinct_shingles(raw: np.ndarray, offsets: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, size = shingle_hashes(*word_hashes(raw, offsets), k)
    ends = np.cumsum(size)
    out = []
    for a, b in zip((ends - size).tolist(), ends.tolist(), strict=True):
        s = np.sort(hashes[a:b])
        if b - a > 1:
            keep = np.empty(b - a, bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            s = s[keep]
        out.append(s)
    return out
