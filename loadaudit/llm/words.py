"""Words and word shingles of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return. Fingerprints are compared only for equality; texts are never cut.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_powers = np.ones(1, U)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over all 64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers, the same on every machine."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * _BASE) | U(1)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1024), _BASE)]), dtype=U)
    return _powers


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, index of the first word of each text and the end) of the words."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    word = ~SPACE[buf]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    begins[cut] = word[cut]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    ends[cut - 1] = word[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.empty(0, U)
    length = ends - starts
    first = np.concatenate([[0], np.cumsum(length)[:-1]])
    pos = np.arange(int(length.sum())) - np.repeat(first, length)
    letters = buf[pos + np.repeat(starts, length)].astype(U) + U(1)
    with np.errstate(over="ignore"):
        return mix(np.add.reduceat(letters * powers(int(length.max()) + 1)[pos], first) + length.astype(U) * _BASE)


def shingles(hashes: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-word shingles, index of the first shingle of each text and the end).
    A text of one to n-1 words has one shingle, of all its words; one without words has
    none."""
    count = np.diff(at)
    out = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    to = np.concatenate([[0], np.cumsum(out)])
    if not to[-1]:
        return np.empty(0, U), to
    q = constants(n, 1)
    padded = np.concatenate([hashes, np.zeros(n, U)])
    first = np.repeat(at[:-1] - to[:-1], out) + np.arange(to[-1])
    left = np.repeat(at[1:], out) - first
    total = np.zeros(to[-1], U)
    with np.errstate(over="ignore"):
        for j in range(n):
            total += np.where(left > j, padded[first + j] * q[j], U(0))
        return mix(total + np.minimum(left, n).astype(U)), to


def of_texts(buf: np.ndarray, off: np.ndarray, n: int = 5):
    """(word hashes, their index by text, shingles, their index by text)."""
    starts, ends, at = word_spans(buf, off)
    h = word_hashes(buf, starts, ends)
    return h, at, *shingles(h, at, n)


def sets(values: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct values of each text."""
    return [np.unique(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
