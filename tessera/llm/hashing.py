"""Words and word n-grams of whole Arrow batches as 64-bit hashes, by numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Space, tab, line feed, vertical tab, form feed, carriage return.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers.clear() if len(_powers) > 8 else None
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and how many words lie before each text's end: the words of
    text i are numbers count[i] to count[i + 1]."""
    solid = ~WHITE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    first = ends[:-1][ends[:-1] < ends[1:]]
    begin[first] = solid[first]
    finish = solid.copy()
    finish[:-1] &= ~solid[1:]
    last = first[first > 0] - 1
    finish[last] = solid[last]
    if len(data):
        finish[-1] = solid[-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, ends)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z as a-z if lower)."""
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[_FOLD[data] if lower else data] * _power(_BASE, n), out=total[1:])
    raw = (total[stops] - total[starts]) * _power(_BASE_INVERSE, n)[starts]
    return mix(raw ^ mix((stops - starts).astype(np.uint64)))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0xD6E8FEB86659FD93) + mix(b + _U(0x632BE59BD9B4E019)))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words by doubling: a window is its first and its last half, which may overlap."""
    if n <= 1:
        return h
    half = (n + 1) // 2
    g = grams(h, half)
    return pair(g[: max(0, len(h) - n + 1)], g[n - half :]) if len(h) >= n else np.zeros(0, np.uint64)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... (lengths[i] of them) of every i, in order."""
    if not len(starts) or not (total := int(lengths.sum())):
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
