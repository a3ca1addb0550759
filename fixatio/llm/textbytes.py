"""Numpy helpers on texts that lie one after the other in a byte buffer."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, n at least; kept between calls."""
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, 1 << 16)
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE)]), dtype=np.uint64)
        _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE)]), dtype=np.uint64)
    return _powers, _inverses


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """c with c[0] = 0, for ``span_hash``."""
    power, _ = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[start:stop] for many spans; equal bytes give equal hashes, wherever they lie."""
    _, inverse = powers(len(c))
    return mix((c[stop] - c[start]) * inverse[start])


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text number of each word: runs of bytes other than ASCII white space."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    word = ~_SPACE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    edge = at[:-1][at[:-1] < n]
    before[edge] = False
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    after[edge[edge > 0] - 1] = False
    start = np.flatnonzero(word & ~before)
    stop = np.flatnonzero(word & ~after) + 1
    return start, stop, np.searchsorted(at, start, side="right") - 1
