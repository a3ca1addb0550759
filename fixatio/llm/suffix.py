"""Suffix arrays of byte strings in numpy, and the common prefixes of neighbours in them."""

from __future__ import annotations

import numpy as np


def first_eight(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number; zeros follow the text."""
    n = len(t)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = t
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= padded[k:k + n] << np.uint64(56 - 8 * k)
    return out


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes in order, by Larsson and Sadakane's refinement.

    A suffix's rank is the place of the head of its group of equals. Each round doubles the
    length that is told apart: within groups, suffixes are ordered by the rank of what follows.
    Groups of one are finished and not touched again.
    """
    n = len(t)
    key = first_eight(t)
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.zeros(n + 1, np.int64)  # beyond the text: 0, before all others
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    told = 8
    open_at = np.flatnonzero(~new | ~np.append(new[1:], True))
    while len(open_at):
        here = sa[open_at]
        pair = rank[here] << 32 | rank[np.minimum(here + told, n)]
        order = np.argsort(pair, kind="stable")
        here, pair = here[order], pair[order]
        sa[open_at] = here
        head = np.ones(len(here), bool)
        head[1:] = pair[1:] != pair[:-1]
        rank[here] = np.maximum.accumulate(np.where(head, open_at, 0)) + 1
        alone = head & np.append(head[1:], True)
        open_at = open_at[~alone]
        told *= 2
    return sa


def common_prefixes(t: np.ndarray, sa: np.ndarray, start: np.ndarray, count: np.ndarray, depth: int) -> np.ndarray:
    """Kasai's common prefixes, up to ``depth``: at place p, of the suffixes at p - 1 and p.

    Given for the suffixes start[k], ..., start[k] + count[k] - 1 of every string k, -1 elsewhere.
    All strings advance in step; a suffix's prefix is that of the one before less a byte at least,
    which holds for suffixes sorted to their ends.
    """
    n = len(t)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    eight, byte = np.append(first_eight(t), np.uint64(0)), np.append(t, np.uint8(0))
    out = np.full(n + 1, -1, np.int64)
    h = np.zeros(len(start), np.int64)
    for step in range(int(count.max()) if len(count) else 0):
        k = np.flatnonzero(count > step)
        i = start[k] + step
        p = place[i]
        j, l = sa[p - 1], np.maximum(h[k] - 1, 0)
        go = np.flatnonzero(p > 0)
        l[p == 0] = 0
        while len(go):  # by eight bytes, as long as both strings have them
            a, b = i[go] + l[go], j[go] + l[go]
            same = (l[go] + 8 <= depth) & (np.maximum(a, b) + 8 <= n)
            same &= eight[np.minimum(a, n)] == eight[np.minimum(b, n)]
            go = go[same]
            l[go] += 8
        go = np.flatnonzero((p > 0) & (l < depth))
        while len(go):
            a, b = i[go] + l[go], j[go] + l[go]
            same = (l[go] < depth) & (np.maximum(a, b) < n)
            same &= byte[np.minimum(a, n)] == byte[np.minimum(b, n)]
            go = go[same]
            l[go] += 1
        h[k] = l
        out[p] = l
    return out
