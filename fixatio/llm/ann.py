"""Approximate nearest neighbours by collision counting.

Unit vectors are projected on random lines; each line is a sorted array of its own. A query opens
a window around itself on every line, and wider windows by virtual rehashing, radius after radius:
the windows of a radius contain those before, so each vector's count of lines on which it collides
only grows. Vectors that reach the collision threshold are verified by their exact cosine. A
search ends when the k-th verified vector is within the radius.

The windows hold most vectors of a line, so what is counted are the lines on which a vector is
outside: collisions are the other lines. Vectors lie in cells of bounded size. A query first
searches one cell; a few of its vectors, verified at the start, tell how near the first window must be.
The distance of its k-th neighbour there is the radius at which it searches all other cells, once.
"""

from __future__ import annotations

from math import ceil, log, sqrt
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame

from fixatio.llm.vectorgrid import best_in_two_passes, k_best, packed

#: Half-width of a window as a multiple of the radius that is searched, and the factor to the next radius.
WIDTH, STEP = 2.0, 1.05
#: Vectors that are verified at the start, and the first radius as a part of the distance of the k-th of them.
FEW, FIRST = 128, 0.8
#: Shares of the vectors at the radius that are missed, and of those FAR times as far that are verified.
MISSED, VERIFIED, FAR = 0.001, 0.05, 1.25
_SLACK = 1e-6  # rounding of distances


def _plan() -> tuple[int, int]:
    """Lines, and on how many of them a vector may be outside the window.

    The difference of two vectors at distance r is normal with deviation r on a random line,
    whatever their length, so they collide in a window of half-width w with P(|N| <= w / r).
    Windows grow with the radius, hence one plan serves all radii.
    """
    unit = NormalDist()
    near, far = (2 * unit.cdf(x) - 1 for x in (WIDTH, WIDTH / FAR))
    miss = unit.inv_cdf(1 - MISSED) * sqrt(near * (1 - near))
    more = unit.inv_cdf(1 - VERIFIED) * sqrt(far * (1 - far))
    lines = ceil(((miss + more) / (near - far)) ** 2)
    return lines, ceil(lines * (1 - near) + miss * sqrt(lines))


LINES, OUTSIDE = _plan()


def _lines(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed + dim).standard_normal((dim, LINES)).astype(np.float32)


def _unit(v: np.ndarray) -> np.ndarray:
    """Scale first: squares of very large or small components leave the range of doubles."""
    w = v / np.abs(v).max(1, keepdims=True)
    return w / np.sqrt((w * w).sum(1, keepdims=True))


class _Windows:
    """Sorted projections of a cell, and the windows of queries on them, for radii in turn."""

    def __init__(self, unit: np.ndarray, a: np.ndarray, own: np.ndarray, radii: np.ndarray):
        place = np.ascontiguousarray((unit.astype(np.float32) @ a).T)
        self.n, self.order = len(unit), np.argsort(place, axis=1)
        line, half = np.take_along_axis(place, self.order, 1), (WIDTH * radii).astype(np.float32)
        self.lo, self.hi = (np.stack([  # query x line x radius
            np.searchsorted(line[j], own[:, j, None] + sign * half, side=side) for j in range(LINES)
        ], 1) for sign, side in ((-1, "left"), (1, "right")))

    def outside(self, query: int) -> np.ndarray:
        """On how many lines each vector is outside the first window."""
        lo, hi = self.lo[query, :, 0].tolist(), self.hi[query, :, 0].tolist()
        parts = [o[:i] for o, i in zip(self.order, lo)] + [o[i:] for o, i in zip(self.order, hi)]
        return np.bincount(np.concatenate(parts), minlength=self.n)

    def enter(self, query: int, at: int) -> np.ndarray:
        """On how many lines each vector is inside the window ``at``, but not inside the one before."""
        lo, hi = self.lo[query, :, at - 1:at + 1].tolist(), self.hi[query, :, at - 1:at + 1].tolist()
        parts = [o[j:i] for o, (i, j) in zip(self.order, lo)] + [o[i:j] for o, (i, j) in zip(self.order, hi)]
        return np.bincount(np.concatenate(parts), minlength=self.n)


def searcher(seed: int = 8, verified: list | None = None):
    """The search of one cell; ``verified``, if given, gets the number of verified vectors of each query."""
    def search(queries: tuple, documents: tuple, k: int, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query rows, document rows and cosines of each query's k best verified documents, those
        within a distance if ``within`` has one for the query (infinite: none is known)."""
        _, q_uids, q = queries
        ids, uids, x, _ = documents
        uq, ux = _unit(q), _unit(x)
        a, known = _lines(x.shape[1], seed), np.full(len(q), np.inf) if within is None else within
        # Without a distance that is known, that of the k-th of a few vectors bounds the radii.
        first = uq @ ux[:FEW].T
        first[uids[:FEW] == q_uids[:, None]] = -np.inf
        bound = np.full(len(q), -np.inf) if first.shape[1] < k else np.partition(first, first.shape[1] - k, 1)[:, first.shape[1] - k]
        bound = np.sqrt(np.maximum(0, 2 - 2 * np.minimum(1, bound)))
        fixed = np.isfinite(known)
        steps = STEP ** np.arange(1 if fixed.all() else 1 + ceil(-log(FIRST) / log(STEP)))
        radii = np.where(fixed, known, FIRST * np.where(np.isfinite(bound), bound, 2.0))[:, None] * steps + _SLACK
        windows = _Windows(ux, a, uq.astype(np.float32) @ a, radii)
        rows, found, score = [], [], []
        for i in range(len(q)):
            s = np.full(len(x), -np.inf)  # cosines of the verified vectors
            left = uids != q_uids[i]  # neither verified nor the query itself
            if not fixed[i]:
                s[:FEW] = first[i]
                left[:FEW] = False
            for at in range(1 if fixed[i] else len(steps)):
                outside = windows.outside(i) if at == 0 else outside - windows.enter(i, at)  # noqa: F821
                new = np.flatnonzero(left & (outside <= OUTSIDE))
                s[new] = ux[new] @ uq[i]
                left[new] = False
                if len(x) >= k and 2 - 2 * np.partition(s, len(s) - k)[len(s) - k] <= radii[i, at] ** 2:
                    break
            else:
                if not fixed[i] and not np.isfinite(bound[i]):  # hardly any vectors
                    new = np.flatnonzero(left)
                    s[new] = ux[new] @ uq[i]
            if verified is not None:
                verified.append(int((s > -np.inf).sum()))
            near = np.flatnonzero(s > -np.inf)
            if len(near) > k:  # products of equal vectors may differ in the last digit
                near = near[s[near] >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9]
            exact = cosines(q[i], x[near])
            pick = k_best(exact, ids[near], uids[near], k)
            rows.append(np.full(len(pick), i))
            found.append(near[pick])
            score.append(exact[pick])
        return np.concatenate(rows), np.concatenate(found), np.concatenate(score)

    return search


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosines of original vectors, in double precision; equal vectors have equal ones."""
    def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (b * a).sum(1) / (np.sqrt((b * b).sum(1)) * np.sqrt((a * a).sum()))

    with np.errstate(over="ignore", under="ignore", invalid="ignore", divide="ignore"):
        out = ratio(q, x)
    bad = ~np.isfinite(out)
    if bad.any():  # beyond the range of squares
        out[bad] = ratio(q / np.abs(q).max(), x[bad] / np.abs(x[bad]).max(1, keepdims=True))
    return out


def nearest(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", seed: int = 8) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found by cosine for each row that ``query``
    selects, among all other rows; ties to the smaller id.

    Rows with a null id, a null, empty or zero vector, or a component that is null or not finite
    take no part. Only vectors of one length are compared. Repeated rows are candidates each for
    itself. An empty table gives an empty one. All rows are indexed.
    """
    return best_in_two_passes(packed(vectors, id_col, vector, query, nonzero=True), searcher(seed), k)
