"""Exact top-k search by integer inner product, a block of documents at a time.

A vector's dimensions are the terms. For each block of documents the largest and the smallest
value of every term are kept; a query's bound on a block is the sum of what each term could give
at most. A query takes blocks in the order of their bounds, scores the documents of a block from
its forward index, and stops at the first block whose bound is below its k-th score.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from fixatio.llm.vectorgrid import best_of_grid, k_best, packed

SCALE = 256
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _wide_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products beyond doubles' exact range, in Python's integers; held to 64 bits."""
    own = [int(v) for v in q]
    return np.array([max(-_LONG, min(_LONG, sum(a * int(b) for a, b in zip(own, row)))) for row in x], object)


def search_blocks(queries: tuple, documents: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, document rows and scores of each query's k best documents of these blocks."""
    _, q_uids, q = queries
    ids, uids, x, blocks = documents
    q, x = np.floor(SCALE * q), np.floor(SCALE * x)
    exact = np.abs(q).max() * np.abs(x).max() * q.shape[1] < _EXACT
    high, low = np.stack([x[b].max(0) for b in blocks]), np.stack([x[b].min(0) for b in blocks])
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = up @ high.T + down @ low.T  # queries x blocks
    if not exact:
        bound += np.abs(bound) * 1e-9 + 1
    order = np.argsort(-bound, axis=1, kind="stable")
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0, object if not exact else float))] * len(q)
    kth = np.full(len(q), -np.inf)
    # Queries that take the same block at the same turn share one product with its forward index.
    for turn in range(len(blocks)):
        block = order[:, turn]
        going = bound[np.arange(len(q)), block] >= kth
        if not going.any():
            break
        for b in np.unique(block[going]):
            asking = np.flatnonzero(going & (block == b))
            rows = blocks[b]
            scores = q[asking] @ x[rows].T if exact else None
            for at, i in enumerate(asking):
                other = uids[rows] != q_uids[i]
                found = rows[other]
                score = scores[at][other] if exact else _wide_scores(q[i], x[found])
                if exact:  # what is below the k-th score cannot enter
                    near = score >= kth[i]
                    found, score = found[near], score[near]
                found, score = np.concatenate([best[i][0], found]), np.concatenate([best[i][1], score])
                pick = k_best(score, ids[found], uids[found], k)
                best[i] = found[pick], score[pick]
                if len(pick) == k:
                    kth[i] = float(best[i][1][-1])
    rows = np.repeat(np.arange(len(q)), [len(b[0]) for b in best])
    found = np.concatenate([b[0] for b in best]) if len(q) else np.zeros(0, int)
    score = [int(s) for b in best for s in b[1]]
    return rows, found, np.array(score, np.int64)


def top_k(vectors: DataFrame, query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of floor(256 x) for each row
    that ``query`` selects, over every other row; ties to the smaller id.

    Rows with a null id, a null or empty vector, or a component that is null or not finite take no
    part. Only vectors of one length are compared. Repeated rows are candidates each for itself.
    Scores beyond 64 bits are held to them. An empty table gives an empty one.
    """
    return best_of_grid(packed(vectors, id_col, vector, query), search_blocks, k, "long")
