"""Near-duplicate vectors by an exact metric range join.

Cosine c and the distance of unit vectors, sqrt(2 - 2c), order pairs alike, so "cosine at least t"
is "distance at most r". Pivots, at least 2r apart, split the space: a vector's cell is that of its
nearest pivot. A vector x of cell i can only have a partner in cell j if (triangle inequality, with
the least and greatest distance l, u of cell j's vectors to their pivot) l - r <= d(x, pj) <= u + r
and d(x, pj) <= d(x, pi) + 2r; the last in its sharper form for flat space, that x is within r of
the plane between both pivots. Such vectors are replicated to the pair of cells, the same rule on both
sides, and every pair of cells joins by itself. Inside, vectors are sorted by their distance to
the pivot, so that tiles whose distances differ by more than r are skipped.

Equal vectors are one node with a weight, and a cell of many vectors is dealt into groups, a task
for each pair of groups: links are counted, never emitted; a task returns a count for each vector and a
tree of links for each connected part of it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.llm.ann import cosines
from fixatio.llm.common import store
from fixatio.llm.components import components

COSINE = 0.9
CELL = 4096  # vectors of a group, and vectors for each pivot
LEAST_PIVOTS, MOST_PIVOTS = 8, 1024
SAMPLED = 4  # vectors looked at for each pivot
TILE = 512
_SLACK = 1e-6  # rounding of distances, on the safe side
_SURE = 1e-9  # cosines nearer to the threshold than this are computed again from the original vectors


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; scaled first, as squares may leave the range of doubles."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def distances(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ pivots.T)))


def spread_pivots(u: np.ndarray, n: int, apart: float) -> np.ndarray:
    """At most n of these unit vectors, in their order, each farther than ``apart`` from those before."""
    taken: list[np.ndarray] = []
    for x in u:
        if len(taken) == n:
            break
        if not taken or (distances(x[None], np.stack(taken)) > apart).all():
            taken.append(x)
    return np.stack(taken)


class Cells:
    """Pivots of one length of vectors and what is known of their cells."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius + _SLACK
        self.between = distances(pivots, pivots)
        self.count = np.zeros(len(pivots), np.int64)
        self.least, self.most = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)

    def learn(self, cell: int, n: int, least: float, most: float) -> None:
        self.count[cell], self.least[cell], self.most[cell] = n, least, most

    def groups(self) -> np.ndarray:
        return np.maximum(1, -(-self.count // CELL))

    def visits(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """vectors x cells: whether a vector may have a partner in the cell."""
        r, own = self.radius, np.arange(len(home))
        apart = self.between[home]
        out = (d <= self.most + r) & (d >= self.least - r)
        out &= d * d - (d[own, home] ** 2)[:, None] <= 2 * apart * r
        out[own, home] = True
        return out


class Forest:
    """Connected parts of links that come in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:  # roots of roots
                up = root[root]
                if (up == root).all():
                    break
                root[:] = up


def join_cell(left: tuple, right: tuple | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Links of two groups, or within one (``right`` None). A group is (vectors, weights, distances
    to one pivot). Returns for left and right vectors together the weight of their partners and the
    least-numbered vector of their connected part, and how many pairs were compared."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine)) + _SLACK
    sides = []
    for x, weight, d in (left,) if right is None else (left, right):
        order = np.argsort(d, kind="stable")
        sides.append((x[order], unit(x[order]), weight[order], d[order], order))
    (x, u, w, d, order), (y, v, z, e, other) = sides[0], sides[-1]
    base = 0 if right is None else len(x)
    links, forest, compared = np.zeros(base + len(y), np.int64), Forest(base + len(y)), 0
    for lo in range(0, len(x), TILE):
        hi = min(lo + TILE, len(x))
        first = lo if right is None else int(np.searchsorted(e, d[lo] - radius))
        last = int(np.searchsorted(e, d[hi - 1] + radius, side="right"))
        for start in range(first, last, TILE):
            stop = min(start + TILE, last)
            c = u[lo:hi] @ v[start:stop].T
            compared += c.size
            i, j = np.nonzero(c >= cosine - _SURE)
            near = np.flatnonzero(c[i, j] < cosine + _SURE)
            if len(near):
                keep = np.ones(len(i), bool)
                for k in near.tolist():
                    a, b = x[lo + i[k]].astype(np.float64), y[start + j[k]].astype(np.float64)
                    keep[k] = cosines(a, b[None])[0] >= cosine
                i, j = i[keep], j[keep]
            if right is None:  # each pair once
                once = start + j > lo + i
                i, j = i[once], j[once]
            np.add.at(links, lo + i, z[start + j])
            np.add.at(links, base + start + j, w[lo + i])
            forest.link(lo + i, base + start + j)
    # Back to the order in which the vectors came.
    place = order if right is None else np.concatenate([order, base + other])
    out, root = np.zeros_like(links), np.zeros_like(forest.root)
    out[place], root[place] = links, place[forest.root]
    return out, root, np.arange(len(root)), compared


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, rows and vectors of each length in a batch."""
    width = np.asarray(batch.column("v").value_lengths())
    for dim in np.unique(width).tolist():
        rows = np.flatnonzero(width == dim)
        yield dim, rows, _matrix(batch.column("v").take(pa.array(rows)), dim)


def _cells_of(nodes: DataFrame, radius: float) -> dict[int, Cells]:
    """Pivots from a sample of bounded size, and the extent of every cell from all vectors.

    Lengths of vectors that the sample does not have get one cell that all their vectors belong to.
    """
    spark, n = nodes.sparkSession, nodes.count()
    wanted = min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(n / CELL)))
    some = nodes.orderBy(F.xxhash64("k1", "k2"), "node").limit(SAMPLED * wanted).select("v").collect()
    sample: dict[int, list] = {}
    for row in some:
        sample.setdefault(len(row.v), []).append(row.v)
    pivots = {dim: spread_pivots(unit(np.array(x)), wanted, 2 * radius) for dim, x in sample.items()}

    def extents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _by_length(batch):
                u = unit(x)
                d = distances(u, pivots[dim]) if dim in pivots else np.zeros((len(u), 1))
                home = d.argmin(1)
                own = d[np.arange(len(u)), home]
                for cell in np.unique(home).tolist():
                    mine = own[home == cell]
                    yield pa.record_batch({
                        "dim": pa.array([dim], pa.int32()), "cell": pa.array([cell], pa.int32()), "n": pa.array([len(mine)], pa.int64()),
                        "least": pa.array([mine.min()]), "most": pa.array([mine.max()]),
                    })

    found = nodes.select("v").mapInArrow(extents, "dim int, cell int, n long, least double, most double").groupBy("dim", "cell").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    ).collect()
    cells: dict[int, Cells] = {}
    for row in found:
        if row.dim not in cells:
            # Without pivots: one at the origin, which is at distance 0 by definition above.
            cells[row.dim] = Cells(pivots.get(row.dim, np.zeros((1, row.dim))), radius)
        cells[row.dim].learn(row.cell, row.n, row.least, row.most)
    return cells


def range_links(nodes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, links, root) from every pair of groups of cells: the weight of the partners found
    there, and a node of the same connected part. ``nodes`` is stored: node, v, weight, k1, k2."""
    radius = math.sqrt(max(0.0, 2 - 2 * cosine))
    cells = _cells_of(nodes, radius)
    known = set(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for dim, rows, x in _by_length(batch):
                if dim not in known:
                    continue
                c = cells[dim]
                u = unit(x)
                d = distances(u, c.pivots) if c.pivots.any() else np.zeros((len(u), 1))
                home, groups = d.argmin(1), c.groups()
                # A multiplicative hash: node numbers of a task follow each other.
                part = ((node[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % groups[home]
                at, cell = np.nonzero(c.visits(d, home))
                own = home[at]
                # One row for each group of the other cell; within a cell, for each pair of groups once.
                again = groups[cell]
                i = np.repeat(np.arange(len(at)), again)
                other = np.arange(len(i)) - np.repeat(np.cumsum(again) - again, again)
                at, cell, own = at[i], cell[i], own[i]
                mine, low = part[at], own <= cell
                same = own == cell
                a = np.where(same, np.minimum(mine, other), np.where(low, mine, other))
                b = np.where(same, np.maximum(mine, other), np.where(low, other, mine))
                left = np.where(same, mine <= other, low)
                lo, hi = np.minimum(own, cell), np.maximum(own, cell)
                key = np.stack([lo, hi, a, b, left])
                order = np.lexsort(key[::-1])
                change = np.ones(len(order), bool)
                change[1:] = (key[:, order[1:]] != key[:, order[:-1]]).any(0)
                edges = np.append(np.flatnonzero(change), len(order))
                for s, t in zip(edges[:-1].tolist(), edges[1:].tolist()):
                    these = order[s:t]
                    r, first = at[these], these[0]
                    yield pa.record_batch({
                        "dim": pa.array([dim], pa.int32()), "lo": pa.array([lo[first]], pa.int32()), "hi": pa.array([hi[first]], pa.int32()),
                        "a": pa.array([a[first]], pa.int32()), "b": pa.array([b[first]], pa.int32()), "left": pa.array([bool(left[first])]),
                        "nodes": pa.array([node[rows[r]].astype(np.int64).tobytes()]), "weights": pa.array([weight[rows[r]].astype(np.int64).tobytes()]),
                        "d": pa.array([d[r, hi[first]].tobytes()]), "v": pa.array([np.ascontiguousarray(x[r]).tobytes()]),
                    })

    width = "float32" if nodes.schema["v"].dataType.simpleString() == "array<float>" else "float64"

    def join(table: pa.Table) -> pa.Table:
        dim, sides = table.column("dim")[0].as_py(), []
        alone = table.column("lo")[0].as_py() == table.column("hi")[0].as_py() and table.column("a")[0].as_py() == table.column("b")[0].as_py()
        for left in (True, False):
            part = table.filter(pc.equal(table.column("left"), left))
            raw = lambda name, kind: np.frombuffer(b"".join(part.column(name).to_pylist()), kind)  # noqa: B023, E731
            sides.append((raw("nodes", np.int64), (raw("v", width).reshape(-1, dim), raw("weights", np.int64), raw("d", np.float64))))
        (names, one), (more, two) = sides
        if not len(names) or not alone and not len(more):
            return pa.table({k: pa.array([], pa.int64()) for k in ("node", "links", "root")})
        links, root, _, _ = join_cell(one, None if alone else two, cosine)
        names = names if alone else np.concatenate([names, more])
        some = np.flatnonzero(links)
        return pa.table({"node": names[some], "links": links[some], "root": names[root[some]]})

    dealt = nodes.select("node", "weight", "v").mapInArrow(
        deal, "dim int, lo int, hi int, a int, b int, left boolean, nodes binary, weights binary, d binary, v binary"
    )
    return dealt.groupBy("dim", "lo", "hi", "a", "b").applyInArrow(join, "node long, links long, root long")


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Links between vectors whose cosine is ``cosine`` or more, and what they connect.

    Returns (row, n_links, component_id, kept): ``row`` is a struct of all columns but the vector,
    ``n_links`` the number of other rows linked directly, ``component_id`` the smallest id that links
    lead to, ``kept`` whether it is the row's own. All rows are compared, in double precision.

    A vector that is null, empty or zero, or has a component that is null or not finite, links with
    nothing and is its own component; so does one whose id is null (component null, kept). Vectors
    of different lengths do not link. Repeated rows are linked with each other; rows that share the
    smallest id of their component are all kept. An empty table gives an empty one.

    Work: where vectors are spread evenly over all directions and r is not small, no partition
    separates them, and every pair of cells is compared, in tiles; where they have structure, cells are
    left out. Pivots (at most 1,024) are the only thing that goes through the driver.
    """
    kind = vectors.schema[vector].dataType.simpleString()
    v = F.col(f"`{vector}`").cast("array<float>" if kind == "array<float>" else "array<double>")
    ok = F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < math.inf)) & F.exists(v, lambda x: x != 0)
    key = [F.when(ok, F.xxhash64(F.lit(seed), v)).alias(name) for seed, name in ((0, "k1"), (1, "k2"))]
    rest = F.struct(*[F.col(f"`{c}`") for c in vectors.columns if c != vector]).alias("row")
    rows = vectors.select(rest, F.col(f"`{id_col}`").alias("id"), *key)
    nodes = store(
        vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("v"), *key).filter("k1 is not null").groupBy("k1", "k2").agg(
            F.any_value("v").alias("v"), F.count("*").alias("weight"), F.min("id").alias("least")
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    links = store(range_links(nodes, cosine), "links")
    parts = components(links.filter("node <> root"), "node", "root")
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "k1", "k2", "weight", "least").join(counted, "node", "left").join(parts, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select(
        "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    component = F.when(F.col("k1").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    return rows.join(known, ["k1", "k2"], "left").select(
        "row", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
