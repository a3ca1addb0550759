"""The range join of vectors against all pairs, its pruning, and awkward rows."""

import math

import duckdb
import numpy as np
import pytest

from fixatio.llm import digests, rangejoin
from fixatio.llm.ann import cosines
from fixatio.llm.sql import ORACLE

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, row string, k1 int, node int"


def all_pairs(vectors, cosine=0.9):
    """(links, component) by comparing every pair; None for what takes no part."""
    n = len(vectors)
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in vectors]
    root, links = list(range(n)), [0] * n

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = (np.array(vectors[k][1], np.float32).astype(float) for k in (i, j))
                if cosines(a, b[None])[0] >= cosine:
                    links[i] += 1
                    links[j] += 1
                    root[top(i)] = top(j)
    least = {}
    for i in range(n):
        if ok[i]:
            least[top(i)] = min(least.get(top(i), 1 << 60), vectors[i][0])
    return links, [least[top(i)] if ok[i] else vectors[i][0] for i in range(n)]


def clustered(rng, n, dim, clusters, spread):
    centre = rng.standard_normal((clusters, dim))
    return centre[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))


def awkward(rng):
    x = clustered(rng, 260, 12, 9, 0.25).tolist()
    rows = [(i, v) for i, v in enumerate(x)]
    rows += [(i, x[7]) for i in range(300, 340)] + [(340, [2 * a for a in x[7]])]  # copies, and one of another length
    rows += [(0, x[0]), (0, x[0]), (5, [0.0] * 12), (400, None), (401, []), (402, [1.0] * 11 + [None]), (403, [1.0] * 11 + [math.inf]),
             (404, [1.0] * 11 + [math.nan]), (None, x[7]), (None, None), (405, [1.0, 2.0]), (406, [2.0, 4.1]), (407, [1e30] + [0.0] * 11), (408, [1e-30] + [0.0] * 11)]
    return rows


@pytest.mark.parametrize("cell", [4096, 40])
def test_links_and_components(spark, monkeypatch, cell):
    monkeypatch.setattr(rangejoin, "CELL", cell)
    rows = awkward(np.random.default_rng(5))
    df = spark.createDataFrame([(i, v, 1, 9, "clash", 9, 9) for i, v in rows], SCHEMA).repartition(3)
    got = sorted(((r.row.vec_id, r.n_links, r.component_id, r.kept) for r in rangejoin.near_duplicate_vectors(df).collect()), key=str)
    links, component = all_pairs(rows)
    assert got == sorted(((i, n, c, i == c) for (i, _), n, c in zip(rows, links, component)), key=str)


def test_registered_query_is_its_sql(spark, tmp_path):
    rows = awkward(np.random.default_rng(6))
    path = f"{tmp_path}/embeddings.parquet"
    spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").coalesce(1).write.parquet(path)
    got = digests.embedding_near_duplicates(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    expected = con.execute(ORACLE["op13_vector_range_join"])
    columns = [d[0] for d in expected.description]
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, expected.fetchall()))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rangejoin.near_duplicate_vectors(df).collect() == []


def test_cells_far_away_are_left_out_and_none_that_matters():
    """On clustered vectors most pairs of cells have no visitors; no link is lost by that."""
    rng = np.random.default_rng(7)
    x = clustered(rng, 4000, 64, 40, 0.1)
    u = rangejoin.unit(x)
    radius = math.sqrt(0.2)
    cells = rangejoin.Cells(rangejoin.spread_pivots(u, 64, 2 * radius), radius)
    d = rangejoin.distances(u, cells.pivots)
    home = d.argmin(1)
    for cell in range(len(cells.pivots)):
        mine = d[home == cell, cell]
        cells.learn(cell, len(mine), mine.min(), mine.max())
    visits = cells.visits(d, home)
    i, j = np.nonzero(u @ u.T >= 0.9)
    assert visits[i, home[j]].all()
    assert len(cells.pivots) > 30 and visits.mean() < 0.05


def test_tiles_far_away_are_skipped():
    rng = np.random.default_rng(8)
    near, far = clustered(rng, 1500, 16, 1, 0.01), clustered(rng, 1500, 16, 1, 0.01)
    x = np.concatenate([near, far])
    d = rangejoin.distances(rangejoin.unit(x), rangejoin.unit(near[:1]))[:, 0]
    weight = np.ones(len(x), np.int64)
    links, root, _, compared = rangejoin.join_cell((x, weight, d), None, 0.9)
    assert (links == 1499).all() and len(set(root.tolist())) == 2
    assert compared < 0.42 * len(x) ** 2  # without skipping: 0.58 in tiles of 512
