import math
import random

import numpy as np
import pandas as pd
import pytest

from fixatio.operators import stats as S


@pytest.mark.parametrize("t, dof, p", [
    (12.706204736, 1, 0.05), (4.30265273, 2, 0.05), (2.2281388520, 10, 0.05), (3.16927267, 10, 0.01),
    (1.9839715185, 100, 0.05), (0.0, 7, 1.0), (2.5758293035, 1e7, 0.01),
])
def test_t_tail_against_tables(t, dof, p):
    assert S.two_sided_t(np.array([t]), np.array([float(dof)]))[0] == pytest.approx(p, rel=1e-5)


def test_t_tail_closed_forms():
    t = np.linspace(-9, 9, 37)
    one = 1 - 2 / math.pi * np.arctan(np.abs(t))
    two = 1 - np.abs(t) / np.sqrt(2 + t * t)
    assert S.two_sided_t(t, np.full_like(t, 1.0)) == pytest.approx(one, abs=1e-12)
    assert S.two_sided_t(t, np.full_like(t, 2.0)) == pytest.approx(two, abs=1e-12)


@pytest.fixture(scope="module")
def numbers(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        x = rng.gauss(0, 1)
        rows.append((i, rng.randrange(6), x, round(x + rng.gauss(0, 2), 1),
                     None if rng.random() < 0.3 else rng.random(), 1.0))
    cols = ["id", "score", "a", "b", "c", "flat"]
    pdf = pd.DataFrame(rows, columns=cols)
    return spark.createDataFrame(
        rows, "id int, score int, a double, b double, c double, flat double"), pdf


def plain_spearman(x, y):
    both = pd.DataFrame({"x": x, "y": y}).dropna()
    return both["x"].rank().corr(both["y"].rank()), len(both)


def test_spearman(numbers):
    df, pdf = numbers
    got = {r["metric"]: r for r in S.spearman(df, ["a", "b", "c", "flat"], "score").collect()}
    for m in ("a", "b", "c"):
        r, n = plain_spearman(pdf[m], pdf["score"])
        assert got[m]["spearman_r"] == pytest.approx(r) and got[m]["n"] == n
        t = r * math.sqrt((n - 2) / (1 - r * r))
        want = S.two_sided_t(np.array([t]), np.array([n - 2.0]))[0]
        assert got[m]["p_value"] == pytest.approx(want)
    assert got["flat"]["spearman_r"] is None or math.isnan(got["flat"]["spearman_r"])
    assert S.spearman(df.limit(10), ["a"], "score").count() == 0


@pytest.mark.parametrize("block_values", [1 << 20, 40])
def test_spearman_matrix_of_missing_patterns(spark, monkeypatch, block_values):
    """Columns missing together, apart, never at once or always; ties; constant columns; no rows."""
    monkeypatch.setattr(S.B, "BLOCK_VALUES", block_values)
    rng = random.Random(8)
    rows = []
    for i in range(240):
        gap, other = rng.random() < 0.4, rng.random() < 0.2
        a, b = rng.randrange(5), rng.random()
        rows.append((None if gap else float(a), None if gap else b, None if other else b + rng.random(), float(a) + b,
                     1.0, None if not gap else b, None, None if other or gap else -b))
    cols = ["a", "b", "c", "d", "flat", "rest", "none", "e"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(3)
    pdf = pd.DataFrame(rows, columns=cols, dtype=float)
    got = {(r["metric_a"], r["metric_b"]): (r["spearman_r"], r["n"]) for r in S.spearman_matrix(df, cols).collect()}
    for i, x in enumerate(cols):
        for y in cols[i + 1:]:
            want, n = plain_spearman(pdf[x], pdf[y])
            if not n:
                assert (x, y) not in got
                continue
            r, m = got.pop((x, y))
            assert m == n and (r is None if math.isnan(want) else r == pytest.approx(want, abs=1e-12))
    assert not got
    assert S.spearman_matrix(df.limit(0), cols).collect() == []


def test_spearman_matrix(numbers):
    df, pdf = numbers
    for r in S.spearman_matrix(df, ["a", "b", "c"]).collect():
        want, n = plain_spearman(pdf[r["metric_a"]], pdf[r["metric_b"]])
        assert r["spearman_r"] == pytest.approx(want) and r["n"] == n


def test_false_discovery(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8, 0.03, None]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    got = {r["i"]: r["q"] for r in S.benjamini_hochberg(df, "p", "q").collect()}
    known = [x for x in p if x is not None]
    ordered, q, m = sorted(known), {}, len(known)
    for x in known:
        k = ordered.index(x)
        q[x] = min(min(v * m / (j + 1) for j, v in enumerate(ordered) if j >= k), 1.0)
    for i, x in enumerate(p):
        assert got[i] == (None if x is None else pytest.approx(q[x]))
    pairs = sorted((x, got[i]) for i, x in enumerate(p) if x is not None)
    assert all(a[1] <= b[1] for a, b in zip(pairs, pairs[1:]))


def test_false_discovery_by_key(spark):
    rows = [("a", 0.01), ("a", 0.02), ("b", 0.01), ("b", 0.9), ("b", 0.02)]
    df = spark.createDataFrame(rows, "k string, p double")
    got = {(r["k"], r["p"]): r["q"] for r in S.benjamini_hochberg(df, "p", "q", ["k"]).collect()}
    assert got == {("a", 0.01): pytest.approx(0.02), ("a", 0.02): pytest.approx(0.02),
                   ("b", 0.01): pytest.approx(0.03), ("b", 0.02): pytest.approx(0.03),
                   ("b", 0.9): pytest.approx(0.9)}


def test_concordance(spark):
    df = spark.createDataFrame([(0.01, 0.01), (0.01, 0.5), (0.6, 0.02), (0.7, 0.8), (None, 0.01)],
                               "a double, b double")
    assert tuple(S.concordance(df, "a", "b").first()) == (1, 1, 2, 1, 5)


def test_trajectory_bins(spark):
    df = spark.createDataFrame([("Low", i, float(i)) for i in range(1, 22)],
                               "score_group string, trial_num int, m double")
    got = S.trajectories(df, ["m"]).toPandas()
    want = pd.cut(pd.Series(range(1, 22)), bins=10, labels=False).value_counts().sort_index()
    assert got.sort_values("trial_bin")["n"].tolist() == want.tolist()


def test_gaze_density(spark):
    df = spark.createDataFrame([("s", 0.0, 0.0), ("s", 1.0, 1.0), ("s", 1.05, 0.99), ("s", 1.2, 0.5),
                                ("s", None, 0.1)], "k string, rx double, ry double")
    got = {(r["cell_x"], r["cell_y"]): r["share"] for r in S.gaze_density(df, ["k"], 10).collect()}
    assert got == {(0, 0): pytest.approx(1 / 3), (9, 9): pytest.approx(2 / 3)}


def test_linear_trend(numbers):
    df, pdf = numbers
    r = S.linear_trend(df, ["a"], "score").first()
    slope, intercept = np.polyfit(pdf["score"], pdf["a"], 1)
    assert (r["slope"], r["intercept"]) == (pytest.approx(slope), pytest.approx(intercept))


def plain_density(points, grid, factor):
    """A direct sum over all points with the kernel of their covariance."""
    cov = np.cov(points.T) * factor**2
    inverse, norm = np.linalg.inv(cov), 2 * math.pi * math.sqrt(np.linalg.det(cov)) * len(points)
    axis = np.arange(grid) / (grid - 1)
    out = np.zeros((grid, grid))
    for i, x in enumerate(axis):
        d = np.stack(np.broadcast_arrays(x - points[:, 0][:, None], axis[None, :] - points[:, 1][:, None]))
        out[i] = np.exp(-0.5 * np.einsum("apj,ab,bpj->pj", d, inverse, d)).sum(0) / norm
    return out


def test_kernel_density_is_the_direct_sum(spark):
    """As near as the bins are fine."""
    rng = np.random.default_rng(4)
    free = rng.multivariate_normal([0.5, 0.4], [[0.02, 0.012], [0.012, 0.03]], 300)
    free = free[((free > -0.1) & (free < 1.1)).all(1)]
    rows = [("a", float(x), float(y)) for x, y in free] + [("few", 0.5, 0.5)] * 10
    rows += [("line", i / 50, i / 50) for i in range(50)] + [("spot", 0.3, 0.3)] * 40 + [("off", 5.0, 0.2)] * 30 + [("null", None, 0.2)] * 30
    df = spark.createDataFrame(rows, "k string, rx double, ry double").repartition(3)
    for bins, grid, tolerance in ((32, 200, 1e-4), (4, 100, 6e-3), (512, 40, 1e-6)):
        got = S.kernel_density(df, ["k"], grid=grid, bins=bins).collect()
        assert {r["k"] for r in got} == {"a"}
        dense = np.zeros((grid, grid))
        for r in got:
            dense[r["node_x"], r["node_y"]] = r["density"]
        want = plain_density(free, grid, 0.05)
        assert np.abs(dense - want).max() < tolerance * want.max()
    levels = S.density_levels(S.kernel_density(df, ["k"]), ["k"]).collect()
    assert sum(r["mass"] for r in levels) == pytest.approx(1, abs=0.05)


def few_rows(spark, names, n):
    """Rows with a score and metrics; the first two metrics are known once and twice."""
    rng = random.Random(n)
    rows = [[float(rng.randint(0, 60)), *[rng.random() if i > 1 or k <= i else None for i in range(len(names))]] for k in range(n)]
    return rows, spark.createDataFrame(rows, "bdi_score double, " + ", ".join(f"`{m}` double" for m in names))


def check_few(found, names, rows):
    pdf = pd.DataFrame(rows, columns=["bdi_score", *names])
    found = {r["metric"]: r for r in found.collect()}
    assert set(found) == set(names)
    for i, m in enumerate(names):
        pair = pdf[["bdi_score", m]].dropna()
        assert found[m]["n"] == len(pair) == (i + 1 if i < 2 else len(rows))
        if i > 1:
            assert found[m]["spearman_r"] == pytest.approx(pair.rank().corr().iloc[0, 1], abs=1e-6)
    assert found[names[0]]["spearman_r"] is None  # of one row


def test_static_correlations_of_few_sessions(spark, monkeypatch):
    from fixatio.operators import features as X
    from fixatio.plans import stat_queries as Q

    names = list(X.static_features().columns)
    rows, df = few_rows(spark, names, 12)
    monkeypatch.setattr(Q, "session_scores", lambda spark, d: df)
    check_few(Q.static_correlations(spark, "few sessions"), names, rows)


def test_tlbs_correlations_of_few_users(spark, monkeypatch):
    from fixatio.operators import features as X
    from fixatio.plans import stat_queries as Q

    names = list(X.tlbs_names())
    rows, df = few_rows(spark, names, 6)
    monkeypatch.setattr(Q, "user_table", lambda spark, d, family: df)
    found = {r["metric"]: r for r in Q.tlbs_correlations(spark, "few users").collect()}
    pdf = pd.DataFrame(rows, columns=["bdi_score", *names]).fillna(0.0)  # missing parameters count as 0
    assert set(found) == set(names)
    for m in names:
        assert found[m]["n"] == 6
        assert found[m]["spearman_r"] == pytest.approx(pdf[["bdi_score", m]].rank().corr().iloc[0, 1], abs=1e-6)
