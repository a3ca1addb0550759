import itertools
import math

import numpy as np
import pytest

from fixatio.operators import mixed as L


def dense_reml(rows, terms, theta, slope):
    """Restricted likelihood with the full covariance matrix of every user."""
    a, b, c = theta
    lower = np.array([[a, 0], [b, c]])
    psi = lower @ lower.T
    p = len(terms(rows[0]))
    big_a, big_b, q, logdet, n = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0
    for _, grp in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        grp = list(grp)
        x = np.array([terms(r) for r in grp])
        y = np.array([r[-1] for r in grp])
        z = x[:, [0, slope]]
        v = np.eye(len(grp)) + z @ psi @ z.T
        inv = np.linalg.inv(v)
        big_a += x.T @ inv @ x
        big_b += x.T @ inv @ y
        q += y @ inv @ y
        logdet += np.linalg.slogdet(v)[1]
        n += len(grp)
    beta = np.linalg.solve(big_a, big_b)
    s2 = (q - beta @ big_b) / (n - p)
    value = (n - p) * math.log(s2) + logdet + np.linalg.slogdet(big_a)[1]
    return value, beta, s2, np.sqrt(s2 * np.diag(np.linalg.inv(big_a)))


def simulate(rng, users, n, sd0, sd1, noise):
    rows = []
    for u in range(users):
        score, r0, r1 = rng.normal(), sd0 * rng.normal(), sd1 * rng.normal()
        for k in range(n):
            t = k / (n - 1)
            y = 2 + 0.5 * score - 1.0 * t + 0.8 * score * t + r0 + r1 * t + noise * rng.normal()
            rows.append((f"u{u}", float(score), t, float(y)))
    return rows


def sums_of(spark, models):
    # Only models of a pair have a minimum size.
    data = [(m, "pair" if m == "tiny" else None, *r) for m, rows in models.items() for r in rows]
    df = spark.createDataFrame(
        data, "metric string, pair_suffix string, uid string, score double, trial double, y double")
    return L.user_sums(df, ["metric", "pair_suffix"], L.TEMPORAL_DESIGN).cache()


def terms(r):
    return [1.0, r[1], r[2], r[1] * r[2]]


def test_fits_match_dense_likelihood_and_recover_the_truth(spark):
    rng = np.random.default_rng(5)
    models = {"slopes": simulate(rng, 60, 10, 1.0, 1.5, 0.5), "none": simulate(rng, 40, 6, 0.8, 0.0, 1.0),
              "tiny": simulate(rng, 5, 5, 1.0, 0.0, 1.0)}
    fits = {f["metric"]: f for f in L.fit(spark, sums_of(spark, models), ["metric", "pair_suffix"],
                                          L.TEMPORAL_DESIGN)}
    assert set(fits) == {"slopes", "none"}  # 25 rows are too few
    f = fits["slopes"]
    assert f["structure"] == "intercept+slope" and f["n_obs"] == 600
    rel = np.linalg.cholesky(f["cov_re"] / f["scale"])
    at = (rel[0, 0], rel[1, 0], rel[1, 1])
    value, beta, s2, se = dense_reml(models["slopes"], terms, at, 2)
    assert f["beta"] == pytest.approx(beta, abs=1e-6) and f["scale"] == pytest.approx(s2)
    assert f["se"] == pytest.approx(se, rel=1e-6)
    for step in itertools.product((-0.05, 0, 0.05), repeat=3):
        near = dense_reml(models["slopes"], terms, tuple(np.add(at, step)), 2)[0]
        assert near >= value - 1e-5
    assert beta == pytest.approx([2, 0.5, -1, 0.8], abs=0.7)
    assert 0.4 < L.icc(f) < 1 and L.p_value(f, 0) < 1e-6


def test_balanced_intercept_models_have_the_anova_estimates(spark):
    """With one covariate between users and one within, balanced REML has a closed form."""
    users, n = 30, 8
    models = {}
    for seed in range(8):
        rng = np.random.default_rng(seed)
        models[f"m{seed}"] = [
            (f"u{u}", float(u % 2), float(k % 2), float(r0 + rng.normal()))
            for u in range(users) for r0 in [1.3 * rng.normal()] for k in range(n)
        ]
    fits = L.fit(spark, sums_of(spark, models), ["metric", "pair_suffix"], L.TEMPORAL_DESIGN,
                 random_slope=False)
    assert len(fits) == len(models)
    for f in fits:
        y = np.array([r[-1] for r in models[f["metric"]]]).reshape(users, n)
        resid = y.copy()
        for g in (0, 1):
            for t in (0, 1):
                block = np.ix_(np.arange(users) % 2 == g, np.arange(n) % 2 == t)
                resid[block] -= y[block].mean()
        between = resid.mean(axis=1)
        within = resid - between[:, None]
        s2 = (within**2).sum() / (users * (n - 1) - 2)
        var0 = (between**2).sum() / (users - 2) - s2 / n
        assert f["scale"] == pytest.approx(s2, rel=1e-4)
        assert f["cov_re"][0, 0] == pytest.approx(var0, rel=2e-3)


def test_size_limit_counts_outcomes_before_scores(spark):
    rng = np.random.default_rng(2)
    rows = simulate(rng, 10, 4, 1, 0, 1)
    rows = [(u, None if i >= 28 else s, t, y) for i, (u, s, t, y) in enumerate(rows)]
    fits = L.fit(spark, sums_of(spark, {"m": rows}), ["metric", "pair_suffix"], L.TEMPORAL_DESIGN)
    assert len(fits) == 1 and fits[0]["n_obs"] == 28


def test_reference_and_target():
    got = {p.suffix: L.reference_and_target(p) for p in L.M.PAIRS}
    assert got == {"neg_vs_pos": ("positive", "negative"), "neg_vs_neu": ("neutral", "negative"),
                   "pos_vs_neu": ("neutral", "positive")}


def test_gradient_and_hessian_are_those_of_the_dense_criterion(spark):
    rng = np.random.default_rng(11)
    rows = simulate(rng, 12, 7, 0.9, 0.7, 0.6)
    sums, key = sums_of(spark, {"m": rows}), ("m", None)
    at, h = np.array([0.7, -0.3, 0.4]), 1e-4
    got = L._evaluate(sums, ["metric", "pair_suffix"], L.TEMPORAL_DESIGN, {(key, 3): at, (key, 1): np.array([0.7, 0, 0])})
    full, single = got[key, 3], got[key, 1]

    def f(*theta):
        return dense_reml(rows, terms, theta, 2)[0]

    assert full["value"] == pytest.approx(f(*at), abs=1e-8)
    steps = np.eye(3) * h
    for i in range(3):
        assert full["grad"][i] == pytest.approx((f(*(at + steps[i])) - f(*(at - steps[i]))) / (2 * h), rel=1e-5, abs=1e-5)
        for j in range(3):
            second = (f(*(at + steps[i] + steps[j])) - f(*(at + steps[i] - steps[j])) - f(*(at - steps[i] + steps[j])) + f(*(at - steps[i] - steps[j]))) / (4 * h * h)
            assert full["hess"][i, j] == pytest.approx(second, rel=1e-3, abs=1e-3)
    assert single["grad"][0] == pytest.approx((f(0.7 + h, 0, 0) - f(0.7 - h, 0, 0)) / (2 * h), rel=1e-5, abs=1e-5)


def test_few_rounds_also_with_partial_sums(spark, monkeypatch):
    """Ten rounds at most, wherever the optimum lies, and the same fit from many small parts."""
    models = {}
    for seed, (sd0, sd1, noise) in enumerate([(1, 1.5, 0.5), (0.8, 0, 1), (0, 0, 1), (6, 2, 0.3), (0.05, 0.4, 1), (0, 1, 1)]):
        models[f"m{seed}"] = simulate(np.random.default_rng(seed), 50, 8, sd0, sd1, noise)
    sums = sums_of(spark, models)
    whole = {f["metric"]: f for f in L.fit(spark, sums, ["metric", "pair_suffix"], L.TEMPORAL_DESIGN)}
    assert set(whole) == set(models) and all(f["converged"] and f["rounds"] <= 10 for f in whole.values())
    monkeypatch.setattr(L, "FAN_IN", 2)
    for f in L.fit(spark, sums.repartition(9).cache(), ["metric", "pair_suffix"], L.TEMPORAL_DESIGN):
        assert f["beta"] == pytest.approx(whole[f["metric"]]["beta"], abs=1e-5)
        assert f["structure"] == whole[f["metric"]]["structure"]
