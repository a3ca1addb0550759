import random

import pytest
from pyspark.sql import functions as F

from fixatio.operators import learn as N


@pytest.fixture(scope="module")
def people(spark):
    rng = random.Random(1)
    rows = []
    for g in range(40):
        for _ in range(1 + (30 if g == 0 else g % 4)):
            x, z = rng.gauss(0, 1), rng.gauss(0, 1)
            rows.append((f"g{g}", x, z, int(x + 0.3 * rng.gauss(0, 1) > 0), 3 * x + 0.1 * rng.gauss(0, 1)))
    return spark.createDataFrame(rows, "grp string, x double, z double, y int, t double").cache()


@pytest.fixture
def store(tmp_path):
    def put(rows, name):
        path = str(tmp_path / name.replace(" ", "_"))
        rows.coalesce(2).write.parquet(path)
        return rows.sparkSession.read.parquet(path)

    return put


def plain_folds(sizes, k):
    """Loads, and the fold of each group, when the largest goes to the lightest fold each time."""
    load, folds = [0] * k, []
    for size in sorted(sizes, reverse=True):
        f = load.index(min(load))
        load[f] += size
        folds.append((size, f))
    return load, folds


def test_segments_are_the_plain_greedy_rule():
    rng = random.Random(2)
    for _ in range(300):
        k = rng.randrange(1, 7)
        counts = {rng.choice([1, 2, 3, rng.randrange(1, 60)]): rng.randrange(1, 40) for _ in range(rng.randrange(1, 8))}
        got, load = [], [0] * k
        for size, start, stop, cycle in N.greedy_segments(list(counts.items()), k):
            for no in range(start, stop):
                got.append((size, cycle[(no - start) % len(cycle)]))
                load[got[-1][1]] += size
        assert (load, got) == plain_folds([s for s, n in counts.items() for _ in range(n)], k)
    many = N.greedy_segments([(1, 10**12), (3, 10**9), (10**9, 3)], 5)
    assert len(many) < 20 and sum(b - a for _, a, b, _ in many) == 10**12 + 10**9 + 3


def test_no_group_in_two_folds(people):
    f = N.grouped_folds(people, "grp")
    per = f.groupBy("grp").agg(F.countDistinct("fold").alias("n"))
    assert per.agg(F.max("n")).first()[0] == 1 and f.count() == people.count()
    rows = {r["fold"]: r["n"] for r in f.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    sizes = [r["n"] for r in people.groupBy("grp").agg(F.count("*").alias("n")).collect()]
    assert [rows[i] for i in range(5)] == plain_folds(sizes, 5)[0]


def test_linear_models_learn(spark, people, store):
    sets = {"both": ["x", "z"], "noise": ["z"]}
    runs = N.run_models(spark, people, sets, "y", "grp", "binary", {"L": N.logistic}, store=store).collect()
    assert [r["feature_set"] for r in runs] == ["both", "noise"]  # best first
    assert runs[0]["auc_roc"] > 0.9 > 0.75 > runs[1]["auc_roc"] and runs[0]["n_features"] == 2
    reg = N.run_models(spark, people, {"all": ["x", "z"]}, "t", "grp", "regression",
                       {"R": N.ridge}, store=store).first()
    assert reg["r2"] > 0.95 and reg["rmse"] >= reg["mae"]


def test_tree_models_learn(spark, people, store):
    models = {"F": lambda n: N.forest_classifier(n, 10), "G": lambda n: N.boosted_classifier(n, 3)}
    for r in N.run_models(spark, people, {"x": ["x", "z"]}, "y", "grp", "binary", models, k=2,
                          store=store).collect():
        assert r["auc_roc"] > 0.8
    rows = N.assemble(people, ["x", "z"], "y", [])
    assert N.feature_importance(rows, ["x", "z"], 10).first()["feature"] == "x"


def test_other_tree_models(spark, people, store):
    rows = people.withColumn("c", F.when(F.col("x") < -0.5, 0).when(F.col("x") < 0.5, 1).otherwise(2))
    multi = {"F": lambda n: N.forest_classifier(n, 5), "G": lambda n: N.boosted_multiclass(n, 2),
             "L": N.logistic}
    for r in N.run_models(spark, rows, {"x": ["x", "z"]}, "c", "grp", "multiclass", multi, k=2,
                          store=store).collect():
        assert r["f1_weighted"] > 0.8
    reg = {"F": lambda n: N.forest_regressor(n, 5), "G": lambda n: N.boosted_regressor(n, 12)}
    runs = N.run_models(spark, rows, {"r": ["x", "z"]}, "t", "grp", "regression", reg, k=2, store=store)
    assert all(r["r2"] > 0.4 for r in runs.collect())
    best = N.best_models({"Regression": (runs, runs, "r2")}).first()
    assert best["phq9_model"].endswith("/ r") and best["bdi_value"] == best["phq9_value"]


def test_registered_tree_runs_are_whole(spark, monkeypatch):
    """Every kind of tree learner has a query, with the reference's 200 trees or rounds."""
    from fixatio.plans import learn_queries as L
    from fixatio.plans.registry import QUERIES

    asked = {}
    monkeypatch.setattr(L, "run", lambda spark, d, task, label, models, sets=None: asked.update({(task, m): (f, sets) for m, f in models.items()}))
    for task in ("binary", "multiclass", "regression"):
        for kind in ("forest", "boosted"):
            assert f"{task}_{kind}_run" in QUERIES
            getattr(L, f"{task}_{kind}_run")(spark, "")
    for (task, kind), (make, sets) in asked.items():
        model = make(100)
        if kind == "Random Forest":
            assert model.getNumTrees() == 200
        else:
            assert (model.task, model.rounds, model.depth, model.rate) == (task, 200, 4, 0.1)
        assert sets == {"All dimensions": L.DIMS}
    assert len(asked) == 6


def test_scores(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.8), (2, 2, 0.1)],
                               "label int, prediction int, score double")
    r = N.class_scores(df).first()
    assert r["accuracy"] == pytest.approx(0.6) and r["f1_weighted"] == pytest.approx(0.6)
    two = df.filter("label < 2")
    # Pairs (1, 0): .9>.4, .9>.8, .4=.4, .4<.8
    assert N.roc_auc(two).first()["auc_roc"] == pytest.approx(2.5 / 4)
    pts = {p["threshold"]: (p["tpr"], p["fpr"]) for p in N.roc_points(two).collect()}
    assert pts == {0.9: (0.5, 0.0), 0.8: (0.5, 0.5), 0.4: (1.0, 1.0)}
    assert N.roc_auc(df.filter("label = 1")).first()["auc_roc"] is None
    e = N.regression_scores(spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0)],
                                                  "label double, prediction double")).first()
    assert (e["r2"], e["mae"]) == (pytest.approx(1 - 5 / 8), pytest.approx(1.0))


def test_ridge_solves_the_normal_equations(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 2))
    y = 20 * x[:, 0] - 9 * x[:, 1] + rng.normal(size=40)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "x double, z double, y double")
    fitted = N.ridge(40).fit(N.assemble(rows, ["x", "z"], "y", []))
    scaled = (x - x.mean(0)) / x.std(0, ddof=1)
    beta = np.linalg.solve(scaled.T @ scaled + np.eye(2), scaled.T @ (y - y.mean()))
    assert fitted.stages[-1].coefficients.toArray() == pytest.approx(beta, rel=1e-4)
