"""Boosting by histograms against plain loops, and the awkward cases of its docstring."""

import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from fixatio.operators import boosting
from fixatio.operators import learn as N


def plain_tree(bins, g, h, depth, rate):
    """A tree as nested tuples, by trying every split of every node."""
    total_g, total_h = sum(g), sum(h)
    best = (1e-9, None)
    if depth:
        for f in range(bins.shape[1]):
            for b in range(int(bins[:, f].max())):
                left = bins[:, f] <= b
                gl, hl = g[left].sum(), h[left].sum()
                gr, hr = total_g - gl, total_h - hl
                if hl < 1 or hr < 1:
                    continue
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - total_g**2 / (total_h + 1)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, (f, b))
    if best[1] is None:
        return -rate * total_g / (total_h + 1)
    f, b = best[1]
    left = bins[:, f] <= b
    return f, b, plain_tree(bins[left], g[left], h[left], depth - 1, rate), plain_tree(bins[~left], g[~left], h[~left], depth - 1, rate)


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def plain_boost(task, bins, y, train, rounds, depth, rate, classes):
    """Raw scores of all rows by a model of the rows in ``train``."""
    mean = y[train].mean()
    if task == "multiclass":
        score = np.zeros((len(y), classes))
    else:
        score = np.full((len(y), 1), mean if task == "regression" else math.log(mean / (1 - mean)))
    for _ in range(rounds):
        new = score.copy()
        for c in range(score.shape[1]):
            if task == "regression":
                g, h = score[:, 0] - y, np.ones(len(y))
            elif task == "binary":
                p = 1 / (1 + np.exp(-score[:, 0]))
                g, h = p - y, p * (1 - p)
            else:
                p = (np.exp(score) / np.exp(score).sum(1, keepdims=True))[:, c]
                g, h = p - (y == c), 2 * p * (1 - p)
            tree = plain_tree(bins[train], g[train], h[train], depth, rate)
            new[:, c] += [plain_value(tree, row) for row in bins]
        score = new
    return score


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, (240, 4)).astype(float)  # few values: every one has its bin
    raw = x[:, 0] - x[:, 1] * (x[:, 2] > 5) + rng.normal(0, 1, 240)
    return x, raw, rng.integers(0, 3, 240)


@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
@pytest.mark.parametrize("part_rows, fan_in, stored", [(100_000, 64, 10), (30, 3, 2)])
def test_equals_plain_boosting(spark, monkeypatch, data, task, part_rows, fan_in, stored):
    for name, value in (("PART_ROWS", part_rows), ("FAN_IN", fan_in), ("STORED_ROUNDS", stored)):
        monkeypatch.setattr(boosting, name, value)
    x, raw, fold = data
    y = {"binary": (raw > 2).astype(float), "multiclass": np.digitize(raw, [-1, 4]).astype(float), "regression": raw}[task]
    labels = y + 5 if task == "multiclass" else y  # labels need not number the classes
    rows = spark.createDataFrame(
        [(i, Vectors.dense(v), float(l), int(f)) for i, (v, l, f) in enumerate(zip(x, labels, fold))], ["id", "features", "label", "fold"]
    )
    model = boosting.HistogramBoosting(task, 5, 3, 0.3)
    got = {r.id: r for r in model.cross_predict(rows, 3).collect()}
    assert len(got) == 240
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, 32) / 32, method="inverted_cdf")) for i in range(4)]
    bins = np.stack([np.searchsorted(e, x[:, i]) for i, e in enumerate(edges)], 1)
    for f in range(3):
        score = plain_boost(task, bins, y, fold != f, 5, 3, 0.3, 3)
        for i in np.flatnonzero(fold == f).tolist():
            assert got[i].fold == f and got[i].label == labels[i]
            if task == "regression":
                assert got[i].prediction == pytest.approx(score[i, 0], rel=1e-9)
            elif task == "binary":
                assert got[i].score == pytest.approx(1 / (1 + math.exp(-score[i, 0])), rel=1e-9)
                assert got[i].prediction == float(score[i, 0] > 0)
            else:
                assert got[i].prediction == 5 + score[i].argmax()


def test_defaults_are_the_fixed_values():
    for make, task in ((N.boosted_classifier, "binary"), (N.boosted_multiclass, "multiclass"), (N.boosted_regressor, "regression")):
        model = make(10)
        assert (model.task, model.rounds, model.depth, model.rate) == (task, 200, 4, 0.1)


def test_awkward_rows(spark):
    """One class, constant features, one row a fold, a fold without others, an empty table."""
    fields = ["id", "features", "label", "fold"]
    same = spark.createDataFrame([(i, Vectors.dense([1.0, float("inf")]), 1.0, i % 2) for i in range(6)], fields)
    for task in ("binary", "multiclass", "regression"):
        out = boosting.HistogramBoosting(task, 3, 2, 0.1).cross_predict(same, 2).collect()
        assert len(out) == 6 and {r.prediction for r in out} == {1.0}
    alone = same.filter("fold = 0")
    assert boosting.HistogramBoosting("binary", 3, 2, 0.1).cross_predict(alone, 2).collect() == []
    assert boosting.HistogramBoosting("binary", 3, 2, 0.1).cross_predict(same.limit(0), 2).collect() == []


def test_sums_by_feature_equal_a_loop_and_hold_no_cell_for_each_row_and_feature():
    import tracemalloc

    import numpy as np

    from fixatio.operators import boosting as B

    rng = np.random.default_rng(5)
    n, classes, nodes, features, n_bins = 4000, 3, 4, 50, 8
    g, h = rng.integers(-9, 9, (n, classes)).astype(float), rng.integers(0, 9, (n, classes)).astype(float)
    node, bins = rng.integers(0, nodes, (n, classes)), rng.integers(0, n_bins, (n, features))
    total = np.ones((classes, 2, nodes, features, n_bins))
    tracemalloc.start()
    B.add_sums(total, g, h, node, bins, n_bins)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = np.ones_like(total)
    for c in range(classes):
        for f in range(features):
            np.add.at(expected[c, 0, :, f], (node[:, c], bins[:, f]), g[:, c])
            np.add.at(expected[c, 1, :, f], (node[:, c], bins[:, f]), h[:, c])
    assert (total == expected).all()
    assert peak < 1.5 * bins.nbytes  # before, a cell, its weight and its place for each row and feature


def test_walk_of_several_classes():
    import numpy as np

    from fixatio.operators import boosting as B

    rng = np.random.default_rng(6)
    trees = B.Trees(3, 3)
    trees.feature[:], trees.bin[:] = rng.integers(0, 5, trees.feature.shape), rng.integers(0, 9, trees.bin.shape)
    bins = rng.integers(0, 9, (40, 5))
    found = trees.walk(bins, 3)
    for r in range(40):
        for c in range(3):
            at = 0
            for _ in range(3):
                at = 2 * at + 1 + int(bins[r, trees.feature[c, at]] > trees.bin[c, at])
            assert found[r, c] == at - 7


@pytest.mark.parametrize("task", ["binary", "multiclass", "regression"])
def test_rows_in_parts_equal_plain_boosting(spark, monkeypatch, data, task):
    """Rows that do not fit into a task: a job for each level, sums of many parts."""
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    test_equals_plain_boosting(spark, monkeypatch, data, task, 30, 3, 2)


def test_a_model_whose_rows_fit_into_a_task_is_not_a_job_for_each_level(spark, monkeypatch, data):
    x, raw, fold = data
    rows = spark.createDataFrame([(i, Vectors.dense(v), float(r > 2), int(f)) for i, (v, r, f) in enumerate(zip(x, raw, fold))], ["id", "features", "label", "fold"])
    levels, level = [], boosting.HistogramBoosting._level
    monkeypatch.setattr(boosting.HistogramBoosting, "_level", lambda *a: levels.append(1) or level(*a))
    in_tasks = {r.id: (r.prediction, r.score) for r in boosting.HistogramBoosting("binary", 4, 3, 0.3).cross_predict(rows, 3).collect()}
    assert not levels
    monkeypatch.setattr(boosting, "TASK_BYTES", 0)
    in_parts = {r.id: (r.prediction, r.score) for r in boosting.HistogramBoosting("binary", 4, 3, 0.3).cross_predict(rows, 3).collect()}
    assert len(levels) == 12 and set(in_tasks) == set(in_parts)
    for i, (prediction, score) in in_parts.items():
        assert in_tasks[i] == (prediction, pytest.approx(score, rel=1e-12))


@pytest.mark.parametrize("features, n_bins, rows", [(1, 4, 500), (5, 8, 3000), (6, 8, 3000), (5, 32, 100)])
def test_sums_of_pairs_of_features_equal_a_loop(monkeypatch, features, n_bins, rows):
    """Some of the rows, in several chunks; few rows are added up a feature at a time."""
    monkeypatch.setattr(boosting, "CHUNK", 700)
    rng = np.random.default_rng(7)
    bins, node = rng.integers(0, n_bins, (rows, features)).astype(np.uint8), rng.integers(0, 3, rows)
    g, h, some = rng.integers(-9, 9, rows).astype(float), rng.integers(0, 9, rows).astype(float), np.flatnonzero(rng.random(rows) < 0.7)
    columns, width = boosting.bin_columns(bins, n_bins)
    assert width == (n_bins if rows < 4 * n_bins**2 else n_bins**2)
    got = boosting.feature_sums(boosting.column_sums(columns, width, g[some], h[some], node[some], 3, some), features, n_bins)
    expected = np.zeros((2, 3, features, n_bins))
    for f in range(features):
        np.add.at(expected[0, :, f], (node[some], bins[some, f]), g[some])
        np.add.at(expected[1, :, f], (node[some], bins[some, f]), h[some])
    assert (got == expected).all()
