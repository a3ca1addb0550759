import math
import tracemalloc

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fixatio.operators import forest as FO


def plain_best(bins, weight, target, features):
    """Best (feature, cut, gain) of one node by trying every cut of every feature."""
    best = (-1, 0, -math.inf)
    for f in features:
        for c in sorted(set(bins[:, f].tolist()))[:-1]:
            left, gain = bins[:, f] <= c, 0.0
            for side in (left, ~left):
                gain += sum((weight[side] @ target[side, k]) ** 2 for k in range(target.shape[1])) / weight[side].sum()
            gain -= sum((weight @ target[:, k]) ** 2 for k in range(target.shape[1])) / weight.sum()
            if gain > best[2] + 1e-9 * abs(best[2] if best[2] > -math.inf else 0):
                best = (f, c, gain)
    return best


@pytest.mark.parametrize("cells", [1, 150, 1 << 18])
def test_splits_are_the_best_of_all_cuts(monkeypatch, cells):
    monkeypatch.setattr(FO, "CELLS", cells)
    rng = np.random.default_rng(4)
    for trial in range(20):
        n, d, nodes = int(rng.integers(2, 60)), int(rng.integers(1, 6)), 3
        bins = rng.integers(0, rng.choice([1, 3, 256]), (n, d)).astype(np.uint8)
        target = np.eye(3)[rng.integers(0, 3, n)] if trial % 2 else rng.normal(size=(n, 1))
        weight, node = rng.integers(1, 4, n).astype(float), np.r_[np.arange(nodes), rng.integers(0, nodes, n)][:n]
        weighted = target * weight[:, None]
        used = int(node.max()) + 1
        w = np.bincount(node, weight, used)
        s = np.stack([np.bincount(node, c, used) for c in weighted.T], 1)
        picked = np.stack([rng.permutation(d)[: max(1, d // 2)] for _ in range(used)])
        got = FO.level_splits(bins, weight, weighted, node, w, s, picked)
        for v in range(used):
            mine = node == v
            f, c, gain = plain_best(bins[mine], weight[mine], target[mine], picked[v].tolist())
            assert got[0][v] == f
            if f >= 0:
                assert got[2][v] == pytest.approx(gain, abs=1e-9)
                assert got[1][v] == c


@pytest.mark.parametrize("classes", [1, 2, 5])
def test_counting_and_sorting_find_the_same_tree(monkeypatch, classes):
    """Nodes are searched by counting from COUNTED rows on, so that large ones are not sorted at every level."""
    rng = np.random.default_rng(8)
    bins = np.c_[rng.integers(0, 256, (400, 3)), rng.integers(0, 2, (400, 2))].astype(np.uint8)
    y = rng.integers(0, 7, 400) if classes == 1 else rng.integers(0, classes, 400)
    target = y[:, None].astype(float) if classes == 1 else np.eye(classes)[y]
    trees = []
    for counted, cells in ((1, 1 << 16), (30, 1 << 16), (10**6, 1 << 16), (10**6, 1)):
        monkeypatch.setattr(FO, "COUNTED", counted)
        monkeypatch.setattr(FO, "CELLS", cells)
        trees.append(FO.grow(bins, target, np.random.default_rng([1, 2]), 5 if classes == 1 else 2, 30))
    assert len(trees[0]["feature"]) > 100
    for tree in trees[1:]:
        for name in ("feature", "cut", "left", "value"):
            assert (tree[name] == trees[0][name]).all(), name
        assert tree["gain"] == pytest.approx(trees[0]["gain"])


@pytest.mark.parametrize("counted", [1, 20])
def test_counted_splits_are_the_best_of_all_cuts(monkeypatch, counted):
    monkeypatch.setattr(FO, "COUNTED", counted)
    test_splits_are_the_best_of_all_cuts(monkeypatch, 1 << 16)


@pytest.mark.parametrize("counted", [1, 20, 10**6])
@pytest.mark.parametrize("classes", [2, 5, 40])
def test_numbered_classes_split_as_0_1_targets_do(monkeypatch, classes, counted):
    """A row is added to its own class only, not to each; some of the rows take part, in any order."""
    monkeypatch.setattr(FO, "COUNTED", counted)
    rng = np.random.default_rng(11)
    for cells in (1, 300, 1 << 16):
        monkeypatch.setattr(FO, "CELLS", cells)
        bins, rows = rng.integers(0, rng.choice([2, 256]), (300, 6)).astype(np.uint8), rng.permutation(300)[:200]
        label, weight, node = rng.integers(0, classes, 200), rng.integers(1, 40, 200).astype(float), np.r_[np.arange(9), rng.integers(0, 9, 191)]
        weighted = np.eye(classes)[label] * weight[:, None]
        w, s = np.bincount(node, weight), np.stack([np.bincount(node, c) for c in weighted.T], 1)
        picked = np.stack([rng.permutation(6)[:3] for _ in range(9)])
        plain = FO.level_splits(bins[rows], weight, weighted, node, w, s, picked)
        for got, wanted in zip(FO.level_splits(bins, weight, label, node, w, s, picked, rows), plain):
            assert (got == wanted).all()
        assert (plain[0] >= 0).any()


def test_growing_copies_only_the_features_that_are_tried():
    rng = np.random.default_rng(12)
    bins, y = rng.integers(0, 256, (3000, 1500)).astype(np.uint8), rng.integers(0, 2, 3000)
    tracemalloc.start()
    tree = FO.grow(bins, np.eye(2)[y], np.random.default_rng([1, 2]), 3, 30)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(tree["feature"]) > 300 and peak < 2 * bins.nbytes  # the rows drawn, and what a level needs


def test_a_tree_is_pure_and_covers_its_rows():
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 256, (300, 4)).astype(np.uint8)
    y = (bins[:, 1] > 99).astype(int) ^ (bins[:, 2] > 180)
    tree = FO.grow(bins, np.eye(2)[y], np.random.default_rng([1, 2]), 4, 30)
    drawn = np.bincount(np.random.default_rng([1, 2]).integers(300, size=300), minlength=300) > 0
    share = tree["value"][FO.walk(tree, bins)]
    assert (share[drawn].argmax(1) == y[drawn]).all() and set(np.unique(share[drawn])) == {0.0, 1.0}
    assert tree["gain"].sum() == pytest.approx(1) and tree["gain"][[1, 2]].sum() > 0.9
    stump = FO.grow(bins, np.eye(2)[y], np.random.default_rng([1, 2]), 4, 0)
    assert stump["feature"].tolist() == [-1]


def test_leaves_are_kept_as_the_entries_that_are_not_0():
    rng = np.random.default_rng(9)
    bins, y = rng.integers(0, 256, (300, 4)).astype(np.uint8), rng.integers(0, 10, 300)
    for depth in (30, 2):
        tree = FO.grow(bins, np.eye(10)[y], np.random.default_rng([1, 2]), 2, depth)
        kept, leaf = FO.leaf_entries(tree), tree["feature"] < 0
        assert (FO.leaf_values({**tree, **kept}, 10) == tree["value"][leaf]).all()
        if depth == 30:  # pure leaves: a number each, not ten for each node
            assert len(kept["share"]) == leaf.sum() < tree["value"].size / 15


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    data = [(i, i % 3, float(x[i, 0] > 0), float(2 * x[i, 0] + 0.1 * x[i, 1]), Vectors.dense(x[i].tolist())) for i in range(240)]
    rows = spark.createDataFrame(data, ["id", "fold", "label", "t", "features"])
    return rows.withColumn("fold", F.col("fold").cast("int"))


def by_id(df):
    return {r["id"]: (r["prediction"], r["score"]) for r in df.collect()}


def test_predictions_do_not_depend_on_tasks_and_use_other_folds(spark, rows, monkeypatch):
    forest = FO.BlockForest("class", 12, 30, 42, "sqrt")
    first = by_id(forest.cross_predict(rows, 3))
    assert len(first) == 240 and set(first) == set(range(240))
    monkeypatch.setattr(FO, "TREE_GROUP", 1)
    assert by_id(forest.cross_predict(rows, 3)) == first
    # The labels of a fold change nothing for its own predictions.
    flipped = rows.withColumn("label", F.when(F.col("fold") == 1, 1 - F.col("label")).otherwise(F.col("label")))
    other = by_id(forest.cross_predict(flipped, 3))
    assert all(other[i] == first[i] for i in range(240) if i % 3 == 1)
    assert other != first


@pytest.mark.parametrize("block", [30, 7])
def test_many_blocks_learn_too(spark, rows, monkeypatch, block):
    """More blocks than a table needs, and (7 rows) as many as there are trees."""
    monkeypatch.setattr(FO, "BLOCK_ROWS", block)
    forest = FO.BlockForest("class", 20, 30, 42, "all")
    out = forest.cross_predict(rows, 3).collect()
    assert len(out) == 240 and sum(r["label"] == r["prediction"] for r in out) > 200
    top = forest.importances(rows.drop("fold")).orderBy(F.desc("importance")).collect()
    assert top[0]["place"] == 0 and sum(r["importance"] for r in top) == pytest.approx(1)


def test_regression_and_edges(spark, rows):
    target = rows.withColumn("label", F.col("t")).drop("t")
    out = FO.BlockForest("regression", 10, 30, 42, "all").cross_predict(target, 3).collect()
    assert np.mean([abs(r["label"] - r["prediction"]) for r in out]) < 0.4 and all(r["score"] is None for r in out)
    one = rows.withColumn("label", F.lit(1.0))
    assert {(r["prediction"], r["score"]) for r in FO.BlockForest("class", 3, 30, 42, "sqrt").cross_predict(one, 3).collect()} == {(1.0, None)}
    assert FO.BlockForest("class", 3, 30, 42, "sqrt").cross_predict(rows.limit(0), 3).count() == 0
    assert FO.BlockForest("class", 3, 30, 42, "sqrt").cross_predict(rows.withColumn("fold", F.lit(0)), 3).count() == 0


@pytest.mark.parametrize("task", ["class", "regression"])
def test_trees_go_once_to_a_part_of_a_fold(spark, rows, monkeypatch, task):
    forest = FO.BlockForest(task, 12, 30, 42, "all")
    first = by_id(forest.cross_predict(rows, 3))
    assert forest._parts(FO.PART_ROWS) == 1 and forest._parts(FO.PART_ROWS + 1) == 2
    monkeypatch.setattr(FO, "PART_ROWS", 7)  # 12 parts of 80 rows each
    assert by_id(forest.cross_predict(rows, 3)) == first
