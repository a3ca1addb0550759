import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from fixatio.operators import learn as N
from fixatio.operators import ridge as R


def test_all_folds_at_once_equal_plain_solutions(spark, monkeypatch):
    monkeypatch.setattr(R, "FAN_IN", 2)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(90, 4)) * [1, 100, 1e-3, 0] + [0, 1e4, 5, 3]  # the last is constant
    x = np.column_stack([x, x[:, 0] * 2])  # and one repeats another
    y = 3 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=90) + 50
    fold = np.arange(90) % 3
    data = [(i, int(fold[i]), float(y[i]), Vectors.dense(x[i].tolist())) for i in range(90)]
    rows = spark.createDataFrame(data, ["id", "fold", "label", "features"]).repartition(7)
    got = {r["id"]: r["prediction"] for r in N.cross_predict(rows, lambda n: N.ridge(n), 3).collect()}
    assert len(got) == 90
    for f in range(3):
        a, b = x[fold != f], y[fold != f]
        sd = a.std(0, ddof=1)
        use = sd > 1e-9
        z = (a[:, use] - a[:, use].mean(0)) / sd[use]
        beta = np.linalg.solve(z.T @ z + np.eye(use.sum()), z.T @ (b - b.mean()))
        want = b.mean() + ((x[:, use] - a[:, use].mean(0)) / sd[use]) @ beta
        for i in np.flatnonzero(fold == f):
            assert got[int(i)] == pytest.approx(want[i], rel=1e-9)


def test_empty_rows_and_a_single_fold(spark):
    rows = spark.createDataFrame([(0, 1.0, Vectors.dense([1.0])), (0, 2.0, Vectors.dense([2.0]))], ["fold", "label", "features"])
    assert R.cross_predict(rows, 5).count() == 0
    assert R.cross_predict(rows.limit(0), 5).count() == 0
