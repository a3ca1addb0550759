import numpy as np
import pytest

from fixatio import model as M
from fixatio.functions import columns as C
from fixatio.operators import features as X
from fixatio.operators import prepare as P
from fixatio.operators import reports as R


def test_feature_counts_and_names():
    assert len(X.static_features().columns) == 57
    assert len(X.distributional_features().columns) == 190
    assert len(X.temporal_features().columns) == 156
    assert len(X.tlbs_names()) == 21 and X.tlbs_names(["neg_vs_pos"])[-1] == "tlbs_slope__neg_vs_pos"
    for family in ("static", "distributional", "temporal", "tlbs"):
        sets = X.feature_sets(family)
        every = set().union(*sets.values())
        for names in sets.values():
            assert len(names) == len(set(names))
        known = {"static": X.static_features().columns,
                 "distributional": X.distributional_features().columns,
                 "temporal": X.temporal_features().columns,
                 "tlbs": X.tlbs_names() + X.static_features().columns}[family]
        assert every <= set(known)
    names = X.static_features().columns
    assert {"avg_ttff_neg__neg_vs_pos", "ttff_miss_rate_pos__pos_vs_neu",
            "first_fix_prob_neu__neg_vs_neu", "avg_dwell_500ms_neg__neg_vs_pos"} <= set(names)


def bias_frame(spark, rows):
    full = [(s, i, p, *[b if f"{p}" == q.name else None for q in M.PAIRS]) for s, i, p, b in rows]
    return spark.createDataFrame(
        full, "session_id string, scene_index int, scene_valence_pair string, "
        + ", ".join(f"{b} double" for b in M.BIASES))


@pytest.mark.parametrize("block", [2, 1000])
def test_tlbs_parameters(spark, block):
    v = [0.5, -0.25, 0.0, 1.0, -1.0]
    x = [1, 5, 9, 11, 20]
    rows = [("s", i, "negative_vs_positive", b) for i, b in zip(x, v)]
    rows += [("s", 30 + i, "negative_vs_neutral", 0.1 * (i + 1)) for i in range(3)]
    rows += [("s", 50, "neutral_vs_positive", 0.3), ("t", 1, "negative_vs_positive", None)]
    got = {r["session_id"]: r for r in X.tlbs_features(bias_frame(spark, rows), block).collect()}
    r = got["s"]
    want = {"mean_pos": 0.75, "mean_neg": -0.625, "peak_pos": 1.0, "peak_neg": -1.0, "mean_abs": 0.55,
            "variability": np.mean(np.abs(np.diff(v))), "slope": np.polyfit(x, v, 1)[0]}
    for k, w in want.items():
        assert r[f"tlbs_{k}__neg_vs_pos"] == pytest.approx(w)
    assert r["tlbs_mean_neg__neg_vs_neu"] == 0.0  # no negative value, long enough
    assert r["tlbs_mean_pos__pos_vs_neu"] is None  # too short
    assert all(got["t"][n] is None for n in X.tlbs_names())


def test_thirds(spark):
    rows = [("s", 2 * i + 1) for i in range(7)] + [("one", 1)]
    df = spark.createDataFrame(rows, "session_id string, scene_index int")
    got = P.with_thirds(P.trial_numbers(df, 4)).collect()
    parts = {(r["session_id"], r["trial_num"]): r["is_early"] for r in got}
    assert parts == {("s", 1): True, ("s", 2): True, ("s", 5): False, ("s", 6): False,
                     ("s", 7): False, ("one", 1): False}


def test_trial_norm(spark):
    df = spark.createDataFrame([("s", i) for i in (1, 3, 9)] + [("o", 5)],
                               "session_id string, scene_index int")
    got = P.with_trial_norm(P.trial_numbers(df)).collect()
    assert sorted((r["session_id"], r["trial_norm"]) for r in got) == [
        ("o", 0.0), ("s", 0.0), ("s", 0.5), ("s", 1.0)]


@pytest.mark.parametrize("score, whole, mean, cls", [
    (4, "minimal", "minimal", 0), (4.5, "mild", "minimal", 1), (5, "mild", "mild", 1),
    (9, "mild", "mild", 1), (14, "moderate", "moderate", 2), (19, "moderately_severe",
                                                             "moderately_severe", 3),
    (20, "severe", "severe", 4), (None, None, None, None),
])
def test_severity_rules(spark, score, whole, mean, cls):
    df = spark.createDataFrame([(None if score is None else float(score),)], "s double")
    r = df.select(C.severity("s", M.PHQ9), C.severity_of_mean("s", M.PHQ9),
                  C.severity_class("s", M.PHQ9)).first()
    assert tuple(r) == (whole, mean, cls)


def test_targets(spark):
    df = spark.createDataFrame([(4.0, 13.0), (12.0, 20.0), (20.0, 29.0), (None, None)],
                               "phq9_score double, bdi_score double")
    got = [(r["phq9_depressed"], r["bdi_depressed"], r["phq9_extreme"], r["bdi_extreme"])
           for r in P.targets(df).collect()]
    assert got == [(0, 0, 0, 0), (1, 1, None, None), (1, 1, 1, 1), (None, None, None, None)]


@pytest.mark.parametrize("hz, label", [(10, "<10"), (10.1, "10-15"), (30, "25-30"), (41, "40+"),
                                       (0, None), (1001, None)])
def test_rate_buckets(spark, hz, label):
    df = spark.createDataFrame([(float(hz),)], "hz double")
    assert df.select(R.rate_bucket()).first()[0] == label


def test_expressions(spark):
    df = spark.createDataFrame([("nan", "1.5x", "", "FALSE"), ("7", None, "no_image", None)],
                               "a string, b string, c string, d string")
    got = df.select(C.number("a"), C.number("b"), C.real_image("c"), C.flag("d")).collect()
    assert [tuple(r) for r in got] == [(None, None, None, False), (7.0, None, None, True)]
    p = spark.createDataFrame([(0.0005,), (0.005,), (0.03,), (0.2,), (None,)], "p double")
    assert [r[0] for r in p.select(C.stars("p")).collect()] == ["***", "**", "*", "n.s.", None]


def test_sessions_without_user_are_nobodys(spark):
    from fixatio.operators import features as X

    rows = spark.createDataFrame([("u", 1.0), ("u", 3.0), (None, 9.0)], "uid string, a double")
    assert [tuple(r) for r in X.user_means(rows, ["a"]).collect()] == [("u", 2.0)]
