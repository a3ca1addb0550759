import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixatio.operators import blocks as B
from fixatio.operators import prepare as P


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows and one value most of those."""
    rng = random.Random(7)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i,
             5.0 if rng.random() < 0.4 else round(rng.gauss(0, 10), 2)) for i in range(3000)]
    pdf = pd.DataFrame(rows, columns=["k", "i", "v"])
    return spark.createDataFrame(rows, "k string, i long, v double"), pdf


@pytest.mark.parametrize("size", [1, 64, 10_000])
def test_number_rows(skewed, size):
    df, pdf = skewed
    got = B.number_rows(df, ["k"], ["i"], B.block("i", size), "n").toPandas().sort_values("i")
    want = pdf.groupby("k").cumcount() + 1
    assert got["n"].tolist() == want.tolist()


@pytest.mark.parametrize("size", [1, 64, 10_000])
def test_with_previous(skewed, size):
    df, pdf = skewed
    got = B.with_previous(df, ["k"], ["i"], B.block("i", size), {"p": "v"}).toPandas()
    want = pdf.groupby("k")["v"].shift()
    assert got.sort_values("i")["p"].fillna(-99).tolist() == want.fillna(-99).tolist()


def test_average_ranks(skewed):
    df, pdf = skewed
    got = B.average_ranks(df, ["k"], {"r": "v"}).toPandas().sort_values("i")
    assert got["r"].tolist() == pdf.groupby("k")["v"].rank().tolist()


def test_exact_quantiles(skewed):
    df, pdf = skewed
    probs = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.93, "e": 1.0}
    got = B.exact_quantiles(df, ["k"], "v", probs).toPandas().set_index("k")
    for name, p in probs.items():
        want = pdf.groupby("k")["v"].quantile(p)
        assert got[name].to_dict() == pytest.approx(want.to_dict())
    one = B.exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert one == pytest.approx(pdf["v"].median())


def test_cumulate_values_without_rows(spark):
    empty = spark.createDataFrame([], "v double")
    assert B.exact_quantiles(empty, [], "v", {"m": 0.5}).first()["m"] is None


def test_median_split_and_trim(skewed):
    df, pdf = skewed
    m = pdf["v"].median()
    got = P.median_split(df, "v").groupBy("score_group").count().collect()
    assert {r["score_group"]: r["count"] for r in got} == {
        "Low": int((pdf["v"] < m).sum()), "High": int((pdf["v"] >= m).sum())}
    lo, hi = pdf["v"].quantile(0.01), pdf["v"].quantile(0.99)
    assert P.trim(df, "v").count() == int(pdf["v"].between(lo, hi).sum())


def test_null_keys_match_when_asked(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int").alias("l")
    b = spark.createDataFrame([(None, 3), ("x", 4)], "k string, w int").alias("r")
    got = a.join(b, B.null_safe("l", "r", ["k"])).select("v", "w")
    assert sorted(map(tuple, got.collect())) == [(1, 3), (2, 4)]


def test_block_is_monotone(spark):
    rows = spark.range(1000).select("id", B.block("id", 64).alias("b"))
    assert rows.groupBy("b").agg(F.max("id") - F.min("id")).count() == 16


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_values_in_blocks_of_any_size(skewed, size):
    """More blocks than 64, one block, and keys that are NULL give the same sums."""
    df, pdf = skewed
    df = df.union(df.filter("k = 'a'").selectExpr("null as k", "i", "v"))
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    got = B.cumulate_values(counts, ["k"], "v", ["n"], block_values=size, keep_block=True).toPandas()
    assert (got["_blk"].nunique() > 64) == (size == 7) and (got["_blk"].nunique() == 1) == (size == 100_000)
    for key in ["hot", "a", "b", "c", None]:
        own = got[got["k"].isna() if key is None else got["k"] == key].sort_values("v")
        plain = pdf[pdf["k"] == (key or "a")].groupby("v").size()
        assert own["n_before"].tolist() == (plain.cumsum() - plain).tolist()
        assert set(own["n_total"]) == {plain.sum()}


def test_a_plan_reads_its_blocks_from_storage(skewed):
    """Where cuts fall is decided once: no sample or range exchange is left in the plan."""
    df, _ = skewed
    counts = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    plan = B.cumulate_values(counts, ["k"], "v", ["n"], block_values=50)._jdf.queryExecution().toString()
    assert "rangepartitioning" not in plan and "percentile" not in plan and "Scan parquet" in plan


def test_rows_without_key_or_block_stay(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", None, 6), (None, 1, 7), (None, 2, 8)], "k string, i int, v int")
    got = B.number_rows(rows, ["k"], ["i"], B.block("i", 2), "n").collect()
    assert sorted((r.v, r.n) for r in got) == [(5, 2), (6, 1), (7, 1), (8, 2)]
    steps = B.with_previous(rows, ["k"], ["i"], B.block("i", 2), {"p": "v"}).collect()
    assert sorted((r.v, r.p) for r in steps if r.k is None) == [(7, None), (8, 7)] and len(steps) == 4


def test_median_of_each_key(skewed):
    df, pdf = skewed
    m = pdf.groupby("k")["v"].transform("median")
    got = P.median_split(df, "v", keys=["k"]).groupBy("score_group").count().collect()
    assert {r["score_group"]: r["count"] for r in got} == {
        "Low": int((pdf["v"] < m).sum()), "High": int((pdf["v"] >= m).sum())}


@pytest.mark.parametrize("bracket, small", [(0.001, 50), (0.02, 300), (0.0, 5)])
def test_quantiles_from_brackets(spark, monkeypatch, bracket, small):
    """Keys larger than the bound, ties, and brackets that are too narrow and must be widened."""
    monkeypatch.setattr(B, "BRACKET", bracket)
    monkeypatch.setattr(B, "SMALL_KEY", small)
    rng = random.Random(5)
    rows = [(k, v) for k, n in (("a", 9000), ("b", 700), ("c", 40), ("d", 1), (None, 3000)) for v in (
        rng.choice([rng.gauss(0, 1), float(rng.randrange(4)), 2.0]) for _ in range(n))]
    rows += [("e", 7.0)] * 6000 + [("e", 8.0)] + [("f", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    probs = {"q0": 0.0, "q01": 0.01, "q25": 0.25, "q50": 0.5, "q99": 0.99, "q1": 1.0}
    pdf = pd.DataFrame(rows, columns=["k", "v"])
    got = {r["k"]: r for r in B.exact_quantiles(df, ["k"], "v", probs).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None}
    whole = B.exact_quantiles(df, [], "v", probs).first()
    for name, p in probs.items():
        assert whole[name] == pytest.approx(pdf["v"].quantile(p), abs=1e-12)
        for k, r in got.items():
            mine = pdf[pdf["k"].isna() if k is None else pdf["k"] == k]["v"]
            assert r[name] == pytest.approx(mine.quantile(p), abs=1e-12), (k, name)


def test_only_brackets_are_put_in_order(spark, monkeypatch):
    seen = []
    cumulate = B.cumulate_values
    monkeypatch.setattr(B, "cumulate_values", lambda counts, *rest: seen.append(counts.count()) or cumulate(counts, *rest))
    df = spark.range(200_000).selectExpr("cast(hash(id) as double) as v")
    got = B.exact_quantiles(df, [], "v", {"m": 0.5, "hi": 0.9}).first()
    want = df.toPandas()["v"].quantile([0.5, 0.9]).tolist()
    assert [got["m"], got["hi"]] == want
    assert seen and max(seen) < 0.01 * 200_000
