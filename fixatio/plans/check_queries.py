"""Result tables of models and tests, on numbers folded from given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatio.functions import columns as C
from fixatio.operators import learn as N
from fixatio.operators import mixed as L
from fixatio.operators import stats as S
from fixatio.plans import inputs as I
from fixatio.plans.oracle import SUPPLIER_FOLDS
from fixatio.plans.registry import register
from fixatio.plans.stages import keep


@register(
    "correlation_tests",
    """
select l_partkey, r as spearman_r, n, p as p_value,
  case when p < 0.001 then '***' when p < 0.01 then '**' when p < 0.05 then '*' else 'n.s.' end as stars
from (
  select l_partkey, any_value(r) as r, any_value(n) as n, 1 - case
    when any_value(v) % 2 = 0 then abs(any_value(r)) * coalesce(sum(
      exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * power(any_c, 2 * j)), 0)
    else 2 / pi() * (asin(abs(any_value(r))) + abs(any_value(r)) * coalesce(sum(
      exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * power(any_c, 2 * j + 1)), 0)) end as p
  from (select *, n - 2 as v, sqrt(1 - r * r) as any_c, unnest(range(0, greatest(1, (n - 2) // 2))) as j
        from (select l_partkey, round(corr(l_quantity, l_discount), 9) as r, count(*) as n
              from lineitem group by l_partkey having count(*) >= 5))
  group by l_partkey)""",
    others=["l_partkey", "n", "stars"], nums=["p_value"],
)
def correlation_tests(spark, d):
    """p-values and stars of one correlation per part; Student's tail is a finite sum in SQL."""
    rows = I.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.round(F.corr("l_quantity", "l_discount"), 9).alias("spearman_r"), F.count("*").alias("n")
    ).filter("n >= 5")
    return S.with_p_value(rows).withColumn("stars", C.stars("p_value")).drop("spearman_r")


def _means(spark, d, keys, **named):
    """Means per group, rounded past the noise of their sums."""
    return I.table(spark, d, "lineitem").groupBy(*keys).agg(
        *[F.round(F.avg(F.expr(e)), 9).alias(n) for n, e in named.items()]
    )


@register(
    "term_ranking",
    """
select metric, pair_suffix, (a < 0.05)::int + (b < 0.05)::int + (c < 0.05)::int as n_significant, c as interaction_pval
from (select cast(l_suppkey as varchar) as metric, l_returnflag as pair_suffix, round(avg(l_discount), 9) as a,
        round(avg(l_tax), 9) as b, round(avg(l_quantity / 500), 9) as c from lineitem group by all)""",
    others=["metric", "pair_suffix", "n_significant"], nums=["interaction_pval"],
)
def term_ranking(spark, d):
    rows = _means(spark, d, ["l_suppkey", "l_returnflag"], score_pval="l_discount", trial_norm_pval="l_tax",
                  interaction_pval="l_quantity / 500")
    return L.significant_counts(rows.select(
        F.col("l_suppkey").cast("string").alias("metric"), F.col("l_returnflag").alias("pair_suffix"), "*"
    ))


@register(
    "reliability_summary",
    "select avg(v) as mean_icc, median(v) as median_icc from "
    "(select round(avg(l_discount), 9) as v from lineitem group by l_suppkey)",
    nums=["mean_icc", "median_icc"],
)
def reliability_summary(spark, d):
    return L.icc_report(_means(spark, d, ["l_suppkey"], icc="l_discount"))


def _scores(spark, d, discount: str):
    """A table as the learners give it: a row per model and feature set with its scores."""
    return _means(spark, d, ["l_returnflag", "l_linestatus"], auc_roc=discount, f1_weighted="l_tax * 10",
                  r2="l_quantity / 50").withColumnsRenamed({"l_returnflag": "model", "l_linestatus": "feature_set"})


@register(
    "score_by_set",
    """
select l_returnflag as model, max(v) filter (l_linestatus = 'F') as "F", max(v) filter (l_linestatus = 'O') as "O"
from (select l_returnflag, l_linestatus, round(avg(l_discount), 9) as v from lineitem group by all) group by all""",
    others=["model"], nums=["F", "O"],
)
def score_by_set(spark, d):
    return N.model_by_set(_scores(spark, d, "l_discount"), "auc_roc", ["F", "O"])


_BEST = """
select '{task}' as task, '{score}' as phq9_metric, max(a) as phq9_value,
  arg_max(l_returnflag || ' / ' || l_linestatus, a) as phq9_model, '{score}' as bdi_metric, max(b) as bdi_value,
  arg_max(l_returnflag || ' / ' || l_linestatus, b) as bdi_model
from (select l_returnflag, l_linestatus, round(avg({first}), 9) as a, round(avg({second}), 9) as b
      from lineitem group by all)"""


@register(
    "best_of_scores",
    " union all ".join(_BEST.format(task=t, score=s, first=a, second=b) for t, s, a, b in (
        ("Binary", "auc_roc", "l_discount", "1 - l_discount"),
        ("Multi-class", "f1_weighted", "l_tax * 10", "l_tax * 10"), ("Regression", "r2", "l_quantity / 50", "l_quantity / 50"),
    )),
    others=["task", "phq9_metric", "phq9_model", "bdi_metric", "bdi_model"], nums=["phq9_value", "bdi_value"],
)
def best_of_scores(spark, d):
    a, b = _scores(spark, d, "l_discount"), _scores(spark, d, "1 - l_discount")
    return N.best_models({
        "Binary": (a, b, "auc_roc"), "Multi-class": (a, b, "f1_weighted"), "Regression": (a, b, "r2"),
    })


@register(
    "ridge_out_of_fold",
    """
with folded as (
  select l.*, f.fold from lineitem l join (""" + SUPPLIER_FOLDS + """) f using (l_suppkey)
), fits as (
  select o.fold, count(*) as n, avg(l_quantity) as mx, stddev_samp(l_quantity) as sx, avg(l_extendedprice) as my,
    covar_samp(l_quantity, l_extendedprice) as cxy
  from folded t join (select distinct fold from folded) o on t.fold <> o.fold group by o.fold
)
select l_orderkey, l_linenumber, l_suppkey, fold, l_extendedprice as label,
  my + (cxy * (n - 1) / sx) / (n - 1 + 1) * (l_quantity - mx) / sx as prediction
from folded join fits using (fold)""",
    others=["l_orderkey", "l_linenumber", "l_suppkey", "fold"], nums=["label", "prediction"], digits=3,
)
def ridge_out_of_fold(spark, d):
    """Predictions of line prices from quantities, suppliers kept whole; SQL solves the normal equations."""
    rows = I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    ids = ["l_orderkey", "l_linenumber", "l_suppkey", "fold"]
    stored = keep(N.assemble(N.grouped_folds(rows, "l_suppkey"), ["l_quantity"], "l_extendedprice", ids))
    return N.cross_predict(stored, N.ridge).select(*ids, "label", "prediction")
