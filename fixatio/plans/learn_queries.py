"""Cross-validated models and the scores of predictions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from fixatio.operators import features as X
from fixatio.operators import learn as N
from fixatio.operators import prepare as P
from fixatio.plans import inputs as I
from fixatio.plans.feature_queries import user_table
from fixatio.plans.oracle import SUPPLIER_FOLDS
from fixatio.plans.registry import register
from fixatio.plans.stages import stage

DIMS = [f"x{i}" for i in range(64)]
SETS = {"All dimensions": DIMS, "Even dimensions": DIMS[::2]}


def vectors(spark, d):
    """Embeddings as feature columns; fifty groups stand for users."""
    rows = I.table(spark, d, "embeddings")
    return rows.select(
        "vec_id", "label", (F.col("vec_id") % 50).alias("grp"),
        (F.col("label") >= 5).cast("int").alias("high"),
        (F.col("label") % 2).alias("odd"),
        F.floor(F.abs(F.col("label") * 2 - 9) / 2).cast("int").alias("distance"),
        *[F.col("embedding")[i].cast("double").alias(x) for i, x in enumerate(DIMS)],
    )


def _store(spark, d, tag):
    return lambda rows, name: stage(
        spark, d, f"learn_{tag}_{re.sub('[^a-z0-9]+', '_', name.lower())}", lambda: rows
    )


@register(
    "grouped_folds",
    f"select l.l_orderkey, l.l_linenumber, l.l_suppkey, f.fold from lineitem l join ({SUPPLIER_FOLDS}) f using (l_suppkey)",
    others=["l_orderkey", "l_linenumber", "l_suppkey", "fold"],
)
def grouped_folds(spark, d):
    rows = I.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return N.grouped_folds(rows, "l_suppkey")


def run(spark, d, task, label, models, sets=SETS):
    tag = f"{task}_{label}"
    name = "runs_" + tag + "_" + "_".join(m.split()[0].lower() for m in models)
    return stage(
        spark, d, name,
        lambda: N.run_models(spark, vectors(spark, d), sets, label, "grp", task, models,
                             store=_store(spark, d, tag)),
    )


def _pick(models, *names):
    return {n: models[n] for n in names}


@register("binary_linear_run")
def binary_linear_run(spark, d):
    return run(spark, d, "binary", "high", _pick(N.CLASSIFIERS, "Logistic Regression"))


@register("binary_forest_run")
def binary_forest_run(spark, d):
    return run(spark, d, "binary", "high", _pick(N.CLASSIFIERS, "Random Forest"),
               {"All dimensions": DIMS})


@register("multiclass_linear_run")
def multiclass_linear_run(spark, d):
    return run(spark, d, "multiclass", "label", _pick(N.MULTICLASS, "Logistic Regression"))


@register("regression_linear_run")
def regression_linear_run(spark, d):
    return run(spark, d, "regression", "label", _pick(N.REGRESSORS, "Ridge Regression"))


@register("binary_boosted_run")
def binary_boosted_run(spark, d):
    return run(spark, d, "binary", "high", _pick(N.CLASSIFIERS, "Gradient Boosting"),
               {"All dimensions": DIMS})


@register("multiclass_forest_run")
def multiclass_forest_run(spark, d):
    return run(spark, d, "multiclass", "label", _pick(N.MULTICLASS, "Random Forest"),
               {"All dimensions": DIMS})


@register("multiclass_boosted_run")
def multiclass_boosted_run(spark, d):
    return run(spark, d, "multiclass", "label", _pick(N.MULTICLASS, "Gradient Boosting"),
               {"All dimensions": DIMS})


@register("regression_forest_run")
def regression_forest_run(spark, d):
    return run(spark, d, "regression", "label", _pick(N.REGRESSORS, "Random Forest"),
               {"All dimensions": DIMS})


@register("regression_boosted_run")
def regression_boosted_run(spark, d):
    return run(spark, d, "regression", "label", _pick(N.REGRESSORS, "Gradient Boosting"),
               {"All dimensions": DIMS})


def user_rows(spark, d, family: str = "static"):
    """User means of a family's features with targets, missing features as 0."""
    sets = X.feature_sets(family)
    f = list(dict.fromkeys(c for cols in sets.values() for c in cols))
    return stage(
        spark, d, f"user_model_rows_{family}",
        lambda: P.model_rows(P.targets(user_table(spark, d, family)), f, P.SCORES),
    )


def family_runs(spark, d, family: str, task: str, label: str, models):
    """Every feature set of a family against one target of the users."""
    tag = f"{family}_{label}"
    return stage(
        spark, d, f"family_runs_{task}_{tag}",
        lambda: N.run_models(
            spark, user_rows(spark, d, family), X.feature_sets(family), label, "uid", task, models,
            store=_store(spark, d, tag),
        ),
    )


def both_scores(spark, d, family: str, task: str, suffix: str, models):
    """The runs of a family against the targets of both questionnaires."""
    out = [
        family_runs(spark, d, family, task, f"{scale}_{suffix}", models).withColumn("scale", F.lit(scale))
        for scale in ("phq9", "bdi")
    ]
    return out[0].unionByName(out[1])


@register("distributional_regression_runs")
def distributional_regression_runs(spark, d):
    return both_scores(spark, d, "distributional", "regression", "score", _pick(N.REGRESSORS, "Ridge Regression"))


@register("temporal_regression_runs")
def temporal_regression_runs(spark, d):
    return both_scores(spark, d, "temporal", "regression", "score", _pick(N.REGRESSORS, "Ridge Regression"))


@register("tlbs_regression_runs")
def tlbs_regression_runs(spark, d):
    return both_scores(spark, d, "tlbs", "regression", "score", _pick(N.REGRESSORS, "Ridge Regression"))


@register("static_extreme_group_runs")
def static_extreme_group_runs(spark, d):
    """Users at both ends of each scale from their static features, by forests."""
    return both_scores(spark, d, "static", "binary", "extreme", _pick(N.CLASSIFIERS, "Random Forest"))


@register("static_severity_class_runs")
def static_severity_class_runs(spark, d):
    """Severity classes of each scale from the static features, by forests."""
    return both_scores(spark, d, "static", "multiclass", "severity_class", _pick(N.MULTICLASS, "Random Forest"))


@register("user_regression_run")
def user_regression_run(spark, d):
    """Scores of users from their static features, both feature sets."""
    return stage(
        spark, d, "user_runs",
        lambda: N.run_models(
            spark, user_rows(spark, d), X.feature_sets("static"), "bdi_score", "uid", "regression",
            _pick(N.REGRESSORS, "Ridge Regression"), store=_store(spark, d, "user"),
        ),
    )


@register("model_by_feature_set")
def model_by_feature_set(spark, d):
    return N.model_by_set(binary_linear_run(spark, d), "auc_roc", list(SETS))


@register("best_models")
def best_models(spark, d):
    """Two targets of each kind side by side: the label, and its parity or distance from the middle."""
    logistic, ridge = (_pick(m, n) for m, n in ((N.CLASSIFIERS, "Logistic Regression"), (N.REGRESSORS, "Ridge Regression")))
    return N.best_models({
        "Binary": (binary_linear_run(spark, d), run(spark, d, "binary", "odd", logistic), "auc_roc"),
        "Multi-class": (
            multiclass_linear_run(spark, d), run(spark, d, "multiclass", "distance", logistic), "f1_weighted"
        ),
        "Regression": (regression_linear_run(spark, d), run(spark, d, "regression", "distance", ridge), "r2"),
    })


@register("feature_importance")
def feature_importance(spark, d):
    rows = stage(
        spark, d, "importance_rows",
        lambda: N.assemble(vectors(spark, d), DIMS, "high", []),
    )
    return N.feature_importance(rows, DIMS)


# --- scores on given tables ------------------------------------------------------------


def judged(spark, d):
    """Two judgements of the same documents: one taken as truth, the other as prediction."""
    return I.table(spark, d, "labels").select(
        F.col("quality").alias("label"), F.col("toxic").alias("prediction")
    )


@register("confusion_matrix",
          "select quality as actual, toxic as predicted, count(*) as n from labels group by all",
          others=["actual", "predicted", "n"])
def confusion_matrix(spark, d):
    return N.confusion(judged(spark, d))


REPORT = {"report": """
select c.class, tp, support, pred_n, case when pred_n > 0 then tp / pred_n::double else 0 end as precision,
  case when support > 0 then tp / support::double else 0 end as recall,
  case when support + pred_n > 0 then 2 * tp / (support + pred_n)::double else 0 end as f1
from (select class, (select count(*) from labels where quality = class and toxic = class) as tp,
        (select count(*) from labels where quality = class) as support,
        (select count(*) from labels where toxic = class) as pred_n
      from (select distinct quality as class from labels union select toxic from labels)) c"""}


@register("class_report", "select * from report", others=["class", "support"],
          nums=["precision", "recall", "f1"], extra=REPORT)
def class_report(spark, d):
    return N.class_report(N.confusion(judged(spark, d)))


@register(
    "class_scores",
    "select (select avg((quality = toxic)::int) from labels) as accuracy, "
    "sum(f1 * support) / sum(support) as f1_weighted from report",
    nums=["accuracy", "f1_weighted"], extra=REPORT,
)
def class_scores(spark, d):
    return N.class_scores(judged(spark, d))


SCORED = {"scored": "select (l_returnflag = 'R')::int as y, l_extendedprice as s from lineitem"}


def scored(spark, d):
    return I.table(spark, d, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        F.col("l_extendedprice").alias("score"),
    )


@register(
    "roc_auc",
    """
select (sum(r) filter (y = 1) - p * (p + 1) / 2) / (p * q) as auc_roc from (
  select y, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2.0::double as r,
    (sum(y) over ())::double as p, (count(*) over () - sum(y) over ())::double as q from scored)
group by p, q""",
    nums=["auc_roc"], extra=SCORED,
)
def roc_auc(spark, d):
    return N.roc_auc(scored(spark, d))


@register(
    "roc_points",
    """
select s as threshold, sum(a) over (order by s desc) / (sum(a) over ())::double as tpr,
  sum(b) over (order by s desc) / (sum(b) over ())::double as fpr
from (select s, sum(y) as a, sum(1 - y) as b from scored group by s)""",
    nums=["threshold", "tpr", "fpr"], extra=SCORED,
)
def roc_points(spark, d):
    return N.roc_points(scored(spark, d))


def priced(spark, d):
    return I.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("label"),
        (F.col("l_extendedprice") / 2000).alias("prediction"),
    )


@register(
    "regression_scores",
    "select 1 - sum(power(l_quantity - p, 2)) / (var_pop(l_quantity) * count(*)) as r2, "
    "avg(abs(l_quantity - p)) as mae, sqrt(avg(power(l_quantity - p, 2))) as rmse "
    "from (select *, l_extendedprice / 2000 as p from lineitem)",
    nums=["r2", "mae", "rmse"],
)
def regression_scores(spark, d):
    return N.regression_scores(priced(spark, d))


@register(
    "residuals",
    "select *, l_quantity as label, l_extendedprice / 2000 as prediction, "
    "l_quantity - l_extendedprice / 2000 as residual from lineitem",
    others=["l_orderkey", "l_linenumber"], nums=["label", "prediction", "residual"],
)
def residuals(spark, d):
    return N.residuals(priced(spark, d))
