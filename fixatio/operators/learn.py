"""Group-wise cross-validated prediction on Spark ML, and scores of the predictions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.functions import columns as C
from fixatio.operators import blocks as B
from fixatio.operators import ridge as R
from fixatio.operators.boosting import HistogramBoosting
from fixatio.operators.forest import BlockForest

# --- fixed values: model settings ------------------------------------------------
TREES, ROUNDS, DEPTH, RATE, SEED, FOLDS = 200, 200, 4, 0.1, 42, 5
FOREST_DEPTH = 30
# ---------------------------------------------------------------------------------

Maker = Callable[[int], Estimator | HistogramBoosting | BlockForest]


def _scaled(last) -> Pipeline:
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True)
    return Pipeline(stages=[scaler, last])


def logistic(n: int) -> Estimator:
    """Ridge-penalised with unit strength on the summed loss, which is 1/n on the mean."""
    return _scaled(LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=1000,
                                      regParam=1.0 / n, standardization=False))


class Ridge(Estimator):
    """Ridge regression with unit strength on the summed squared error of scaled features.

    Spark's penalty acts on the label divided by its deviation, so the deviation of the
    rows that are fitted to goes into its strength.
    """

    def __init__(self, n: int, alpha: float = 1.0):
        super().__init__()
        self.n, self.alpha = n, alpha

    def _fit(self, rows: DataFrame):
        deviation = rows.agg(F.stddev_pop("label")).first()[0] or 0.0
        return _scaled(LinearRegression(
            featuresCol="scaled", labelCol="label", elasticNetParam=0.0, standardization=False,
            regParam=self.alpha * deviation / self.n,
        )).fit(rows)


def ridge(n: int) -> Estimator:
    return Ridge(n)


def forest_classifier(n: int, trees: int = TREES) -> BlockForest:
    return BlockForest("class", trees, FOREST_DEPTH, SEED, "sqrt")


def forest_regressor(n: int, trees: int = TREES) -> BlockForest:
    return BlockForest("regression", trees, FOREST_DEPTH, SEED, "all")


def boosted_classifier(n: int, rounds: int = ROUNDS) -> HistogramBoosting:
    return HistogramBoosting("binary", rounds, DEPTH, RATE)


def boosted_multiclass(n: int, rounds: int = ROUNDS) -> HistogramBoosting:
    return HistogramBoosting("multiclass", rounds, DEPTH, RATE)


def boosted_regressor(n: int, rounds: int = ROUNDS) -> HistogramBoosting:
    return HistogramBoosting("regression", rounds, DEPTH, RATE)


CLASSIFIERS: dict[str, Maker] = {
    "Logistic Regression": logistic,
    "Random Forest": forest_classifier,
    "Gradient Boosting": boosted_classifier,
}
MULTICLASS: dict[str, Maker] = {**CLASSIFIERS, "Gradient Boosting": boosted_multiclass}
REGRESSORS: dict[str, Maker] = {
    "Ridge Regression": ridge,
    "Random Forest": forest_regressor,
    "Gradient Boosting": boosted_regressor,
}


def greedy_segments(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, int, int, list[int]]]:
    """Groups dealt out one by one, largest first, each to the lightest fold (the first of equal ones).

    ``sizes`` are (size of a group, number of such groups). Returns (size, start, stop, cycle): the
    groups of a size with the numbers start..stop - 1 go to the folds of the cycle in turn. Folds that
    are less than a group apart take turns until they reach the next heavier one, so there are at
    most k segments a size, however many groups it has.
    """
    load, out = [0] * k, []
    for size, n in sorted(sizes, reverse=True):
        start = 0
        while start < n:
            order = sorted(range(k), key=lambda f: (load[f], f))
            lightest = order[0]
            cycle = [f for f in order if (load[f], f) < (load[lightest] + size, lightest)]
            turns, last = -(-(n - start) // len(cycle)), cycle[-1]
            if len(cycle) < k:  # turns in which the last of the cycle comes before the next fold
                nearest = order[len(cycle)]
                gap = load[nearest] - load[last]
                turns = min(turns, (gap - 1 if nearest < last else gap) // size + 1)
            length = min(turns * len(cycle), n - start)
            for i, f in enumerate(cycle):
                load[f] += size * (length // len(cycle) + (i < length % len(cycle)))
            out.append((size, start, start + length, cycle))
            start += length
    return out


def grouped_folds(df: DataFrame, group: str, k: int = FOLDS) -> DataFrame:
    """Add ``fold``: groups go to the lightest fold, largest first; no group is split.

    Groups of one size go in order of a hash of their id, whose prefix also serves as
    the block for numbering them, so many small groups do not meet in one task. The driver sees
    one row per distinct size of a group, of which n rows can have sqrt(2n) at most.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")).withColumn(
        "_h", F.md5(F.col(group).cast("string"))
    )
    prefix = F.conv(F.substring("_h", 1, 3), 16, 10).cast("long")
    numbered = B.number_rows(sizes, ["_size"], ["_h", group], prefix, "_no")
    per_size = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("n")).collect()
    segments = df.sparkSession.createDataFrame(
        greedy_segments([(r["_size"], r["n"]) for r in per_size], k), "_size long, _from long, _to long, _cycle array<int>"
    )
    turn = ((F.col("_no") - 1 - F.col("_from")) % F.size("_cycle")).cast("int")
    place = numbered.join(segments, "_size").filter((F.col("_no") > F.col("_from")) & (F.col("_no") <= F.col("_to"))).select(
        group, F.get("_cycle", turn).alias("fold")
    )
    return df.join(place, group)


def assemble(df: DataFrame, features: Sequence[str], label: str, keep: Sequence[str]) -> DataFrame:
    """Feature vector and label next to the kept columns."""
    vector = VectorAssembler(inputCols=list(features), outputCol="features")
    rows = df.withColumn("label", F.col(label).cast("double"))
    return vector.transform(rows).select(*keep, "label", "features")


def cross_predict(rows: DataFrame, make: Maker, k: int = FOLDS) -> DataFrame:
    """Out-of-fold predictions, and for binary models the score of class 1.

    ``rows`` has ``features``, ``label`` and ``fold`` and is read many times, so it
    should be a stored table.
    """
    sizes = {r["fold"]: r["n"] for r in rows.groupBy("fold").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    if isinstance(model := make(total), HistogramBoosting | BlockForest):  # all folds at once
        return model.cross_predict(rows, k)
    if isinstance(model, Ridge):
        return R.cross_predict(rows, k, model.alpha)

    def one_fold(f: int) -> DataFrame:
        fitted = make(total - sizes[f]).fit(rows.filter(F.col("fold") != f))
        pred = fitted.transform(rows.filter(F.col("fold") == f))
        score = (
            vector_to_array("probability")[1] if "probability" in pred.columns
            else F.lit(None).cast("double")
        )
        drop = {"features", "scaled", "rawPrediction", "probability"}
        return pred.withColumn("score", score).select(
            *[c for c in pred.columns if c not in drop], "score"
        )

    folds = [f for f in range(k) if f in sizes and sizes[f] < total]
    with ThreadPool(len(folds)) as pool:  # the fits are Spark jobs of their own
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(one_fold), folds)
    return reduce(DataFrame.unionByName, parts)


# --- scores ------------------------------------------------------------------------


def confusion(pred: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, from confusion cells."""
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    act = cells.groupBy(F.col("actual").alias("class")).agg(
        right.alias("tp"), F.sum("n").alias("support")
    )
    pre = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("predicted_n"))
    zero = F.lit(0.0)
    return (
        act.join(pre, "class", "full").fillna(0, ["tp", "support", "predicted_n"])
        .withColumn("precision", F.coalesce(F.try_divide("tp", "predicted_n"), zero))
        .withColumn("recall", F.coalesce(F.try_divide("tp", "support"), zero))
        .withColumn(
            "f1", F.coalesce(F.try_divide(2 * F.col("tp"), F.col("support") + F.col("predicted_n")),
                             zero)
        )
        .select("class", "precision", "recall", "f1", "support")
    )


def class_scores(pred: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """Accuracy and support-weighted F1, one row."""
    cells = confusion(pred, y, p)
    acc = cells.agg(
        C.ratio(
            F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)),
            F.sum("n"),
        ).alias("accuracy")
    )
    f1 = class_report(cells).agg(
        C.ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted")
    )
    return acc.crossJoin(f1)  # one row each


def roc_auc(pred: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve by average ranks, one row; NULL with one class only."""
    pos = (F.col(y) == 1).cast("long")
    counts = pred.groupBy(score).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(pos).alias("_pos")
    )
    rows = B.cumulate_values(counts, [], score, ["_n"])
    rank = F.col("_n_before") + (F.col("_n") + 1) / 2
    sums = rows.agg(
        F.sum(rank * F.col("_pos")).alias("r"), F.sum("_pos").cast("double").alias("p"),
        (F.sum("_n") - F.sum("_pos")).cast("double").alias("q"),
    )
    area = (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))
    return sums.select(F.when((F.col("p") > 0) & (F.col("q") > 0), area).alias("auc_roc"))


def roc_points(pred: DataFrame, y: str = "label", score: str = "score") -> DataFrame:
    """True and false positive rates at every distinct score, taken as threshold."""
    pos = (F.col(y) == 1).cast("long")
    counts = pred.groupBy((-F.col(score)).alias("_neg")).agg(
        F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg")
    )
    rows = B.cumulate_values(counts, [], "_neg", ["pos", "neg"])
    return rows.select(
        (-F.col("_neg")).alias("threshold"),
        C.ratio(F.col("pos_before") + F.col("pos"), "pos_total").alias("tpr"),
        C.ratio(F.col("neg_before") + F.col("neg"), "neg_total").alias("fpr"),
    )


def residuals(pred: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    return pred.withColumn("residual", F.col(y) - F.col(p))


def regression_scores(pred: DataFrame, y: str = "label", p: str = "prediction") -> DataFrame:
    """R2, mean absolute and root mean squared error, one row."""
    e = F.col(y) - F.col(p)
    return pred.agg(
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(y))).alias("r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
    )


# --- runs --------------------------------------------------------------------------


def run_models(
    spark: SparkSession, df: DataFrame, feature_sets: dict[str, Sequence[str]], label: str,
    group: str, task: str, models: dict[str, Maker] | None = None, k: int = FOLDS,
    store: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows,
) -> DataFrame:
    """Cross-validated scores per feature set and model, best first.

    ``store`` writes the rows of one feature set, and the predictions of one run, to a shared
    folder and reads them back; the driver only sees one row of scores per run.
    """
    models = models or {"binary": CLASSIFIERS, "multiclass": MULTICLASS, "regression": REGRESSORS}[task]
    order = {"binary": "auc_roc", "multiclass": "f1_weighted", "regression": "r2"}[task]
    folds = grouped_folds(df.filter(F.col(label).isNotNull()), group, k)
    out = []
    for set_name, cols in feature_sets.items():
        rows = store(assemble(folds, cols, label, ["fold"]), set_name)
        for model_name, make in models.items():
            pred = store(cross_predict(rows, make, k), f"{set_name} {model_name}")
            if task == "regression":
                scores = regression_scores(pred)
            else:
                scores = class_scores(pred)
                if task == "binary":
                    scores = scores.crossJoin(roc_auc(pred))  # one row each
            one = scores.first()
            out.append((set_name, model_name, *one, len(cols)))
            names = scores.columns
    fields = "feature_set string, model string, " + "".join(f"{n} double, " for n in names)
    return spark.createDataFrame(out, fields + "n_features int").orderBy(F.desc_nulls_last(order))


def feature_importance(rows: DataFrame, features: Sequence[str], trees: int = TREES, k: int = 20):
    """The k most important features of a forest fitted on all rows."""
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("place") + 1)
    return forest_classifier(0, trees).importances(rows).select(name.alias("feature"), "importance").orderBy(
        F.desc("importance"), "feature"
    ).limit(k)


def best_models(runs: dict[str, tuple[DataFrame, DataFrame, str]]) -> DataFrame:
    """Best row of each task on both scales: {task: (first scale, second scale, score column)}."""
    out = None
    for task, (a, b, score) in runs.items():
        def best(df, prefix):
            row = F.max_by(F.struct("model", "feature_set", score), score)
            return df.agg(row.alias("r")).select(
                F.lit(score).alias(f"{prefix}_metric"), F.col(f"r.{score}").alias(f"{prefix}_value"),
                F.concat_ws(" / ", "r.model", "r.feature_set").alias(f"{prefix}_model"),
            )
        one = best(a, "phq9").crossJoin(best(b, "bdi")).select(F.lit(task).alias("task"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def model_by_set(runs: DataFrame, score: str, sets: Sequence[str]) -> DataFrame:
    """Models down, feature sets across."""
    return runs.groupBy("model").pivot("feature_set", list(sets)).agg(F.max(score))
