"""Rank correlation, trends, false-discovery control and group summaries."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatio.functions import columns as C
from fixatio.operators import blocks as B
from fixatio.plans.stages import keep


MIN_ROWS = 20  # fixed value: fewer complete pairs give no correlation, unless a caller asks for it


def long_form(
    df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per id and column, missing values left out."""
    as_double = [F.col(c).cast("double").alias(c) for c in cols]
    rows = df.select(*ids, *as_double).unpivot(list(ids), list(cols), name, value)
    return rows.filter(F.col(value).isNotNull())


def _rank_correlation(rows: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Spearman r and n per key: Pearson r of the average ranks."""
    ranked = B.average_ranks(rows, keys, {"_rx": x, "_ry": y})
    return ranked.groupBy(*keys).agg(
        F.try_divide(
            F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")
        ).alias("spearman_r"),
        F.count(F.lit(1)).alias("n"),
    )


def spearman(
    df: DataFrame, metrics: Sequence[str], score: str, min_rows: int = MIN_ROWS
) -> DataFrame:
    """Spearman r, p and n of each metric with a score, over complete pairs."""
    rows = long_form(df.filter(F.col(score).isNotNull()), [score], metrics, "metric", "value")
    out = _rank_correlation(rows, ["metric"], "value", score)
    return with_p_value(out.filter(F.col("n") >= min_rows))


def _gram(rows: DataFrame, vector: str, n: int) -> np.ndarray:
    """Sum over rows of the outer product of an array column with itself (nulls count as 0): a
    matrix per task, summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for batch in batches:
            x = np.asarray(batch.column("v").flatten().fill_null(0.0), np.float64).reshape(-1, n)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "x": pa.array(total[i, j])})

    out = np.zeros((n, n))
    for r in rows.select(F.col(vector).alias("v")).mapInArrow(run, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        out[r.i, r.j] = r.x  # at most n x n numbers
    return out


def spearman_matrix(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Spearman r of every two metrics (a before b), each over the rows that have both.

    Ranks of a metric among the rows that another metric has as well depend on which rows those
    are, not on the other's values. Metrics that are missing in the same rows form a pattern, and a
    metric gets one rank for each pattern. All correlations are then sums of products of ranks: a Gram
    matrix per task, for each two patterns. No row is made for a pair of metrics.
    """
    spark, n = df.sparkSession, len(metrics)
    stored = keep(df.select(*[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(metrics)]).withColumn(
        "_row", F.monotonically_increasing_id()
    ))
    known = [F.col(f"m{i}").isNotNull() for i in range(n)]
    both = _gram(stored.select(F.array(*[k.cast("double") for k in known]).alias("v")), "v", n)
    # Pattern of each metric: that of the first that is known in the same rows.
    pattern, first = [], []
    for i in range(n):
        same = next((p for p, j in enumerate(first) if both[i, j] == both[i, i] == both[j, j]), None)
        pattern.append(len(first) if same is None else same)
        if same is None:
            first.append(i)
    marks = [f"_p{k}" for k in range(len(first))]
    marked = stored.withColumns({m: known[i].cast("long") for m, i in zip(marks, first)})
    rows = marked.unpivot(["_row", *marks], [f"m{i}" for i in range(n)], "metric", "value").filter("value is not null")
    counts = rows.groupBy("metric", "value").agg(*[F.sum(m).alias(m) for m in marks])
    placed = B.cumulate_values(counts, ["metric"], "value", marks)
    # Average ranks less their mean, and their sums of squares.
    rank = [(F.col(f"{m}_before") + (F.col(m) + 1) / 2 - (F.col(f"{m}_total") + 1) / 2) for m in marks]
    ranks = keep(placed.select("metric", "value", F.array(*rank).alias("ranks"), F.array(*marks).alias("n")))
    squares = ranks.groupBy("metric").agg(*[F.sum(F.col("n")[k] * F.col("ranks")[k] ** 2).alias(m) for k, m in enumerate(marks)])
    spread = {int(r["metric"][1:]): [r[m] for m in marks] for r in squares.collect()}  # metrics x patterns
    width = len(marks)
    ranked = rows.select("_row", "metric", "value").join(ranks.select("metric", "value", "ranks"), ["metric", "value"])
    # A row of the table again, with at most one entry a metric.
    wide = ranked.groupBy("_row").agg(F.collect_list(F.struct(F.substring("metric", 2, 9).cast("int").alias("m"), "ranks")).alias("r"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = [[i for i in range(n) if pattern[i] == p] for p in range(width)]
        total = np.zeros((n, n))
        for batch in batches:
            entries = batch.column("r")
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(entries.value_lengths()))
            flat = entries.flatten()
            x = np.zeros((batch.num_rows, n, width))
            x[owner, np.asarray(flat.field("m"))] = np.asarray(flat.field("ranks").flatten(), np.float64).reshape(-1, width)
            has = np.zeros((batch.num_rows, n), bool)
            has[owner, np.asarray(flat.field("m"))] = True
            for p, left in enumerate(groups):
                for q, right in enumerate(groups[p:], p):
                    # Only rows that have both; a pattern is missing as a whole.
                    rows_of = has[:, left[0]] & has[:, right[0]]
                    total[np.ix_(left, right)] += x[np.ix_(rows_of, left)][:, :, q].T @ x[np.ix_(rows_of, right)][:, :, p]
        i, j = np.nonzero(total)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "x": pa.array(total[i, j])})

    found = np.zeros((n, n))
    for r in wide.select("r").mapInArrow(products, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        found[r.i, r.j] = r.x
    out = []
    for i in range(n):
        for j in range(i + 1, n):
            if both[i, j]:
                # Products stand where the pattern that comes first does.
                xy = found[i, j] if pattern[i] <= pattern[j] else found[j, i]
                scale = math.sqrt(spread[i][pattern[j]]) * math.sqrt(spread[j][pattern[i]])
                out.append((metrics[i], metrics[j], float(xy / scale) if scale > 0 else None, int(both[i, j])))
    return spark.createDataFrame(out, "metric_a string, metric_b string, spearman_r double, n long")


def two_sided_t(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(|T| > |t|) for Student's t, as the regularised incomplete beta I_x(dof/2, 1/2)."""
    from math import lgamma

    t, dof = np.broadcast_arrays(np.asarray(t, float), np.asarray(dof, float))
    x = dof / (dof + t * t)
    a, b = dof / 2.0, np.full_like(dof, 0.5)
    # The fraction converges fast for x below (a + 1) / (a + b + 2); use symmetry above.
    swap = x > (a + 1) / (a + b + 2)
    xs, p, q = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    logs = np.array([lgamma(u + v) - lgamma(u) - lgamma(v) for u, v in zip(p.ravel(), q.ravel())])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(logs.reshape(p.shape) + p * np.log(xs) + q * np.log1p(-xs)) / p
        tiny = 1e-300
        c, d = np.ones_like(xs), 1 - (p + q) * xs / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (
                m * (q - m) * xs / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * xs / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
    part = front * h
    return np.clip(np.where(swap, 1 - part, part), 0.0, 1.0)


@F.pandas_udf(T.DoubleType())
def _correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    dof = n - 2.0
    with np.errstate(divide="ignore", invalid="ignore"):
        t = r * np.sqrt(dof / ((1 - r) * (1 + r)))
    p = two_sided_t(t.to_numpy(float), dof.to_numpy(float))
    return pd.Series(np.where(np.abs(r) >= 1, 0.0, p)).where(r.notna().to_numpy())


def with_p_value(correlations: DataFrame) -> DataFrame:
    """Two-sided t test of r = 0; runs on the result rows, one per metric."""
    return correlations.withColumn("p_value", _correlation_p("spearman_r", F.col("n").cast("double")))


def benjamini_hochberg(
    tests: DataFrame, p: str, out: str, keys: Sequence[str] = ()
) -> DataFrame:
    """False-discovery q-values: the least p * m / rank over this and all larger p-values.

    Equal p-values share the last of their ranks, which is the one that decides. Tests
    without a p-value keep a missing q-value and do not count.
    """
    keys = list(keys)
    counts = tests.filter(F.col(p).isNotNull()).groupBy(*keys, F.col(p).alias("_p")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    rows = B.cumulate_values(counts, keys, "_p", ["_n"], keep_block=True).withColumn(
        "_raw", F.col("_p") * F.col("_n_total") / (F.col("_n_before") + F.col("_n"))
    )
    q = B.min_from_here(rows, keys, "_p", "_raw", "_q").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_p", F.least(F.lit(1.0), F.col("_q")).alias(out)
    )
    same = F.col(p) == F.col("_p")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_k_{k}"))
    return tests.join(q, same, "left").drop("_p", *[f"_k_{k}" for k in keys])


def correlation_report(df: DataFrame, metrics: Sequence[str], score: str, min_rows: int = MIN_ROWS):
    """Correlations with q-values, significance and stars, best first."""
    out = benjamini_hochberg(spearman(df, metrics, score, min_rows), "p_value", "q_value")
    return (
        out.withColumn("significant", F.col("q_value") < 0.05)
        .withColumn("stars", C.stars("p_value"))
        .orderBy("q_value", "metric")
    )


def two_scale_comparison(a: DataFrame, b: DataFrame, keys: Sequence[str], cols: Sequence[str],
                         suffixes=("phq", "bdi")) -> DataFrame:
    """Results on two scales side by side; missing key parts match each other."""
    sa, sb = suffixes
    left = a.select(*keys, *[F.col(c).alias(f"{c}_{sa}") for c in cols]).alias("l")
    right = b.select(*keys, *[F.col(c).alias(f"{c}_{sb}") for c in cols]).alias("r")
    return left.join(right, B.null_safe("l", "r", keys)).select(
        *[F.col(f"l.{k}") for k in keys],
        *[F.col(f"l.{c}_{sa}") for c in cols],
        *[F.col(f"r.{c}_{sb}") for c in cols],
    )


def concordance(pairs: DataFrame, first: str, second: str, alpha: float = 0.05) -> DataFrame:
    """How many tests are significant on both scales, on one, on none."""
    a = F.coalesce(F.col(first) < alpha, F.lit(False))
    b = F.coalesce(F.col(second) < alpha, F.lit(False))

    def n(cond):
        return F.sum(cond.cast("long"))

    return pairs.agg(
        n(a & b).alias("both"), n(a & ~b).alias("phq_only"), n(~a & b).alias("bdi_only"),
        n(~a & ~b).alias("neither"), F.count(F.lit(1)).alias("n_tests"),
    )


def linear_trend(df: DataFrame, metrics: Sequence[str], score: str) -> DataFrame:
    """Least-squares line of each metric over a score."""
    rows = long_form(df.filter(F.col(score).isNotNull()), [score], metrics, "metric", "value")
    x = F.col(score).cast("double")
    return rows.groupBy("metric").agg(
        F.regr_slope(F.col("value"), x).alias("slope"),
        F.regr_intercept(F.col("value"), x).alias("intercept"),
        F.min(x).alias("score_min"),
        F.max(x).alias("score_max"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_sem(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and its standard error per group."""
    return rows.groupBy(*keys).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.count(value).alias("n"),
    )


def trajectories(
    trials: DataFrame, metrics: Sequence[str], group: str = "score_group", n_bins: int = 10,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Mean and error of each metric over equal-width bins of trial number, per score group (of the
    same keys).

    Bins are closed on the right and span each group's own range.
    """
    by = [*keys, group]
    span = trials.groupBy(*by).agg(
        F.min("trial_num").alias("_lo"), F.max("trial_num").alias("_hi")
    )
    width = F.col("_hi") - F.col("_lo")
    at = F.ceil((F.col("trial_num") - F.col("_lo")) * n_bins / width) - 1
    # One row per group: two, for each of the keys.
    binned = trials.join(span if keys else F.broadcast(span), by).withColumn(
        "trial_bin",
        F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(n_bins - 1), at)))
        .otherwise((n_bins - 1) // 2).cast("int"),
    )
    rows = long_form(binned, [*by, "trial_bin"], metrics, "metric", "y")
    return mean_sem(rows, [*by, "trial_bin", "metric"], "y")


def gaze_density(
    samples: DataFrame, keys: Sequence[str], grid: int = 20, x: str = "rx", y: str = "ry"
) -> DataFrame:
    """Share of gaze samples per cell of a screen grid; points off the screen's margin are
    left out, those inside it but beyond the edge count for the edge cell."""
    seen = samples.filter(C.in_view(x, y))

    def cell(c):
        return F.least(F.floor(C.clip(c, 0, 1) * grid), F.lit(grid - 1)).cast("int")

    cells = seen.groupBy(*keys, cell(x).alias("cell_x"), cell(y).alias("cell_y")).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = cells.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return cells.join(totals, list(keys)).withColumn("share", F.col("n") / F.col("_t")).drop("_t")


KERNEL_REACH = 6.0  # deviations; what is left out is below 2e-8 of the peak


def kernel_density(
    samples: DataFrame, keys: Sequence[str], grid: int = 200, factor: float = 0.05, bins: int = 32,
    least: int = 11, x: str = "rx", y: str = "ry",
) -> DataFrame:
    """Gaussian kernel density of gaze samples at the nodes of a grid over the screen.

    Returns (keys, node_x, node_y, density) where the density is not negligible. The kernel is the
    covariance of a key's samples times ``factor`` squared. Samples are counted in ``bins`` to a
    deviation of the kernel, along x and along y - beta x, in which it has no correlation. So it
    splits into one smoothing along x, to the columns of the grid, and one along y, to its rows: work
    is bounded by bins and nodes, not by samples, and every count is summed where it is made. A bin
    stands at the mean of its points, so what it loses is of second order: below 1/(12 bins^2). Points
    off the screen's margin are left out; keys of fewer than ``least`` points, or whose points lie
    on a line, have no density.
    """
    keys = list(keys)
    seen = samples.filter(C.in_view(x, y)).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    shape = seen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_size"), F.var_samp("_x").alias("_xx"), F.covar_samp("_x", "_y").alias("_xy"), F.var_samp("_y").alias("_yy")
    ).filter((F.col("_size") >= least) & (F.col("_xx") > 1e-12)).select(
        *keys, "_size", (F.col("_xy") / F.col("_xx")).alias("_beta"), (factor * F.sqrt("_xx")).alias("_sx"),
        (F.col("_yy") - F.col("_xy") * F.col("_xy") / F.col("_xx")).alias("_rest"),
    ).filter("_rest > 1e-12").withColumn("_sy", factor * F.sqrt("_rest")).drop("_rest")
    shape = keep(shape)

    def nodes(at: Column, reach: Column) -> Column:
        first, last = F.ceil((at - reach) * (grid - 1)), F.floor((at + reach) * (grid - 1))
        first, last = F.greatest(first, F.lit(0)), F.least(last, F.lit(grid - 1))
        return F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))

    def bell(z: Column) -> Column:
        return F.exp(-z * z / 2)

    scaled, step = ["_size", "_beta", "_sx", "_sy"], float(grid - 1)
    cells = (
        B.join_blocks(seen, shape, keys).withColumn("_r", F.col("_y") - F.col("_beta") * F.col("_x"))
        .groupBy(*keys, *scaled, F.floor(F.col("_x") / F.col("_sx") * bins).alias("_i"), F.floor(F.col("_r") / F.col("_sy") * bins).alias("_j"))
        .agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_x"), F.avg("_r").alias("_r"))
    )
    weight = F.col("_n") * bell((F.col("node_x") / F.lit(step) - F.col("_x")) / F.col("_sx"))
    across = (
        cells.withColumn("node_x", nodes(F.col("_x"), KERNEL_REACH * F.col("_sx")))
        .groupBy(*keys, *scaled, "_j", "node_x").agg(F.sum(weight).alias("_w"), F.sum(weight * F.col("_r")).alias("_wr"))
        .withColumn("_c", F.col("_wr") / F.col("_w") + F.col("_beta") * F.col("node_x") / F.lit(step))
    )
    return (
        across.withColumn("node_y", nodes(F.col("_c"), KERNEL_REACH * F.col("_sy")))
        .groupBy(*keys, *scaled, "node_x", "node_y")
        .agg(F.sum(F.col("_w") * bell((F.col("node_y") / F.lit(step) - F.col("_c")) / F.col("_sy"))).alias("_s"))
        .select(*keys, F.col("node_x").cast("int"), F.col("node_y").cast("int"),
                (F.col("_s") / (F.col("_size") * (2 * math.pi) * F.col("_sx") * F.col("_sy"))).alias("density"))
    )


def density_levels(density: DataFrame, keys: Sequence[str], levels: int = 20, grid: int = 200) -> DataFrame:
    """Filled contours as numbers: per key and level (of the peak's height, in ``levels`` equal
    steps) how many nodes reach it and what share of the screen's density lies on them."""
    keys = list(keys)
    peak = density.groupBy(*keys).agg(F.max("density").alias("peak"))
    level = F.least(F.floor(F.col("density") / F.col("peak") * levels + 1e-9), F.lit(levels - 1)).cast("int")
    bands = B.join_blocks(density, peak, keys).groupBy(*keys, "peak", level.alias("level")).agg(
        F.count(F.lit(1)).alias("nodes"), (F.sum("density") / float((grid - 1) ** 2)).alias("mass")
    )
    return bands.select(*keys, "level", "nodes", "mass", "peak")


def group_distribution(
    df: DataFrame, metrics: Sequence[str], group: str, probs: dict[str, float]
) -> DataFrame:
    """Exact quantiles of each metric per group, for box and violin displays."""
    rows = long_form(df.filter(F.col(group).isNotNull()), [group], metrics, "metric", "value")
    return B.exact_quantiles(rows, [group, "metric"], "value", probs)
