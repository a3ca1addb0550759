"""Linear mixed models with a random intercept and slope per user.

The likelihood needs, of each user, only sums of products of the design columns. Those
sums come from one aggregation. After that each Newton step is one aggregation over users, at one
point for every model: value, score vector and information matrix of the restricted likelihood are
functions of the same few hundred sums, which are all the driver sees of a model.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio import model as M
from fixatio.operators import features as X
from fixatio.operators import stats as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring this module along

MIN_ROWS = 30
BOUNDARY = 1e-6
FAN_IN = 256  # partial sums of a model that are added up at once

# --- fixed values: model families ------------------------------------------------
INVARIANT_METRICS = [
    "first_fixation_duration_ms", "mean_fixation_duration_ms", "fixation_rate_per_sec",
    "mean_saccade_amplitude", "saccade_rate_per_sec", "scanpath_length",
    "gaze_transition_entropy", "transition_matrix_density",
]
OUTCOMES = ["dwell_time_ms", "dwell_time_500ms", "fixation_proportion", "revisit_count"]
STRATIFIED_METRICS = M.BIASES + [f"{o}_{v}" for o in OUTCOMES for v in M.VALENCES]
# ---------------------------------------------------------------------------------



@dataclass(frozen=True)
class Design:
    """Fixed terms by name; the random part is the intercept and ``trial``."""

    terms: tuple[str, ...]

    @property
    def slope(self) -> int:
        return self.terms.index("trial")

    def column(self, i: int):
        out = F.lit(1.0)
        for part in self.terms[i].split(":"):
            if part != "1":
                out = out * F.col(part)
        return out


TEMPORAL_DESIGN = Design(("1", "score", "trial", "score:trial"))
VALENCE_DESIGN = Design(("1", "score", "target", "score:target", "trial"))


def temporal_rows(trials: DataFrame, score: str) -> DataFrame:
    """Trials in long form: one model per general metric, and per pair-specific metric and pair."""
    ids = ["uid", "scene_valence_pair", score, "trial_norm"]
    metrics = INVARIANT_METRICS + STRATIFIED_METRICS
    suffix = F.create_map(*[F.lit(v) for p in M.PAIRS for v in (p.name, p.suffix)])
    rows = S.long_form(trials, ids, metrics, "metric", "y")
    return rows.select(
        "metric",
        F.when(
            ~F.col("metric").isin(INVARIANT_METRICS), suffix[F.col("scene_valence_pair")]
        ).alias("pair_suffix"),
        "uid", F.col(score).alias("score"), F.col("trial_norm").alias("trial"), "y",
    )


def reference_and_target(pair: M.Pair) -> tuple[str, str]:
    """Negative is the target where it takes part; otherwise positive against neutral."""
    target = "negative" if "negative" in pair.valences else "positive"
    return next(v for v in pair.valences if v != target), target


def melt_outcomes(trials: DataFrame) -> DataFrame:
    """One row per trial, outcome and valence of its pair, where the outcome is known."""
    cols = [f"{o}_{v}" for o in OUTCOMES for v in M.VALENCES]
    ids = [c for c in trials.columns if c not in cols]
    rows = S.long_form(trials, ids, cols, "_col", "y")
    member = F.lit(False)
    for p in M.PAIRS:
        member = member | (X.in_pair(p) & F.col("valence").isin(*p.valences))
    return (
        rows.withColumn("valence", F.substring_index("_col", "_", -1))
        .withColumn("outcome", F.regexp_replace("_col", "_[a-z]+$", ""))
        .filter(member)
        .drop("_col")
    )


def valence_rows(trials: DataFrame, score: str) -> DataFrame:
    """Long rows for the score by valence models, one model per outcome and pair."""
    suffix = F.create_map(*[F.lit(v) for p in M.PAIRS for v in (p.name, p.suffix)])
    target = F.create_map(
        *[F.lit(v) for p in M.PAIRS for v in (p.name, reference_and_target(p)[1])]
    )
    return melt_outcomes(trials).select(
        "outcome",
        suffix[F.col("scene_valence_pair")].alias("pair_suffix"),
        "uid", F.col(score).alias("score"), F.col("trial_norm").alias("trial"),
        (F.col("valence") == target[F.col("scene_valence_pair")]).cast("double").alias("target"),
        "y",
    )


def user_sums(rows: DataFrame, model: Sequence[str], design: Design) -> DataFrame:
    """Sums of products of the design columns per model and user.

    ``n_outcome`` counts rows before those without a score are left out, which is what
    the minimum size of a model refers to.
    """
    p = len(design.terms)
    known = F.col("score").isNotNull() & F.col("trial").isNotNull() & F.col("uid").isNotNull()
    x = [F.when(known, design.column(i)) for i in range(p)]
    y = F.when(known, F.col("y"))
    aggs = [F.count(F.lit(1)).alias("n_outcome"), F.count(y).alias("n"), F.sum(y * y).alias("yy")]
    aggs += [F.sum(x[i] * y).alias(f"xy_{i}") for i in range(p)]
    aggs += [F.sum(x[i] * x[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    return rows.filter(F.col("y").isNotNull()).groupBy(*model, "uid").agg(*aggs)


def _user_pieces(design: Design, n_params: int, own: np.ndarray, column) -> np.ndarray:
    """Per user, the numbers whose sums give the criterion and its first two derivatives.

    ``own`` are each user's (a, b, c) and ``column`` gives a column of the sums. With
    L = [[a, 0], [b, c]], K = I + L'Z'ZL and W = L K^-1 L', the inverse of a user's covariance
    V = I + Z L L' Z' is I - Z W Z'. Rows hold, one after the other: log|K|; C = [X y]'V^-1[X y];
    tr(E_k M), tr(E_k M E_l M), R_k = w'E_k w and Q_kl = w'E_k M E_l w with M = Z'V^-1 Z and
    w = Z'V^-1[X y], for the three elements E_k of a symmetric matrix.
    """
    p, s = len(design.terms), design.slope
    a, b, c = own.T
    full = np.empty((len(own), p + 1, p + 1))  # [X y]'[X y]
    for i in range(p):
        for j in range(i, p):
            full[:, i, j] = full[:, j, i] = column(f"xx_{i}_{j}")
        full[:, i, p] = full[:, p, i] = column(f"xy_{i}")
    full[:, p, p] = column("yy")
    z = full[:, [0, s], :]  # Z'[X y]
    g = z[:, :, [0, s]]
    lower = np.zeros((len(own), 2, 2))
    lower[:, 0, 0], lower[:, 1, 0], lower[:, 1, 1] = a, b, c
    k = np.eye(2) + lower.transpose(0, 2, 1) @ g @ lower
    det = k[:, 0, 0] * k[:, 1, 1] - k[:, 0, 1] ** 2
    inverse = np.empty_like(k)
    inverse[:, 0, 0], inverse[:, 1, 1] = k[:, 1, 1], k[:, 0, 0]
    inverse[:, 0, 1] = inverse[:, 1, 0] = -k[:, 0, 1]
    weight = lower @ (inverse / det[:, None, None]) @ lower.transpose(0, 2, 1)
    zt = z.transpose(0, 2, 1)
    rest = np.eye(2) - g @ weight
    m, w = rest @ g, rest @ z
    em = [e @ m for e in _ELEMENTS[:n_params]]
    ew = [e @ w for e in _ELEMENTS[:n_params]]
    wt = w.transpose(0, 2, 1)
    out = [np.log(det), (full - zt @ weight @ z).reshape(len(own), -1).T]
    out += [np.trace(x, axis1=1, axis2=2) for x in em]
    out += [np.trace(x @ y, axis1=1, axis2=2) for x in em for y in em]
    out += [(wt @ x).reshape(len(own), -1).T for x in ew]
    out += [(wt @ _ELEMENTS[i] @ m @ ew[j]).reshape(len(own), -1).T for i in range(n_params) for j in range(n_params)]
    return np.vstack([np.atleast_2d(x) for x in out])


#: The elements of a symmetric 2 x 2 matrix: variances of intercept and slope, and their covariance.
_ELEMENTS = np.array([[[1.0, 0.0], [0.0, 0.0]], [[0.0, 1.0], [1.0, 0.0]], [[0.0, 0.0], [0.0, 1.0]]])


def _sum_vectors(parts: DataFrame, n_parts: int, keys: str) -> DataFrame:
    """Add up the packed vectors of each key, a bounded number of them in a task."""
    names = [x.split()[0] for x in keys.split(", ")]

    def add(table: pa.Table) -> pa.Table:
        data = table.sort_by("part").column("sums").to_pylist()
        total = np.sum([np.frombuffer(x, np.float64) for x in data], axis=0)
        return pa.table({
            **{k: table.column(k)[:1] for k in names}, "part": pa.array([table.column("_to")[0].as_py()], pa.int64()),
            "sums": pa.array([total.tobytes()], pa.binary()),
        })

    while True:
        parts = parts.withColumn("_to", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy(*names, "_to").applyInArrow(
            add, f"{keys}, part long, sums binary"
        )
        n_parts = math.ceil(n_parts / FAN_IN)
        if n_parts <= 1:
            return parts


def _evaluate(sums: DataFrame, model: Sequence[str], design: Design, points: dict[tuple, np.ndarray]) -> dict[tuple, dict]:
    """The criterion and its derivatives for each (model, parameters) at its point (a, b, c)."""
    p = len(design.terms)
    names = ["n", "yy", *[f"xy_{i}" for i in range(p)], *[f"xx_{i}_{j}" for i in range(p) for j in range(i, p)]]
    places: dict[tuple, list] = {}
    for at, (key, dim) in enumerate(points):
        places.setdefault(key, []).append((at, dim, points[key, dim]))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = list(zip(*[batch.column(k).to_pylist() for k in model]))
            rows: dict[tuple, list] = {}
            for i, key in enumerate(keys):
                rows.setdefault(key, []).append(i)
            data = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            for key, mine in rows.items():
                for at, dim, point in places.get(key, ()):
                    pieces = _user_pieces(design, dim, np.tile(point, (len(mine), 1)), lambda c: data[c][mine])  # noqa: B023
                    found = np.concatenate([[data["n"][mine].sum(), len(mine)], pieces.sum(1)])
                    total[at] = total[at] + found if at in total else found
        part = TaskContext.get().partitionId()
        for at, found in total.items():
            yield pa.record_batch({
                "at": pa.array([at], pa.int32()), "part": pa.array([part], pa.int64()), "sums": pa.array([found.tobytes()], pa.binary()),
            })

    rows = sums.filter("n > 0").select(*model, *[F.col(c).cast("double").alias(c) for c in names])
    parts = rows.mapInArrow(partial, "at int, part long, sums binary")
    found = _sum_vectors(parts, rows.rdd.getNumPartitions(), "at int").collect()  # one row a model
    order = list(points)
    return {order[r["at"]]: _solve(np.frombuffer(bytes(r["sums"]), np.float64), p, order[r["at"]][1], points[order[r["at"]]]) for r in found}


def _solve(sums: np.ndarray, p: int, dim: int, point: np.ndarray) -> dict:
    """Fixed effects, residual variance, REML criterion, and its gradient and Hessian by (a, b, c)
    or by a alone.

    In the elements v of the covariance the criterion f = (n - p) log r + log|V| + log|A|, with
    r = y'Py, has the derivatives tr(P V_k) - (n - p) d_k / r and
    -tr(P V_k P V_l) + (n - p) (2 c_kl / r - d_k d_l / r^2), where d_k = y'P V_k P y and
    c_kl = y'P V_k P V_l P y.
    """
    n, users, logdet = sums[:3]
    size, at = p + 1, 3
    n_params = 1 if dim == 1 else 3

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        count = math.prod(shape)
        at += count
        return sums[at - count:at].reshape(shape)

    c, m1, m2 = take(size, size), take(n_params), take(n_params, n_params)
    r_k, q_kl = take(n_params, size, size), take(n_params, n_params, size, size)
    a, b = c[:p, :p], c[:p, p]
    try:
        sign, logdet_a = np.linalg.slogdet(a)
        inverse = np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return {"value": math.inf}
    beta = inverse @ b
    r = c[p, p] - beta @ b
    if n <= p or sign <= 0 or r <= 0 or np.linalg.cond(a) > 1e14:
        return {"value": math.inf}
    residual = np.append(-beta, 1.0)
    d = np.array([residual @ x @ residual for x in r_k])
    h = np.array([(x @ residual)[:p] for x in r_k])
    crossed = np.array([[residual @ y @ residual for y in x] for x in q_kl]) - h @ inverse @ h.T
    spread = [inverse @ x[:p, :p] for x in r_k]
    squared = m2 + np.array([[
        -2 * np.sum(inverse * q_kl[k, j][:p, :p]) + np.sum(spread[k] * spread[j].T)
        for j in range(n_params)] for k in range(n_params)])
    grad = m1 - np.array([np.trace(x) for x in spread]) - (n - p) * d / r
    hess = -squared + (n - p) * (2 * crossed / r - np.outer(d, d) / r**2)
    hess = (hess + hess.T) / 2
    # From the elements of L L' to those of L.
    if dim == 1:
        jacobian, bend = np.array([[2 * point[0]]]), np.array([[2 * grad[0]]])
    else:
        x, y, z = point
        jacobian = np.array([[2 * x, 0, 0], [y, x, 0], [0, 2 * y, 2 * z]])
        bend = np.array([[2 * grad[0], grad[1], 0], [grad[1], 2 * grad[2], 0], [0, 0, 2 * grad[2]]])
    s2 = r / (n - p)
    # Where no random part is assumed, the means of d and r tell how large it is.
    share = d / r
    moments = np.linalg.lstsq(m2 - np.outer(share, m1), share * (n - p) - m1, rcond=None)[0]
    return {
        "moments": moments, "value": (n - p) * math.log(s2) + logdet + logdet_a, "grad": jacobian.T @ grad,
        "hess": jacobian.T @ hess @ jacobian + bend, "beta": beta, "se": np.sqrt(s2 * np.diag(inverse)),
        "scale": s2, "n": n, "n_users": users,
    }


@dataclass
class _State:
    """Newton's search for one model's best random part: (a, b, c), or a alone.

    The first evaluation, without a random part, only serves for a start.
    """

    dim: int
    best: np.ndarray
    step: np.ndarray
    reach: float = 1.0  # longest step
    value: float = math.inf
    fit: dict | None = None
    gain: float = math.inf  # decrease that the last step promised
    done: bool = False
    singular: bool = False
    rounds: int = 0

    def point(self) -> np.ndarray:
        return self.best + self.step

    def update(self, found: dict) -> None:
        self.rounds += 1
        noise = 1e-12 * (1 + abs(self.value)) if self.fit else 0.0
        if not math.isfinite(found["value"]) and self.fit is None:
            self.done = self.singular = True
        elif self.rounds == 1:
            v = found["moments"]
            values, vectors = np.linalg.eigh(np.array([[v[0], v[1]], [v[1], v[2]]]) if self.dim == 3 else v[:1, None])
            lower = np.linalg.cholesky(vectors @ np.diag(np.maximum(values, 0.01)) @ vectors.T)
            self.best = lower[np.tril_indices(len(lower))]
        elif found["value"] <= self.value + noise:
            self.best, self.value, self.fit = self.point(), found["value"], found
            values, vectors = np.linalg.eigh(found["hess"])
            # Away from humps: the sign of a curvature does not turn a step uphill.
            step = -vectors @ ((vectors.T @ found["grad"]) / np.maximum(np.abs(values), 1e-8))
            size = np.linalg.norm(step)
            if size > self.reach:
                step *= self.reach / size
                self.reach *= 2
            self.step, self.gain = step, -(found["grad"] @ step) / 2
            self.done = self.gain < max(1e-8, noise)
        else:  # too long
            self.step = self.step / 4
            self.reach = float(np.linalg.norm(self.step))
            self.done = self.reach < 1e-7 or self.gain < 1e-6


def fit(
    spark: SparkSession, sums: DataFrame, model: Sequence[str], design: Design,
    max_rounds: int = 30, random_slope: bool = True,
) -> list[dict]:
    """REML fits of all models in ``sums``, as a list with one entry per model.

    ``sums`` is read once per round, so give it as a stored table. Models whose random
    slope vanishes, or do not converge, are fitted with a random intercept only; both
    searches run side by side. Models of one pair below the minimum size, and models without
    a solution, are left out. ``converged`` says whether the reported search came to its end.
    """
    p = len(design.terms)
    # Only models of one stimulus pair have a minimum size.
    enough = F.col("m") >= MIN_ROWS
    if "pair_suffix" in model:
        enough = enough | F.col("pair_suffix").isNull()
    sizes = sums.groupBy(*model).agg(F.sum("n_outcome").alias("m")).filter(enough)
    ids = sorted((tuple(r[k] for k in model) for r in sizes.collect()), key=str)
    state = {(k, d): _State(d, np.zeros(d), np.zeros(d)) for k in ids for d in ((3, 1) if random_slope else (1,))}
    for _ in range(max_rounds):
        open_ = [key for key, s in state.items() if not s.done]
        if not open_:
            break
        points = {key: np.append(state[key].point(), [0.0, 0.0])[:3] for key in open_}
        found = _evaluate(sums, model, design, points)
        for key in open_:
            state[key].update(found.get(key, {"value": math.inf}))
    out = []
    for k in ids:
        full, single = state.get((k, 3)), state[(k, 1)]
        chosen = None
        if full and full.fit is not None and full.done and not full.singular:
            cov = _covariance(full)
            better = single.fit is None or full.value < single.value - 1e-6
            if better and np.all(np.diag(cov) >= BOUNDARY):
                chosen, structure = full, "intercept+slope"
        if chosen is None and single.fit is not None:
            chosen, structure, cov = single, "intercept_only", _covariance(single)
        if chosen is None:
            continue
        f = chosen.fit
        out.append({
            **dict(zip(model, k)), "terms": design.terms, "beta": f["beta"], "se": f["se"],
            "cov_re": cov, "scale": f["scale"], "n_obs": int(f["n"]), "structure": structure,
            "converged": chosen.done and not chosen.singular, "rounds": chosen.rounds,
        })
    return out


def _covariance(s: _State) -> np.ndarray:
    if s.dim == 1:
        return np.array([[s.fit["scale"] * float(s.best[0]) ** 2]])
    a, b, c = s.best
    lower = np.array([[a, 0.0], [b, c]])
    return s.fit["scale"] * lower @ lower.T


def cohens_d(f: dict, i: int) -> float:
    return f["beta"][i] / math.sqrt(np.trace(f["cov_re"]) + f["scale"])


def icc(f: dict) -> float:
    v = f["cov_re"][0, 0]
    return v / (v + f["scale"])


def p_value(f: dict, i: int) -> float:
    return math.erfc(abs(f["beta"][i] / f["se"][i]) / math.sqrt(2))


def summary(spark: SparkSession, fits: list[dict], model: Sequence[str], names: dict[str, str]):
    """One row per model: estimates and p-values of the named terms, d of all, ICC, structure."""
    rows = []
    for f in fits:
        row = [f[k] for k in model]
        for term in names:
            i = f["terms"].index(term)
            row += [float(f["beta"][i]), float(p_value(f, i)), float(cohens_d(f, i))]
        rows.append((*row, float(icc(f)), f["structure"], f["n_obs"], f["converged"]))
    schema = ", ".join(f"`{k}` string" for k in model)
    for n in names.values():
        schema += f", `{n}_coef` double, `{n}_pval` double, `{n}_d` double"
    return spark.createDataFrame(rows, schema + ", icc double, random_structure string, n_obs long, converged boolean")


def temporal_summary(spark, sums: DataFrame) -> DataFrame:
    """Score by trial-position models with q-values per term."""
    model = ["metric", "pair_suffix"]
    names = {"score": "score", "trial": "trial_norm", "score:trial": "interaction"}
    out = summary(spark, fit(spark, sums, model, TEMPORAL_DESIGN), model, names)
    for n in names.values():
        out = S.benjamini_hochberg(out, f"{n}_pval", f"{n}_pval_fdr")
    return out


def valence_summary(spark, sums: DataFrame) -> DataFrame:
    """Score by valence models with q-values of the interaction."""
    model = ["outcome", "pair_suffix"]
    names = {"score:target": "interaction", "target": "valence_main", "score": "score_main",
             "trial": "trial_norm"}
    out = summary(spark, fit(spark, sums, model, VALENCE_DESIGN), model, names)
    level = {p.suffix: reference_and_target(p) for p in M.PAIRS}
    for i, col in enumerate(("reference", "target")):
        pick = F.create_map(*[F.lit(v) for s, rt in level.items() for v in (s, rt[i])])
        out = out.withColumn(col, pick[F.col("pair_suffix")])
    return S.benjamini_hochberg(out, "interaction_pval", "interaction_pval_fdr")


def significant_counts(summary_rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Metrics ranked by how many of the three terms are significant."""
    n = F.lit(0)
    for c in ("score_pval", "trial_norm_pval", "interaction_pval"):
        n = n + F.coalesce((F.col(c) < alpha).cast("int"), F.lit(0))
    return summary_rows.select("metric", "pair_suffix", n.alias("n_significant"),
                               "interaction_pval").orderBy(F.desc("n_significant"), "metric")


def icc_report(summary_rows: DataFrame) -> DataFrame:
    """Mean and median ICC over the fitted models (one row per model)."""
    return summary_rows.agg(F.avg("icc").alias("mean_icc"), F.median("icc").alias("median_icc"))
