"""Session and user features from clean trials."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixatio import model as M
from fixatio.operators import blocks as B

# --- fixed values: feature names are read by name downstream -----------------
STATIC_NAMES = {
    "fixation_count": "avg_fixation_count",
    "mean_fixation_duration_ms": "avg_fixation_duration_ms",
    "total_fixation_duration_ms": "avg_total_fixation_duration_ms",
    "fixation_rate_per_sec": "avg_fixation_rate",
    "scanpath_length": "avg_scanpath_length",
    "saccade_count": "avg_saccade_count",
    "saccade_rate_per_sec": "avg_saccade_rate",
    "mean_saccade_amplitude": "avg_saccade_amplitude",
    "blink_count": "avg_blink_count",
    "blink_rate_per_min": "avg_blink_rate",
    "gaze_transition_entropy": "avg_gaze_entropy",
    "first_fixation_duration_ms": "avg_first_fixation_duration_ms",
}
GENERAL_METRICS = [
    "fixation_count", "mean_fixation_duration_ms", "total_fixation_duration_ms",
    "fixation_rate_per_sec", "scanpath_length", "saccade_count", "saccade_rate_per_sec",
    "mean_saccade_amplitude", "blink_count", "blink_rate_per_min", "gaze_transition_entropy",
    "transition_matrix_density", "first_fixation_duration_ms",
]
VALENCE_METRICS = {
    "dwell": "dwell_time_ms",
    "fix_prop": "fixation_proportion",
    "revisit": "revisit_count",
    "dwell_500ms": "dwell_time_500ms",
    "ttff": "ttff_ms",
}
TLBS_PARAMS = [
    "mean_pos", "mean_neg", "peak_pos", "peak_neg", "mean_abs", "variability", "slope",
]
THEORY_STATIC = [
    "avg_bias_neg_vs_pos", "avg_bias_neg_vs_neu", "avg_bias_pos_vs_neu",
    "avg_dwell_neg__neg_vs_pos", "avg_fix_prop_neg__neg_vs_pos", "avg_dwell_pos__pos_vs_neu",
    "avg_fix_prop_pos__pos_vs_neu", "avg_revisit_neg__neg_vs_pos", "avg_revisit_neg__neg_vs_neu",
    "first_fix_prob_neg__neg_vs_pos", "first_fix_prob_pos__pos_vs_neu", "avg_scanpath_length",
    "avg_gaze_entropy",
]
THEORY_SERIES = [
    "scanpath_length", "gaze_transition_entropy",
    "bias_neg_vs_pos", "bias_neg_vs_neu", "bias_pos_vs_neu",
    "dwell_neg__neg_vs_pos", "fix_prop_neg__neg_vs_pos", "dwell_pos__pos_vs_neu",
    "fix_prop_pos__pos_vs_neu", "revisit_neg__neg_vs_pos", "revisit_neg__neg_vs_neu",
]
THEORY_FIRST_FIX = ["first_fix_prob_neg__neg_vs_pos", "first_fix_prob_pos__pos_vs_neu"]
# -----------------------------------------------------------------------------


@dataclass
class FeatureSet:
    """Aggregates, columns derived from them (both as SQL expressions), and names by family."""

    aggregates: list[str] = field(default_factory=list)
    derived: list[str] = field(default_factory=list)
    families: dict[str, list[str]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return [c for names in self.families.values() for c in names]

    def add(self, family: str, name: str, expr: str) -> None:
        self.aggregates.append(f"{expr} as {name}")
        self.families.setdefault(family, []).append(name)

    def derive(self, family: str, name: str, expr: str) -> None:
        self.derived.append(f"{expr} as {name}")
        self.families.setdefault(family, []).append(name)

    def apply(self, trials: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
        """One partial-aggregated pass over the trials."""
        out = trials.groupBy(*keys).agg(*[F.expr(e) for e in self.aggregates])
        if self.derived:
            out = out.selectExpr("*", *self.derived)
        return out.select(*keys, *self.columns)


def in_pair(pair: M.Pair) -> Column:
    return F.col("scene_valence_pair") == pair.name


def mean_where(value: str, *conditions: str) -> str:
    """SQL mean of a value over the rows that meet all conditions, missing values left out."""
    kept = " and ".join(c for c in conditions if c)
    return f"avg(case when {kept} then {value} end)" if kept else f"avg({value})"


def _pair_is(pair: M.Pair) -> str:
    return f"scene_valence_pair = '{pair.name}'"


def _valence_series(prefixes: dict[str, str]):
    """(name, scene column, condition) of every per-valence series, by metric, pair, valence."""
    for prefix, metric in prefixes.items():
        for pair in M.PAIRS:
            for v in pair.valences:
                name = f"{prefix}_{M.VALENCE_SHORT[v]}__{pair.suffix}"
                yield name, f"{metric}_{v}", _pair_is(pair)


def _first_fix_series():
    for pair in M.PAIRS:
        for v in pair.valences:
            hit = f"cast(first_fixation_valence = '{v}' as double)"
            yield f"first_fix_prob_{M.VALENCE_SHORT[v]}__{pair.suffix}", hit, _pair_is(pair)


def static_features() -> FeatureSet:
    """Means over the session: 57 columns."""
    out = FeatureSet()
    for metric, name in STATIC_NAMES.items():
        out.add("simple", name, mean_where(metric))
    for pair in M.PAIRS:
        out.add("bias", f"avg_{pair.bias}", mean_where(pair.bias, _pair_is(pair)))
    series = {p: m for p, m in VALENCE_METRICS.items() if p != "ttff"}
    for name, metric, cond in _valence_series(series):
        out.add("pair_split", f"avg_{name}", mean_where(metric, cond))
    for name, metric, cond in _valence_series({"ttff": "ttff_ms"}):
        missed = f"cast({metric} is null as double)"
        out.add("ttff", f"avg_{name}", mean_where(metric, cond))
        out.add("ttff", name.replace("ttff_", "ttff_miss_rate_", 1), mean_where(missed, cond))
    for name, hit, cond in _first_fix_series():
        out.add("first_fix", name, mean_where(hit, cond))
    return out


def _all_series():
    """(family, name, value, condition) of every distribution series."""
    for metric in GENERAL_METRICS:
        yield "simple", metric, metric, ""
    for pair in M.PAIRS:
        yield "bias", pair.bias, pair.bias, _pair_is(pair)
    for name, metric, cond in _valence_series(VALENCE_METRICS):
        yield "pair_split", name, metric, cond


def distributional_features() -> FeatureSet:
    """Quartiles and their range over the session: 190 columns.

    One sketch per series gives its three quartiles.
    """
    out = FeatureSet()
    for family, name, value, cond in _all_series():
        v = f"case when {cond} then {value} end" if cond else value
        q = f"_q_{name}"
        out.aggregates.append(f"percentile_approx({v}, array(0.25, 0.5, 0.75)) as {q}")
        for i, label in enumerate(("q25", "q50", "q75")):
            out.derive(family, f"{name}_{label}", f"{q}[{i}]")
        out.derive(family, f"{name}_iqr", f"{q}[2] - {q}[0]")
    for name, hit, cond in _first_fix_series():
        out.add("first_fix", name, mean_where(hit, cond))
    return out


def temporal_features() -> FeatureSet:
    """Early and late means and their difference: 156 columns; needs ``is_early``."""
    out = FeatureSet()
    series = [*_all_series()]
    series += [("first_fix", *s) for s in _first_fix_series()]
    for family, name, value, cond in series:
        for part, when in (("early", "is_early"), ("late", "not is_early")):
            out.add(family, f"{name}_{part}", mean_where(value, when, cond))
        out.derive(family, f"{name}_delta", f"{name}_late - {name}_early")
    return out


def tlbs_names(suffixes: Sequence[str] | None = None) -> list[str]:
    suffixes = suffixes or [p.suffix for p in M.PAIRS]
    return [f"tlbs_{p}__{s}" for s in suffixes for p in TLBS_PARAMS]


def tlbs_features(trials: DataFrame, block_scenes: int = 1 << 16) -> DataFrame:
    """Seven parameters of each session's trial-bias series per pair; 21 columns.

    A series shorter than 3 gives NULLs; every session keeps its row.
    """
    bias = F.coalesce(*[F.when(in_pair(p), F.col(p.bias)) for p in M.PAIRS])
    key = ["session_id", "scene_valence_pair"]
    series = trials.select(*key, "scene_index", bias.alias("bias")).filter("bias is not null")
    steps = B.with_previous(
        series, key, ["scene_index"], B.block("scene_index", block_scenes), {"prev": "bias"}
    )
    b = F.col("bias")
    params = {
        "mean_pos": F.coalesce(F.avg(F.when(b > 0, b)), F.lit(0.0)),
        "mean_neg": F.coalesce(F.avg(F.when(b < 0, b)), F.lit(0.0)),
        "peak_pos": F.max(b),
        "peak_neg": F.min(b),
        "mean_abs": F.avg(F.abs(b)),
        "variability": F.avg(F.abs(b - F.col("prev"))),
        "slope": F.regr_slope(b, F.col("scene_index").cast("double")),
    }
    per_pair = steps.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), *[e.alias(p) for p, e in params.items()]
    )
    wide = per_pair.groupBy("session_id").agg(
        *[
            F.max(F.when(in_pair(pair) & (F.col("n") >= 3), F.col(p))).alias(
                f"tlbs_{p}__{pair.suffix}"
            )
            for pair in M.PAIRS
            for p in TLBS_PARAMS
        ]
    )
    return trials.select("session_id").distinct().join(wide, "session_id", "left")


def user_means(sessions: DataFrame, cols: Sequence[str], user: str = "uid") -> DataFrame:
    """Mean of every column over a user's sessions, leaving missing values out.

    Sessions without a user belong to nobody and are left out.
    """
    return sessions.filter(F.col(user).isNotNull()).groupBy(user).agg(*[F.avg(c).alias(c) for c in cols])


def missingness(df: DataFrame, cols: Sequence[str], only_missing: bool = True) -> DataFrame:
    """Missing values per feature, most first, and rows with any missing value."""
    gaps = [F.col(c).isNull() for c in cols]
    any_gap = gaps[0]
    for g in gaps[1:]:
        any_gap = any_gap | g
    one = df.agg(
        *[F.sum(g.cast("long")).alias(c) for c, g in zip(cols, gaps)],
        F.sum(any_gap.cast("long")).alias("_any"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return (
        one.unpivot(["_any", "n_rows"], list(cols), "feature", "n_missing")
        .withColumnRenamed("_any", "rows_with_any")
        .filter(F.col("n_missing") >= int(only_missing))
        .orderBy(F.desc("n_missing"), "feature")
    )


def _suffixed(names: Sequence[str], suffixes: Sequence[str]) -> list[str]:
    return [f"{n}_{s}" for n in names for s in suffixes]


def feature_sets(family: str) -> dict[str, list[str]]:
    """Named column lists used by the learners."""
    if family == "static":
        return {"All Features": static_features().columns, "Theory-Driven": THEORY_STATIC}
    if family == "distributional":
        every = distributional_features()
        theory = _suffixed(THEORY_SERIES, ("q25", "q50", "q75", "iqr")) + THEORY_FIRST_FIX
        middle = [c for c in every.columns if c.endswith("_q50")] + every.families["first_fix"]
        return {
            "All distributional": every.columns,
            "Theory-driven distributional": theory,
            "Median only": middle,
        }
    if family == "temporal":
        every = temporal_features().columns
        return {
            "All temporal": every,
            "Theory-driven temporal": _suffixed(
                THEORY_SERIES + THEORY_FIRST_FIX, ("early", "late", "delta")
            ),
            "Delta only": [c for c in every if c.endswith("_delta")],
        }
    if family == "tlbs":
        static = static_features().columns
        return {
            "TL-BS single pair (neg_vs_pos)": tlbs_names(["neg_vs_pos"]),
            "TL-BS three-pair": tlbs_names(),
            "Traditional static": static,
            "Combined": static + tlbs_names(),
        }
    raise ValueError(f"unknown feature family {family}")


def first_signals(
    trials: DataFrame, forms: DataFrame, per_band: int = 5, pair: M.Pair = M.PAIRS[0]
) -> DataFrame:
    """Trial-bias series of the first sessions of each coarse severity band."""
    from fixatio.functions import columns as C
    from fixatio.operators import prepare as P

    rows = P.join_forms(trials.filter(in_pair(pair)), forms, ["phq9_score"]).withColumn(
        "band", C.three_bands("phq9_score")
    ).filter("band is not null")
    chosen = P.first_per_group(
        rows.select("band", "session_id").distinct(), ["band"], ["session_id"], per_band
    )
    return rows.join(chosen.select("session_id"), "session_id", "left_semi").select(
        "band", "session_id", "scene_index", F.col(pair.bias).alias("bias")
    )


