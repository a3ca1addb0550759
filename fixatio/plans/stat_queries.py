"""Correlations, trends, group summaries, mixed models."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatio import model as M
from fixatio.operators import features as X
from fixatio.operators import mixed as L
from fixatio.operators import prepare as P
from fixatio.operators import stats as S
from fixatio.plans import inputs as I
from fixatio.plans.feature_queries import STATIC_CTE, TLBS_CTE, clean, static_sql, user_table
from fixatio.plans.registry import register
from fixatio.plans.stages import stage

OVERVIEW = [
    "fixation_count", "mean_fixation_duration_ms", "total_fixation_duration_ms",
    "fixation_rate_per_sec", "first_fixation_duration_ms", "scanpath_length", "saccade_count",
    "saccade_rate_per_sec", "mean_saccade_amplitude", "blink_count", "blink_rate_per_min",
    "transition_matrix_density", "gaze_transition_entropy",
    *[f"{m}_{v}" for m in ("dwell_time_ms", "dwell_time_500ms", "fixation_proportion",
                           "fixation_count", "revisit_count", "ttff_ms") for v in M.VALENCES],
]


def _spearman_sql(source: str, metrics, score: str, minimum: int = 0) -> str:
    long = " union all ".join(
        f"select '{m}' as metric, round({m}::double, 9) as x, {score}::double as y from {source} "
        f"where {m} is not null and {score} is not null" for m in metrics
    )
    return f"""
select metric, case when not isnan(r) then r end as spearman_r, n from (
  select metric, corr(rx, ry) as r, count(*) as n from (
    select metric, rank() over (partition by metric order by x)
        + (count(*) over (partition by metric, x) - 1) / 2.0 as rx,
      rank() over (partition by metric order by y)
        + (count(*) over (partition by metric, y) - 1) / 2.0 as ry
    from ({long})) group by metric){f" where n >= {minimum}" if minimum else ""}"""


def steady(df, cols):
    """Means rounded past their noise, so that equal ones tie whatever their summation order."""
    named = {c: F.round(F.col(c).cast("double"), 9) for c in cols}
    return df.withColumns(named)


def session_scores(spark, d):
    """Stored table of static session features with the scores of the session."""
    f = X.static_features()
    return stage(
        spark, d, "session_scores",
        lambda: steady(P.join_forms(f.apply(clean(spark, d)), I.forms(spark, d),
                                    ["uid", *P.SCORES, "bdi_severity"]), f.columns),
    )


@register(
    "static_correlations",
    _spearman_sql("(select * from static_f join forms using (session_id))", list(static_sql()), "bdi_score"),
    others=["metric", "n"], nums=["spearman_r"], extra=STATIC_CTE,
)
def static_correlations(spark, d):
    """Of every metric that any scored session has, however few."""
    f = X.static_features()
    return S.spearman(session_scores(spark, d), f.columns, "bdi_score", min_rows=0).drop("p_value")


@register("static_correlation_report")
def static_correlation_report(spark, d):
    """With p-values, q-values and stars, for both scales side by side."""
    f, rows = X.static_features(), session_scores(spark, d)
    phq, bdi = (S.correlation_report(rows, f.columns, s) for s in P.SCORES)
    return S.two_scale_comparison(phq, bdi, ["metric"], ["spearman_r", "p_value", "q_value"])


@register(
    "trial_correlations",
    _spearman_sql("(select * from clean join forms using (session_id))", OVERVIEW, "phq9_score", S.MIN_ROWS),
    others=["metric", "n"], nums=["spearman_r"],
)
def trial_correlations(spark, d):
    rows = steady(P.join_forms(clean(spark, d), I.forms(spark, d)), OVERVIEW)
    return S.spearman(rows, OVERVIEW, "phq9_score").drop("p_value")


@register(
    "tlbs_correlations",
    _spearman_sql("(select u.*, bdi_score from (select uid, "
                  + ", ".join(f"coalesce(avg({c}), 0) as {c}" for c in X.tlbs_names())
                  + ", avg(bdi_score) as bdi_score from tlbs_f join forms using (session_id) "
                  "group by uid) u)", X.tlbs_names(), "bdi_score"),
    others=["metric", "n"], nums=["spearman_r"], extra=TLBS_CTE,
)
def tlbs_correlations(spark, d):
    """Over all users with a score, however few."""
    rows = stage(spark, d, "user_tlbs", lambda: steady(
        user_table(spark, d, "tlbs").fillna(0, X.tlbs_names()), X.tlbs_names()))
    return S.spearman(rows, X.tlbs_names(), "bdi_score", min_rows=0).drop("p_value")


_PAIRS = [(a, b) for i, a in enumerate(OVERVIEW) for b in OVERVIEW[i + 1:]]


@register(
    "spearman_matrix",
    "select metric_a, metric_b, case when not isnan(r) then r end as spearman_r, n from ("
    "select metric_a, metric_b, corr(rx, ry) as r, count(*) as n from ("
    "select metric_a, metric_b, rank() over (partition by metric_a, metric_b order by x) + "
    "(count(*) over (partition by metric_a, metric_b, x) - 1) / 2.0 as rx, "
    "rank() over (partition by metric_a, metric_b order by y) + "
    "(count(*) over (partition by metric_a, metric_b, y) - 1) / 2.0 as ry from ("
    "select p.a as metric_a, p.b as metric_b, p.x, p.y from (select unnest(["
    + ", ".join(
        f"{{'a': '{a}', 'b': '{b}', 'x': round({a}, 9), 'y': round({b}, 9)}}" for a, b in _PAIRS)
    + "]) as p from stimuli_rows)) where x is not null and y is not null) "
    "group by metric_a, metric_b)",
    others=["metric_a", "metric_b", "n"], nums=["spearman_r"],
    extra={"stimuli_rows": "select * from scene where scene_type = 'stimulus'"},
)
def spearman_matrix(spark, d):
    rows = I.scenes(spark, d).filter(F.col("scene_type") == "stimulus")
    return S.spearman_matrix(steady(rows, OVERVIEW), OVERVIEW)


@register(
    "order_value_rank_correlation",
    """
select o_orderpriority, corr(rx, ry) as spearman_r, count(*) as n from (
  select o_orderpriority, rank() over (partition by o_orderpriority order by o_totalprice)
      + (count(*) over (partition by o_orderpriority, o_totalprice) - 1) / 2.0 as rx,
    rank() over (partition by o_orderpriority order by c_acctbal)
      + (count(*) over (partition by o_orderpriority, c_acctbal) - 1) / 2.0 as ry
  from orders join customer on c_custkey = o_custkey) group by o_orderpriority""",
    others=["o_orderpriority", "n"], nums=["spearman_r"],
)
def order_value_rank_correlation(spark, d):
    """Average ranks on tables with many rows per key."""
    o, c = I.table(spark, d, "orders"), I.table(spark, d, "customer")
    rows = o.join(c, F.col("c_custkey") == F.col("o_custkey")).select(
        "o_orderpriority", "o_totalprice", "c_acctbal"
    )
    return S._rank_correlation(rows, ["o_orderpriority"], "o_totalprice", "c_acctbal")


@register(
    "linear_trends",
    "select metric, regr_slope(v, s) as slope, regr_intercept(v, s) as intercept, min(s) as "
    "score_min, max(s) as score_max, count(*) as n from ("
    + " union all ".join(
        f"select '{c}' as metric, {c} as v, bdi_score::double as s from static_f join forms using "
        f"(session_id) where {c} is not null" for c in static_sql())
    + ") group by metric",
    others=["metric", "n"], nums=["slope", "intercept", "score_min", "score_max"],
    extra=STATIC_CTE,
)
def linear_trends(spark, d):
    return S.linear_trend(session_scores(spark, d), X.static_features().columns, "bdi_score")


Z = {"zrows": """
select *, (phq9_score - avg(phq9_score) over ()) / stddev_samp(phq9_score) over () as phq9_z,
  (bdi_score - avg(bdi_score) over ()) / stddev_samp(bdi_score) over () as bdi_z
from (select *, case when hi > lo then (trial_num - lo) / (hi - lo)::double else 0 end as trial_norm
  from (select *, min(trial_num) over (partition by session_id) as lo,
          max(trial_num) over (partition by session_id) as hi
        from (select *, row_number() over (partition by session_id order by scene_index)
                as trial_num from clean))) join forms using (session_id)"""}


def gaze_trials(spark, d):
    """Stored table of clean trials with position and standard scores."""
    return stage(
        spark, d, "trials",
        lambda: P.mixed_model_trials(I.scenes(spark, d), I.forms(spark, d)),
    )


@register(
    "standard_scores", "select * from zrows",
    others=["session_id", "scene_index", "uid", "trial_num"],
    nums=["trial_norm", "phq9_z", "bdi_z"], extra=Z,
)
def standard_scores(spark, d):
    return gaze_trials(spark, d).select(
        "session_id", "scene_index", "uid", "trial_num", "trial_norm", "phq9_z", "bdi_z"
    )


SPLIT = {"halves": """
select *, case when phq9_score < m then 'Low' when phq9_score >= m then 'High' end as score_group
from zrows cross join (select median(phq9_score) as m from zrows)"""}


@register(
    "trajectories",
    "select score_group, trial_bin, metric, avg(y) as mean, "
    "stddev_samp(y) / sqrt(count(y)) as sem, count(y) as n from ("
    + " union all ".join(
        f"select score_group, trial_bin, '{m}' as metric, {m} as y from binned where {m} is not null"
        for m in L.INVARIANT_METRICS)
    + ") where score_group is not null group by all",
    others=["score_group", "trial_bin", "metric", "n"], nums=["mean", "sem"],
    extra={**Z, **SPLIT, "binned": """
select *, cast(case when ghi > glo then greatest(0, least(9, ceil((trial_num - glo) * 10
    / (ghi - glo)::double) - 1)) else 4 end as int) as trial_bin
from (select *, min(trial_num) over (partition by score_group) as glo,
        max(trial_num) over (partition by score_group) as ghi from halves)"""},
)
def trajectories(spark, d):
    rows = P.median_split(gaze_trials(spark, d), "phq9_score")
    return S.trajectories(rows, L.INVARIANT_METRICS)


@register(
    "pair_trajectories",
    "select pair_suffix, score_group, trial_bin, metric, avg(y) as mean, "
    "stddev_samp(y) / sqrt(count(y)) as sem, count(y) as n from ("
    + " union all ".join(
        f"select '{p.suffix}' as pair_suffix, score_group, trial_bin, '{m}' as metric, {m} as y from pair_binned "
        f"where scene_valence_pair = '{p.name}' and {m} is not null"
        for p in M.PAIRS for m in L.STRATIFIED_METRICS)
    + ") where score_group is not null group by all",
    others=["pair_suffix", "score_group", "trial_bin", "metric", "n"], nums=["mean", "sem"],
    extra={**Z, "pair_halves": """
select *, case when phq9_score < m then 'Low' when phq9_score >= m then 'High' end as score_group
from zrows join (select scene_valence_pair, median(phq9_score) as m from zrows group by 1) using (scene_valence_pair)""",
           "pair_binned": """
select *, cast(case when ghi > glo then greatest(0, least(9, ceil((trial_num - glo) * 10
    / (ghi - glo)::double) - 1)) else 4 end as int) as trial_bin
from (select *, min(trial_num) over (partition by scene_valence_pair, score_group) as glo,
        max(trial_num) over (partition by scene_valence_pair, score_group) as ghi from pair_halves)"""},
)
def pair_trajectories(spark, d):
    """Pair-specific metrics over trial bins; each pair is split at the median of its own trials."""
    suffix = F.create_map(*[F.lit(v) for p in M.PAIRS for v in (p.name, p.suffix)])
    rows = gaze_trials(spark, d).withColumn("pair_suffix", suffix[F.col("scene_valence_pair")]).filter("pair_suffix is not null")
    rows = P.median_split(rows, "phq9_score", keys=["pair_suffix"])
    return S.trajectories(rows, L.STRATIFIED_METRICS, keys=["pair_suffix"])


@register(
    "valence_by_group",
    "select outcome, pair_suffix, score_group, valence, avg(y) as mean, "
    "stddev_samp(y) / sqrt(count(y)) as sem, count(y) as n from ("
    + " union all ".join(
        f"select '{o}' as outcome, '{p.suffix}' as pair_suffix, '{v}' as valence, {o}_{v} as y, "
        f"case when phq9_score < m then 'Low' when phq9_score >= m then 'High' end as score_group "
        f"from zrows cross join (select median(phq9_score) as m from ("
        + " union all ".join(
            f"select phq9_score from zrows where scene_valence_pair = '{p.name}' and {o}_{w} is not null"
            for w in p.valences)
        + f")) where scene_valence_pair = '{p.name}' and {o}_{v} is not null"
        for o in L.OUTCOMES for p in M.PAIRS for v in p.valences)
    + ") where score_group is not null group by all",
    others=["outcome", "pair_suffix", "score_group", "valence", "n"], nums=["mean", "sem"],
    extra=Z,
)
def valence_by_group(spark, d):
    """Each outcome and pair is split at the median of its own rows."""
    suffix = F.create_map(*[F.lit(v) for p in M.PAIRS for v in (p.name, p.suffix)])
    long = L.melt_outcomes(gaze_trials(spark, d)).filter("y is not null")
    long = P.median_split(long, "phq9_score", keys=["outcome", "scene_valence_pair"])
    long = long.filter("score_group is not null").withColumn(
        "pair_suffix", suffix[F.col("scene_valence_pair")]
    )
    return S.mean_sem(long, ["outcome", "pair_suffix", "score_group", "valence"], "y")


@register(
    "gaze_density",
    """
select scene_index, cell_x, cell_y, n, n / sum(n) over (partition by scene_index)::double as share
from (select scene_index, cast(least(floor(least(1, greatest(0, rx)) * 20), 19) as int) as cell_x,
        cast(least(floor(least(1, greatest(0, ry)) * 20), 19) as int) as cell_y, count(*) as n
      from samples where rx is not null and ry is not null and rx > -0.1 and rx < 1.1
        and ry > -0.1 and ry < 1.1 group by all)""",
    others=["scene_index", "cell_x", "cell_y", "n"], nums=["share"],
)
def gaze_density(spark, d):
    return S.gaze_density(I.samples(spark, d), ["scene_index"])


_KDE_SQL = """
with seen as (
  select scene_index as s, rx as x, ry as y from samples
  where rx is not null and ry is not null and rx > -0.1 and rx < 1.1 and ry > -0.1 and ry < 1.1
), shape as (
  select s, n, xy / xx as beta, 0.05 * sqrt(xx) as sx, 0.05 * sqrt(yy - xy * xy / xx) as sy from (
    select s, count(*) as n, var_samp(x) as xx, covar_samp(x, y) as xy, var_samp(y) as yy from seen group by s)
  where n >= 11 and xx > 1e-12 and yy - xy * xy / xx > 1e-12
), cells as (
  select s, floor((y - beta * x) / sy * 32) as jb, floor(x / sx * 32) as ib, count(*) as n, avg(x) as x, avg(y - beta * x) as r
  from seen join shape using (s) group by 1, 2, 3
), nodes as (
  select unnest(range(200)) as i
), across_x as (
  select s, jb, i, sum(w) as w, sum(w * r) / sum(w) as r from (
    select s, jb, i, r, c.n * exp(-0.5 * power((i / 199.0::double - c.x) / sx, 2)) as w from cells c join shape using (s)
    join nodes on abs(i / 199.0::double - c.x) <= 6 * sx) group by 1, 2, 3
), down_y as (
  select s, a.i, j.i as j, sum(w * exp(-0.5 * power((j.i / 199.0::double - r - beta * (a.i / 199.0::double)) / sy, 2))) as w
  from across_x a join shape using (s) join nodes j on abs(j.i / 199.0::double - r - beta * (a.i / 199.0::double)) <= 6 * sy
  group by 1, 2, 3
), density as (
  select s, w / (n * 2 * pi() * sx * sy) as d from down_y join shape using (s)
)
select s as scene_index, peak, cast(least(floor(d / peak * 20 + 1e-9), 19) as int) as level, count(*) as nodes,
  sum(d) / 39601::double as mass
from density join (select s, max(d) as peak from density group by s) using (s) group by all"""


@register(
    "gaze_contours", _KDE_SQL, others=["scene_index", "level"], nums=["mass", "peak"], digits=4,
    extra={},
)
def gaze_contours(spark, d):
    """Twenty contour levels of the kernel density of each scene, at 200 x 200 nodes."""
    return S.density_levels(S.kernel_density(I.samples(spark, d), ["scene_index"]), ["scene_index"]).drop("nodes")


_BOX = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


@register(
    "severity_distribution",
    "select bdi_severity, metric, quantile_cont(v, 0.25) as p25, quantile_cont(v, 0.5) as p50, "
    "quantile_cont(v, 0.75) as p75 from ("
    + " union all ".join(
        f"select bdi_severity, '{c}' as metric, {c} as v from static_f join forms using "
        f"(session_id) where {c} is not null" for c in static_sql())
    + ") group by all",
    others=["bdi_severity", "metric"], nums=list(_BOX), extra=STATIC_CTE,
)
def severity_distribution(spark, d):
    return S.group_distribution(session_scores(spark, d), X.static_features().columns, "bdi_severity", _BOX)


@register(
    "false_discovery",
    """
select id, p_value, least(1.0, min(raw) over (order by r rows between current row and unbounded
  following)) as q_value from (
  select l_suppkey % 1000 as id, p_value, row_number() over (order by p_value, l_suppkey) as r,
    p_value * count(*) over () / row_number() over (order by p_value, l_suppkey) as raw
  from (select l_suppkey, avg(l_discount) as p_value from lineitem group by l_suppkey))""",
    others=["id"], nums=["p_value", "q_value"],
)
def false_discovery(spark, d):
    """Adjustment of one number in 0..1 per supplier (mean discount stands for a p-value)."""
    tests = I.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(
        F.avg("l_discount").alias("p_value")
    )
    return S.benjamini_hochberg(tests, "p_value", "q_value")


@register(
    "concordance_counts",
    """
select count(*) filter (a < 0.05 and b < 0.05) as "both",
  count(*) filter (a < 0.05 and b >= 0.05) as phq_only,
  count(*) filter (a >= 0.05 and b < 0.05) as bdi_only,
  count(*) filter (a >= 0.05 and b >= 0.05) as neither, count(*) as n_tests
from (select round(avg(l_discount), 9) as a, round(avg(l_tax), 9) as b from lineitem
      group by l_partkey)""",
    others=['"both"', "phq_only", "bdi_only", "neither", "n_tests"],
)
def concordance_counts(spark, d):
    """Agreement of two numbers per part, in place of two p-values."""
    rows = I.table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.avg("l_discount").alias("a"), F.avg("l_tax").alias("b")
    )
    return S.concordance(steady(rows, ["a", "b"]), "a", "b")


def _by_pair(df):
    return df.groupBy("scene_valence_pair").agg(
        F.avg("fixation_count").alias("fixations"), F.avg("blink_count").alias("blinks")
    )


@register(
    "side_by_side",
    """
select a.scene_valence_pair, a.f as fixations_stimulus, a.b as blinks_stimulus,
  c.f as fixations_cross, c.b as blinks_cross
from (select scene_valence_pair, avg(fixation_count) as f, avg(blink_count) as b from scene
      where scene_type = 'stimulus' group by 1) a
join (select scene_valence_pair, avg(fixation_count) as f, avg(blink_count) as b from scene
      where scene_type <> 'stimulus' group by 1) c
  on a.scene_valence_pair is not distinct from c.scene_valence_pair""",
    others=["scene_valence_pair"],
    nums=["fixations_stimulus", "blinks_stimulus", "fixations_cross", "blinks_cross"],
)
def side_by_side(spark, d):
    """Two result tables matched on a key that may be missing."""
    s = I.scenes(spark, d)
    kind = F.col("scene_type") == "stimulus"
    return S.two_scale_comparison(
        _by_pair(s.filter(kind)), _by_pair(s.filter(~kind)), ["scene_valence_pair"],
        ["fixations", "blinks"], ("stimulus", "cross"),
    )


# --- mixed models -----------------------------------------------------------------



def temporal_sums(spark, d, score):
    return stage(
        spark, d, f"temporal_sums_{score}",
        lambda: L.user_sums(L.temporal_rows(gaze_trials(spark, d), score),
                            ["metric", "pair_suffix"], L.TEMPORAL_DESIGN),
    )


def valence_sums(spark, d, score):
    return stage(
        spark, d, f"valence_sums_{score}",
        lambda: L.user_sums(L.valence_rows(gaze_trials(spark, d), score),
                            ["outcome", "pair_suffix"], L.VALENCE_DESIGN),
    )


def _sums_sql(source: str, model: list[str], columns: list[str]) -> str:
    p = len(columns)
    out = ["count(*) as n_outcome", "count(x1) as n", "sum(y * y) filter (x1 is not null) as yy"]
    out += [f"sum(x{i} * y) filter (x1 is not null) as xy_{i}" for i in range(p)]
    out += [f"sum(x{i} * x{j}) filter (x1 is not null) as xx_{i}_{j}" for i in range(p)
            for j in range(i, p)]
    xs = ", ".join(f"{c} as x{i}" for i, c in enumerate(columns))
    return (f"select {', '.join(model)}, uid, {', '.join(out)} from (select *, {xs} from ({source})) "
            f"group by {', '.join(model)}, uid")


def _sum_names(p: int) -> list[str]:
    return (["yy"] + [f"xy_{i}" for i in range(p)]
            + [f"xx_{i}_{j}" for i in range(p) for j in range(i, p)])


_TEMPORAL_LONG = " union all ".join(
    [f"select '{m}' as metric, null as pair_suffix, uid, phq9_z as s, trial_norm as t, {m} as y "
     f"from zrows where {m} is not null" for m in L.INVARIANT_METRICS]
    + [f"select '{m}', '{p.suffix}', uid, phq9_z, trial_norm, {m} from zrows where {m} is not null "
       f"and scene_valence_pair = '{p.name}'" for m in L.STRATIFIED_METRICS for p in M.PAIRS]
)


@register(
    "temporal_model_sums",
    _sums_sql(_TEMPORAL_LONG, ["metric", "pair_suffix"], ["1.0::double", "s", "t", "s * t"]),
    others=["metric", "pair_suffix", "uid", "n_outcome", "n"], sums=_sum_names(4), extra=Z,
)
def temporal_model_sums(spark, d):
    """Per-user sums of the trial-position models."""
    return temporal_sums(spark, d, "phq9_z")


#: Target valence of each pair, written out so that the SQL does not depend on the plan's own rule.
_TARGETS = {"negative_vs_positive": "negative", "negative_vs_neutral": "negative", "neutral_vs_positive": "positive"}

_VALENCE_LONG = " union all ".join(
    f"select '{o}' as outcome, '{p.suffix}' as pair_suffix, uid, phq9_z as s, trial_norm as t, "
    f"{int(v == _TARGETS[p.name])}::double as g, {o}_{v} as y from zrows "
    f"where scene_valence_pair = '{p.name}' and {o}_{v} is not null"
    for o in L.OUTCOMES for p in M.PAIRS for v in p.valences
)


@register(
    "valence_model_sums",
    _sums_sql(_VALENCE_LONG, ["outcome", "pair_suffix"], ["1.0::double", "s", "g", "s * g", "t"]),
    others=["outcome", "pair_suffix", "uid", "n_outcome", "n"], sums=_sum_names(5), extra=Z,
)
def valence_model_sums(spark, d):
    return valence_sums(spark, d, "phq9_z")


def temporal_summary(spark, d, score):
    return stage(spark, d, f"temporal_models_{score}",
                 lambda: L.temporal_summary(spark, temporal_sums(spark, d, score)))


def valence_summary(spark, d, score):
    return stage(spark, d, f"valence_models_{score}",
                 lambda: L.valence_summary(spark, valence_sums(spark, d, score)))


@register("temporal_models")
def temporal_models(spark, d):
    return temporal_summary(spark, d, "phq9_z")


@register("valence_models")
def valence_models(spark, d):
    return valence_summary(spark, d, "phq9_z")


@register("temporal_model_comparison")
def temporal_model_comparison(spark, d):
    """Both scales side by side, with the general metrics matched on their missing pair."""
    phq, bdi = (temporal_summary(spark, d, s) for s in ("phq9_z", "bdi_z"))
    return S.two_scale_comparison(phq, bdi, ["metric", "pair_suffix"],
                                  ["score_coef", "score_pval_fdr", "score_d", "icc"])


@register("model_concordance")
def model_concordance(spark, d):
    phq, bdi = (valence_summary(spark, d, s) for s in ("phq9_z", "bdi_z"))
    both = S.two_scale_comparison(phq, bdi, ["outcome", "pair_suffix"], ["interaction_pval_fdr"])
    return S.concordance(both, "interaction_pval_fdr_phq", "interaction_pval_fdr_bdi")


@register("significant_terms")
def significant_terms(spark, d):
    return L.significant_counts(temporal_summary(spark, d, "phq9_z"))


@register("model_reliability")
def model_reliability(spark, d):
    return L.icc_report(temporal_summary(spark, d, "phq9_z"))


LINE_OUTCOMES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def line_rows(spark, d):
    """Line items as trials: supplier is the user, its balance the score, line number the position."""
    s = I.table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_acctbal").alias("balance")
    )
    rows = P.with_z_scores(I.table(spark, d, "lineitem").join(s, "l_suppkey"), {"score": "balance"})
    rows = rows.withColumn("trial", (F.col("l_linenumber") - 1) / 6.0)
    return S.long_form(
        rows, ["l_suppkey", "l_returnflag", "score", "trial"], LINE_OUTCOMES, "metric", "y"
    ).withColumnsRenamed({"l_suppkey": "uid", "l_returnflag": "pair_suffix"})


def line_sums(spark, d):
    return stage(
        spark, d, "line_sums",
        lambda: L.user_sums(line_rows(spark, d), ["metric", "pair_suffix"], L.TEMPORAL_DESIGN),
    )


@register(
    "line_model_sums",
    _sums_sql(
        " union all ".join(
            f"select '{c}' as metric, l_returnflag as pair_suffix, l_suppkey as uid, "
            f"(s_acctbal - avg(s_acctbal) over ()) / stddev_samp(s_acctbal) over () as s, "
            f"(l_linenumber - 1) / 6.0::double as t, {c} as y "
            f"from lineitem join supplier on s_suppkey = l_suppkey" for c in LINE_OUTCOMES),
        ["metric", "pair_suffix"], ["1.0::double", "s", "t", "s * t"]),
    others=["metric", "pair_suffix", "uid", "n_outcome", "n"], sums=_sum_names(4),
)
def line_model_sums(spark, d):
    return line_sums(spark, d)


@register("line_models")
def line_models(spark, d):
    return L.temporal_summary(spark, line_sums(spark, d))


