"""Audit and overview reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatio import model as M
from fixatio.operators import blocks as B
from fixatio.operators import prepare as P
from fixatio.operators import reports as R
from fixatio.operators import scene as S
from fixatio.plans import inputs as I
from fixatio.plans.feature_queries import clean
from fixatio.plans.registry import register

NUMERIC = [c for c, t in S.SCENE_COLUMNS.items() if t in ("double", "int", "long")
           and c != "scene_index"]
KEY_METRICS = [
    "fixation_count", "mean_fixation_duration_ms", "total_fixation_duration_ms",
    "fixation_rate_per_sec", "scanpath_length", "saccade_count", "saccade_rate_per_sec",
    "mean_saccade_amplitude", "blink_count", "blink_rate_per_min", "gaze_transition_entropy",
    "transition_matrix_density", *M.BIASES,
]
STIM = "(select * from scene where scene_type = 'stimulus')"
PAIR_STIM = ("(select * from scene where scene_type = 'stimulus' and scene_valence_pair in "
             "('negative_vs_positive', 'negative_vs_neutral', 'neutral_vs_positive'))")


def stim(spark, d):
    return I.scenes(spark, d).filter(F.col("scene_type") == "stimulus")


def pair_stim(spark, d):
    return P.stimulus_trials(I.scenes(spark, d))


def trials(spark, d):
    return P.join_forms(clean(spark, d), I.forms(spark, d),
                        ["uid", "phq9_score", "bdi_score", "createdAt"])


@register("clean_trials", "select * from clean",
          others=["session_id", "scene_index", "scene_valence_pair"], nums=["duration_ms"])
def clean_trials(spark, d):
    return clean(spark, d).select("session_id", "scene_index", "scene_valence_pair", "duration_ms")


@register(
    "entity_counts",
    "select count(*) as n_rows, count(distinct session_id) as n_session_id, "
    "count(distinct folder) as n_folder from scene",
    others=["n_rows", "n_session_id", "n_folder"],
)
def entity_counts(spark, d):
    return R.entity_counts(I.scenes(spark, d), ["session_id", "folder"])


@register(
    "folder_counts",
    "select folder, count(distinct session_id) as n_session_id, count(*) as n_rows "
    "from scene group by folder",
    others=["folder", "n_session_id", "n_rows"],
)
def folder_counts(spark, d):
    return R.distinct_per_group(I.scenes(spark, d), ["folder"], "session_id")


@register(
    "pair_counts",
    f"select folder, scene_valence_pair, count(*) as n from {PAIR_STIM} group by all",
    others=["folder", "scene_valence_pair", "n"],
)
def pair_counts(spark, d):
    return R.grouped_counts(pair_stim(spark, d), ["folder", "scene_valence_pair"])


@register(
    "scene_kind_counts",
    "select scene_type, scene_quality_valid, scene_valence_pair, count(*) as n from scene "
    "group by all",
    others=["scene_type", "scene_quality_valid", "scene_valence_pair", "n"],
)
def scene_kind_counts(spark, d):
    return R.grouped_counts(
        I.scenes(spark, d), ["scene_type", "scene_quality_valid", "scene_valence_pair"]
    )


@register("valence_counts", "select folder, valence, count(*) as n from stim group by all",
          others=["folder", "valence", "n"])
def valence_counts(spark, d):
    return R.grouped_counts(I.stimuli(spark, d), ["folder", "valence"])


@register(
    "match_counts",
    "select count(*) as n_sessions, count(uid) as with_forms, count(*) - count(uid) as "
    "without_forms from (select distinct session_id from samples) left join forms using "
    "(session_id)",
    others=["n_sessions", "with_forms", "without_forms"],
)
def match_counts(spark, d):
    files = I.samples(spark, d).select("session_id").distinct()
    return R.match_counts(P.sessions_table(files, I.forms(spark, d)))


@register(
    "form_coverage",
    """
select 'with_forms' as kind, count(*) as n from (select distinct session_id from scene
  where session_id in (select session_id from forms)) union all
select 'without_forms', count(*) from (select distinct session_id from scene
  where session_id not in (select session_id from forms)) union all
select 'forms_without_scenes', count(*) from (select distinct session_id from forms
  where session_id not in (select session_id from scene))""",
    others=["kind", "n"],
)
def form_coverage(spark, d):
    seen = I.scenes(spark, d).select("session_id").distinct()
    forms = I.forms(spark, d).select("session_id").distinct()
    parts = {
        "with_forms": P.sessions_with(seen, forms),
        "without_forms": P.sessions_without(seen, forms),
        "forms_without_scenes": P.sessions_without(forms, seen),
    }
    out = None
    for kind, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@register(
    "shared_sessions",
    "select session_id from scene intersect select session_id from forms", others=["session_id"],
)
def shared_sessions(spark, d):
    return I.scenes(spark, d).select("session_id").intersect(I.forms(spark, d).select("session_id"))


@register(
    "clean_share",
    f"""select count(*) as n_stimulus, count(*) filter (ok) as n_clean,
count(*) filter (not ok) as n_other, 100.0::double * count(*) filter (ok) / count(*) as pct_clean
from (select coalesce(scene_valence_pair in ('negative_vs_positive', 'negative_vs_neutral',
  'neutral_vs_positive'), false) as ok from {STIM})""",
    others=["n_stimulus", "n_clean", "n_other"], nums=["pct_clean"],
)
def clean_share(spark, d):
    return R.clean_share(stim(spark, d))


@register(
    "sessions_per_user",
    "select uid, count(distinct session_id) as n_sessions from clean join forms using (session_id) "
    "group by uid",
    others=["uid", "n_sessions"],
)
def sessions_per_user(spark, d):
    return R.sessions_per_user(trials(spark, d))


@register(
    "sessions_per_user_report",
    """select count(*) as n_users, count(*) filter (n = 1) as one_session,
count(*) filter (n >= 2) as several_sessions, max(n) as max_sessions,
100.0::double * count(*) filter (n > 1) / count(*) as pct_several
from (select uid, count(distinct session_id) as n from clean join forms using (session_id)
      group by uid)""",
    others=["n_users", "one_session", "several_sessions", "max_sessions"], nums=["pct_several"],
)
def sessions_per_user_report(spark, d):
    return R.sessions_per_user_report(R.sessions_per_user(trials(spark, d)))


USER_SEVERITY = {"user_sev": """
select *, case when phq9_score_mean < 5 then 'minimal' when phq9_score_mean < 10 then 'mild'
    when phq9_score_mean < 15 then 'moderate' when phq9_score_mean < 20 then 'moderately_severe'
    when phq9_score_mean is not null then 'severe' end as phq9_severity,
  case when bdi_score_mean < 14 then 'minimal' when bdi_score_mean < 20 then 'mild'
    when bdi_score_mean < 29 then 'moderate' when bdi_score_mean is not null then 'severe' end
    as bdi_severity
from (select uid, avg(phq9_score) as phq9_score_mean, avg(bdi_score) as bdi_score_mean
      from (select distinct uid, session_id, phq9_score, bdi_score from forms) group by uid)"""}


@register("user_severity", "select * from user_sev",
          others=["uid", "phq9_severity", "bdi_severity"],
          nums=["phq9_score_mean", "bdi_score_mean"], extra=USER_SEVERITY)
def user_severity(spark, d):
    return R.user_severity(I.forms(spark, d))


@register(
    "severity_counts",
    "select phq9_severity as severity, count(*) as n, case phq9_severity when 'minimal' then 0 "
    "when 'mild' then 1 when 'moderate' then 2 when 'moderately_severe' then 3 when 'severe' "
    "then 4 end as position from user_sev group by phq9_severity",
    others=["severity", "n", "position"], extra=USER_SEVERITY,
)
def severity_counts(spark, d):
    users = R.user_severity(I.forms(spark, d))
    return R.severity_counts(users, "phq9_severity", M.PHQ9)


def _describe_sql(source: str, cols, quantiles=()) -> str:
    q = "".join(f", quantile_cont(v, {p}) as {n}" for n, p in quantiles)
    parts = " union all ".join(f"select '{c}' as metric, {c}::double as v from {source}" for c in cols)
    return (f"select metric, count(v) as n, avg(v) as mean, stddev_samp(v) as sd, min(v) as min, "
            f"max(v) as max{q} from ({parts}) where v is not null group by metric")


@register("key_metric_description", _describe_sql(PAIR_STIM, KEY_METRICS), others=["metric", "n"],
          nums=["mean", "sd", "min", "max"])
def key_metric_description(spark, d):
    return R.describe(pair_stim(spark, d), KEY_METRICS)


@register(
    "quality_description",
    _describe_sql(STIM, ["n_samples", "missing_gaze_ratio", "blink_ratio", "duration_ms"],
                  R.FIVE.items()),
    others=["metric", "n"], nums=["mean", "sd", "min", "max", *R.FIVE],
)
def quality_description(spark, d):
    return R.describe(
        stim(spark, d), ["n_samples", "missing_gaze_ratio", "blink_ratio", "duration_ms"], R.FIVE
    )


@register(
    "trials_per_session",
    _describe_sql("(select count(*) as n_trials from clean join forms using (session_id) "
                  "group by session_id)", ["n_trials"], R.FIVE.items()),
    others=["metric", "n"], nums=["mean", "sd", "min", "max", *R.FIVE],
)
def trials_per_session(spark, d):
    per = trials(spark, d).groupBy("session_id").agg(F.count(F.lit(1)).alias("n_trials"))
    return R.describe(per, ["n_trials"], R.FIVE)


@register(
    "low_coverage",
    f"select count(*) filter (n < 25) as n_low, count(*) as n_sessions from "
    f"(select session_id, count(*) as n from {PAIR_STIM} group by session_id)",
    others=["n_low", "n_sessions"],
)
def low_coverage(spark, d):
    return R.low_coverage(pair_stim(spark, d), 25)


@register(
    "modal_sizes",
    "select round_even(value / 100, 0) * 100 as bin, count(*) as n from events group by 1 "
    "order by n desc, bin limit 5",
    others=["n"], nums=["bin"],
)
def modal_sizes(spark, d):
    return R.modal_bins(I.table(spark, d, "events"), "value")


@register(
    "modal_durations",
    "select round_even(duration_ms / 100, 0) * 100 as bin, count(*) as n from clean group by 1 "
    "order by n desc, bin limit 5",
    others=["n"], nums=["bin"],
)
def modal_durations(spark, d):
    return R.modal_bins(clean(spark, d), "duration_ms")


@register(
    "date_span",
    "select cast(min(t) as varchar) as first_ts, cast(max(t) as varchar) as last_ts, count(t) as n,"
    " date_diff('day', min(t), max(t)) as span_days from "
    "(select try_cast(created_at as timestamp) as t from forms)",
    others=["first_ts", "last_ts", "n", "span_days"],
)
def date_span(spark, d):
    out = R.date_span(P.with_created_ts(I.forms(spark, d)))
    fmt = "yyyy-MM-dd HH:mm:ss"
    return out.withColumn("first_ts", F.date_format("first_ts", fmt)).withColumn(
        "last_ts", F.date_format("last_ts", fmt)
    )


RATE = {"rate": """
select sid as session_id, median(dt) as median_dt_ms, 1000.0 / median(dt) as hz
from (select sid, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by sid order by ts, event_id))
        / 60000000.0::double as dt from numbered)
where dt > 0 and dt < 1000 group by sid"""}


def _event_rate(spark, d):
    """Steps between the events of a session, in minutes taken for milliseconds."""
    rows = I.table(spark, d, "events").select(
        F.floor(F.col("user_id") / 10).cast("long").alias("session_id"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("sample_idx"),
    )
    first = rows.agg(F.min("us").alias("_t0"))
    rows = rows.crossJoin(F.broadcast(first))  # one row
    rows = rows.withColumn("timestamp_ms", (F.col("us") - F.col("_t0")) / 60_000_000.0)
    return R.sampling_rate(rows, block_ms=500)


@register("sampling_rate", "select * from rate", others=["session_id"],
          nums=["median_dt_ms", "hz"], extra=RATE, digits=9)
def sampling_rate(spark, d):
    return _event_rate(spark, d)


@register(
    "sampling_rate_buckets",
    "select case when hz <= 0 then null when hz <= 10 then '<10' when hz <= 15 then '10-15' when "
    "hz <= 20 then '15-20' when hz <= 25 then '20-25' when hz <= 30 then '25-30' when hz <= 40 "
    "then '30-40' when hz <= 1000 then '40+' end as bucket, count(*) as n from rate group by 1",
    others=["bucket", "n"], extra=RATE,
)
def sampling_rate_buckets(spark, d):
    rate = _event_rate(spark, d).withColumn("bucket", R.rate_bucket())
    return rate.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@register(
    "null_rates",
    " union all ".join(
        f"select scene_valence_pair, '{c}' as metric, avg(({c} is null)::int) as nan_rate from "
        f"{PAIR_STIM} group by scene_valence_pair" for c in NUMERIC
    ),
    others=["scene_valence_pair", "metric"], nums=["nan_rate"],
)
def null_rates(spark, d):
    return R.null_rates(pair_stim(spark, d), NUMERIC, ["scene_valence_pair"])


@register(
    "bias_bounds",
    " union all ".join(
        f"select '{b}' as metric, min({b}) as min, max({b}) as max, count({b}) as n, "
        f"coalesce(min({b}) >= -1 and max({b}) <= 1, true) as ok from {PAIR_STIM}" for b in M.BIASES
    ),
    others=["metric", "n", "ok"], nums=["min", "max"],
)
def bias_bounds(spark, d):
    return R.bound_checks(pair_stim(spark, d))


@register(
    "count_signs",
    " union all ".join(
        f"select '{c}' as metric, count(*) filter ({c} < 0) as n_negative, "
        f"count(*) filter ({c} < 0) = 0 as ok from {PAIR_STIM}" for c in R.COUNT_METRICS
    ),
    others=["metric", "n_negative", "ok"],
)
def count_signs(spark, d):
    return R.sign_checks(pair_stim(spark, d))


@register(
    "outlier_scenes",
    f"select * from {STIM} where fixation_count > 5 "
    "order by fixation_count desc, session_id, scene_index limit 20",
    others=["session_id", "scene_index", "n_samples"], nums=["fixation_count", "duration_ms"],
)
def outlier_scenes(spark, d):
    return R.outlier_scenes(stim(spark, d), above=5)


ROLL = {"roll": """
select s.*, phq9_score, bdi_score, valid_scenes / total_scenes::double as valid_ratio
from (select session_id, count(*) as total_scenes,
        count(*) filter (scene_quality_valid) as valid_scenes, avg(blink_ratio) as mean_blink_ratio,
        avg(missing_gaze_ratio) as mean_missing_ratio, avg(duration_ms) as mean_duration_ms,
        sum(duration_ms) / 1000 as total_seconds from scene group by session_id) s
left join forms using (session_id)"""}


@register(
    "session_roll_up", "select * from roll",
    others=["session_id", "total_scenes", "valid_scenes", "phq9_score", "bdi_score"],
    nums=["mean_blink_ratio", "mean_missing_ratio", "mean_duration_ms", "total_seconds",
          "valid_ratio"],
    extra=ROLL,
)
def session_roll_up(spark, d):
    return R.session_roll_up(I.scenes(spark, d), I.forms(spark, d))


@register(
    "validity_counts",
    "select count(*) as n_sessions, count(*) filter (valid_ratio >= 0.8) as n_at_least, "
    "count(*) filter (valid_ratio < 0.8) as n_below from roll",
    others=["n_sessions", "n_at_least", "n_below"], extra=ROLL,
)
def validity_counts(spark, d):
    return R.validity_counts(R.session_roll_up(I.scenes(spark, d), I.forms(spark, d)))


def _hist_sql(source: str, cols, bins: int) -> str:
    parts = " union all ".join(f"select '{c}' as metric, {c}::double as v from {source}" for c in cols)
    return f"""
select metric, bin, count(*) as n, any_value(lo) as lo, any_value(hi) as hi from (
  select *, cast(case when hi > lo then least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1})
            else {bins // 2} end as int) as bin
  from (select metric, v, min(v) over (partition by metric) as lo,
          max(v) over (partition by metric) as hi from ({parts}) where v is not null))
group by metric, bin"""


@register("bias_histograms", _hist_sql(PAIR_STIM, M.BIASES, 50), others=["metric", "bin", "n"],
          nums=["lo", "hi"])
def bias_histograms(spark, d):
    return R.histograms(pair_stim(spark, d), M.BIASES)


@register("score_histograms", _hist_sql("forms", ["phq9_score", "bdi_score"], 28),
          others=["metric", "bin", "n"], nums=["lo", "hi"])
def score_histograms(spark, d):
    return R.histograms(I.forms(spark, d), P.SCORES, 28)


@register(
    "trimmed_histogram",
    _hist_sql(f"(select scanpath_length from {STIM} where scanpath_length between (select "
              f"quantile_cont(scanpath_length, 0.01) from {STIM}) and (select "
              f"quantile_cont(scanpath_length, 0.99) from {STIM}))", ["scanpath_length"], 50),
    others=["metric", "bin", "n"], nums=["lo", "hi"],
)
def trimmed_histogram(spark, d):
    return R.histograms(P.trim(stim(spark, d), "scanpath_length"), ["scanpath_length"])


@register(
    "fixation_valence",
    """
select coalesce(s.valence, 'off_image') as valence, count(*) as n, avg(dur) as mean_duration_ms
from fix f join (select distinct session_id, folder from samples) x using (session_id)
left join stim s on s.folder = x.folder and s.image_id = f.image
where f.scene_index % 2 = 1 group by 1""",
    others=["valence", "n"], nums=["mean_duration_ms"],
)
def fixation_valence(spark, d):
    fx = I.fixations(spark, d).filter(F.col("scene_index") % 2 == 1)
    return R.fixation_summary(P.fixation_valence(fx, I.stimuli(spark, d)))


@register(
    "numbered_lines",
    "select l_suppkey, l_orderkey, l_linenumber, row_number() over (partition by l_suppkey "
    "order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as n from lineitem",
    others=["l_suppkey", "l_orderkey", "l_linenumber", "n"],
)
def numbered_lines(spark, d):
    """Row numbers by blocks of order keys on the largest table."""
    rows = I.table(spark, d, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    out = B.number_rows(
        rows, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"],
        B.block("l_orderkey", 4096), "n",
    )
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "n")


@register(
    "price_quantiles",
    "select l_returnflag, quantile_cont(l_extendedprice, 0.05) as p05, "
    "quantile_cont(l_extendedprice, 0.25) as p25, quantile_cont(l_extendedprice, 0.5) as p50, "
    "quantile_cont(l_extendedprice, 0.75) as p75, quantile_cont(l_extendedprice, 0.95) as p95 "
    "from lineitem group by l_returnflag",
    others=["l_returnflag"], nums=list(R.FIVE),
)
def price_quantiles(spark, d):
    return B.exact_quantiles(
        I.table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", R.FIVE
    )
