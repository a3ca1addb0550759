"""Session and user feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatio import model as M
from fixatio.operators import features as X
from fixatio.operators import prepare as P
from fixatio.plans import inputs as I
from fixatio.plans.registry import register

# Names come from the model; what the SQL does with them is written out here.
SHORT = M.VALENCE_SHORT
SUFFIX = {p.name: p.suffix for p in M.PAIRS}
MEMBERS = {p.suffix: p.valences for p in M.PAIRS}
SIMPLE = X.GENERAL_METRICS
METRICS = tuple(X.VALENCE_METRICS.items())


def clean(spark, d):
    return P.clean_trials(I.scenes(spark, d))


def sql_series():
    """(name, column, condition) of every series, for the SQL texts."""
    for m in SIMPLE:
        yield m, m, "true"
    for pair, s in SUFFIX.items():
        yield f"bias_{s}", f"bias_{s}", f"scene_valence_pair = '{pair}'"
    for prefix, m in METRICS:
        for pair, s in SUFFIX.items():
            for v in MEMBERS[s]:
                yield (f"{prefix}_{SHORT[v]}__{s}", f"{m}_{v}",
                       f"scene_valence_pair = '{pair}'")


def sql_first_fix():
    for pair, s in SUFFIX.items():
        for v in MEMBERS[s]:
            yield (f"first_fix_prob_{SHORT[v]}__{s}",
                   f"(first_fixation_valence = '{v}')::int",
                   f"scene_valence_pair = '{pair}'")


def static_sql() -> dict[str, str]:
    cols = {}
    for m, name in X.STATIC_NAMES.items():
        cols[name] = f"avg({m})"
    for name, m, cond in sql_series():
        if name.startswith("bias"):
            cols[f"avg_{name}"] = f"avg({m}) filter ({cond})"
        elif "__" in name:
            cols[f"avg_{name}"] = f"avg({m}) filter ({cond})"
            if name.startswith("ttff"):
                cols[name.replace("ttff", "ttff_miss_rate")] = (
                    f"avg(({m} is null)::int) filter ({cond})")
    for name, hit, cond in sql_first_fix():
        cols[name] = f"avg({hit}) filter ({cond})"
    return cols


def temporal_sql() -> dict[str, str]:
    cols = {}
    for name, m, cond in [*sql_series(), *sql_first_fix()]:
        e = f"avg({m}) filter ({cond} and early)"
        late = f"avg({m}) filter ({cond} and not early)"
        cols |= {f"{name}_early": e, f"{name}_late": late, f"{name}_delta": f"{late} - {e}"}
    return cols


def distributional_sql() -> dict[str, str]:
    cols = {}
    for name, m, cond in sql_series():
        q = {p: f"quantile_disc({m}, {p}) filter ({cond})" for p in (0.25, 0.5, 0.75)}
        cols |= {f"{name}_q{int(100 * p)}": e for p, e in q.items()}
        cols[f"{name}_iqr"] = f"{q[0.75]} - {q[0.25]}"
    for name, hit, cond in sql_first_fix():
        cols[name] = f"avg({hit}) filter ({cond})"
    return cols


def select(cols: dict[str, str]) -> str:
    return ", ".join(f"{e} as {n}" for n, e in cols.items())


STATIC_CTE = {"static_f": f"select session_id, {select(static_sql())} from clean group by session_id"}
TLBS_CTE = {
    "bias_rows": " union all ".join(
        f"select session_id, scene_index, '{s}' as s, bias_{s} as b from clean "
        f"where scene_valence_pair = '{pair}' and bias_{s} is not null"
        for pair, s in SUFFIX.items()
    ),
    "tlbs_long": """
select session_id, s, count(*) as n, coalesce(avg(b) filter (b > 0), 0) as mean_pos,
  coalesce(avg(b) filter (b < 0), 0) as mean_neg, max(b) as peak_pos, min(b) as peak_neg,
  avg(abs(b)) as mean_abs, avg(abs(b - pb)) as variability, regr_slope(b, scene_index) as slope
from (select *, lag(b) over (partition by session_id, s order by scene_index) as pb
      from bias_rows) group by session_id, s""",
    "tlbs_f": "select i.session_id, "
    + ", ".join(
        f"max({p}) filter (s = '{s}' and n >= 3) as tlbs_{p}__{s}"
        for s in MEMBERS for p in X.TLBS_PARAMS
    )
    + " from (select distinct session_id from clean) i left join tlbs_long using (session_id) "
    "group by i.session_id",
}
THIRDS_CTE = {
    "thirds": """
select * from (select *, trial_num <= n / 3.0::double as early, trial_num > 2 * n / 3.0::double as late
  from (select *, row_number() over (partition by session_id order by scene_index) as trial_num,
          count(*) over (partition by session_id) as n from clean))
where early or late"""
}


DISTRIBUTIONAL_CTE = {"distributional_f": f"select session_id, {select(distributional_sql())} from clean group by session_id"}
TEMPORAL_CTE = {**THIRDS_CTE, "temporal_f": f"select session_id, {select(temporal_sql())} from thirds group by session_id"}


@register("static_features", "select * from static_f", others=["session_id"],
          nums=list(static_sql()), extra=STATIC_CTE)
def static_features(spark, d):
    return X.static_features().apply(clean(spark, d))


@register(
    "distributional_features",
    f"select session_id, {select(distributional_sql())} from clean group by session_id",
    others=["session_id"], nums=list(distributional_sql()),
)
def distributional_features(spark, d):
    return X.distributional_features().apply(clean(spark, d))


@register(
    "temporal_features",
    f"select session_id, {select(temporal_sql())} from thirds group by session_id",
    others=["session_id"], nums=list(temporal_sql()), extra=THIRDS_CTE,
)
def temporal_features(spark, d):
    return X.temporal_features().apply(P.with_thirds(P.trial_numbers(clean(spark, d))))


@register("tlbs_features", "select * from tlbs_f", others=["session_id"], nums=X.tlbs_names(),
          extra=TLBS_CTE)
def tlbs_features(spark, d):
    return X.tlbs_features(clean(spark, d), block_scenes=8)


def user_table(spark, d, family: str):
    """User means of one feature family and both scores."""
    trials = clean(spark, d)
    forms = I.forms(spark, d)
    if family == "static":
        feats, cols = X.static_features().apply(trials), X.static_features().columns
    elif family == "distributional":
        feats, cols = X.distributional_features().apply(trials), X.distributional_features().columns
    elif family == "temporal":
        rows = P.with_thirds(P.trial_numbers(trials))
        feats, cols = X.temporal_features().apply(rows), X.temporal_features().columns
    else:
        cols = X.tlbs_names() + X.static_features().columns
        feats = X.tlbs_features(trials).join(X.static_features().apply(trials), "session_id")
    return X.user_means(P.join_forms(feats, forms), [*cols, *P.SCORES])


def _user_sql(source: str, cols: list[str]) -> str:
    means = ", ".join(f"avg({c}) as {c}" for c in [*cols, "phq9_score", "bdi_score"])
    return f"select uid, {means} from {source} join forms using (session_id) group by uid"


USER_STATIC_CTE = {**STATIC_CTE, "user_static": _user_sql("static_f", list(static_sql()))}


@register(
    "user_static_features", "select * from user_static", others=["uid"],
    nums=[*static_sql(), "phq9_score", "bdi_score"], extra=USER_STATIC_CTE,
)
def user_static_features(spark, d):
    return user_table(spark, d, "static")


@register(
    "user_distributional_features", _user_sql("distributional_f", list(distributional_sql())),
    others=["uid"], nums=[*distributional_sql(), "phq9_score", "bdi_score"], extra=DISTRIBUTIONAL_CTE,
)
def user_distributional_features(spark, d):
    return user_table(spark, d, "distributional")


@register(
    "user_temporal_features", _user_sql("temporal_f", list(temporal_sql())),
    others=["uid"], nums=[*temporal_sql(), "phq9_score", "bdi_score"], extra=TEMPORAL_CTE,
)
def user_temporal_features(spark, d):
    return user_table(spark, d, "temporal")


_COMBINED = [*X.tlbs_names(), *static_sql()]


@register(
    "user_combined_features",
    _user_sql("tlbs_f join static_f using (session_id)", _COMBINED),
    others=["uid"], nums=[*_COMBINED, "phq9_score", "bdi_score"],
    extra={**STATIC_CTE, **TLBS_CTE},
)
def user_combined_features(spark, d):
    return user_table(spark, d, "tlbs")


@register(
    "user_targets",
    """
select uid, phq9_score, bdi_score, (phq9_score >= 10)::int as phq9_depressed,
  (bdi_score >= 14)::int as bdi_depressed,
  case when phq9_score >= 20 then 1 when phq9_score <= 4 then 0 end as phq9_extreme,
  case when bdi_score >= 29 then 1 when bdi_score <= 13 then 0 end as bdi_extreme,
  case when phq9_score <= 4 then 0 when phq9_score <= 9 then 1 when phq9_score <= 14 then 2
       when phq9_score <= 19 then 3 when phq9_score is not null then 4 end as phq9_severity_class,
  case when bdi_score <= 13 then 0 when bdi_score <= 19 then 1 when bdi_score <= 28 then 2
       when bdi_score is not null then 3 end as bdi_severity_class
from (select uid, avg(phq9_score) as phq9_score, avg(bdi_score) as bdi_score from forms group by uid)
""",
    others=["uid", "phq9_depressed", "bdi_depressed", "phq9_extreme", "bdi_extreme",
            "phq9_severity_class", "bdi_severity_class"],
    nums=["phq9_score", "bdi_score"],
)
def user_targets(spark, d):
    return P.targets(X.user_means(I.forms(spark, d), P.SCORES))


_THEORY = X.THEORY_STATIC


@register(
    "model_rows",
    "select uid, phq9_score, "
    + ", ".join(f"coalesce({c}, 0) as {c}" for c in _THEORY)
    + " from user_static where phq9_score is not null and bdi_score is not null",
    others=["uid"], nums=["phq9_score", *_THEORY], extra=USER_STATIC_CTE,
)
def model_rows(spark, d):
    rows = P.model_rows(user_table(spark, d, "static"), _THEORY, P.SCORES)
    return rows.select("uid", "phq9_score", *_THEORY)


def _set_sql(family: str) -> dict[str, str]:
    """One row per user: the mean of each named feature set, missing features as 0."""
    return {
        f"set_{i}": "(" + " + ".join(f"coalesce({c}, 0)" for c in cols) + f") / {len(cols)}::double"
        for i, cols in enumerate(X.feature_sets(family).values())
    }


def feature_set_means(spark, d, family: str):
    """Means over the columns of each feature set of a family, for users with both scores."""
    rows = P.model_rows(user_table(spark, d, family), _all_of(family), P.SCORES)
    sums = {f"set_{i}": " + ".join(cols) for i, cols in enumerate(X.feature_sets(family).values())}
    sizes = [len(cols) for cols in X.feature_sets(family).values()]
    return rows.selectExpr("uid", *[f"({e}) / {n}D as {name}" for (name, e), n in zip(sums.items(), sizes)])


def _all_of(family: str) -> list[str]:
    return list(dict.fromkeys(c for cols in X.feature_sets(family).values() for c in cols))


def _register_sets(family: str, source: str, cols: list[str], extra: dict[str, str]) -> None:
    sets = _set_sql(family)
    register(
        f"feature_sets_{family}",
        f"select uid, {select(sets)} from ({_user_sql(source, cols)}) where phq9_score is not null and bdi_score is not null",
        others=["uid"], nums=list(sets), extra=extra,
    )(lambda spark, d: feature_set_means(spark, d, family))


_register_sets("static", "static_f", list(static_sql()), STATIC_CTE)
_register_sets("distributional", "distributional_f", list(distributional_sql()), DISTRIBUTIONAL_CTE)
_register_sets("temporal", "temporal_f", list(temporal_sql()), TEMPORAL_CTE)
_register_sets("tlbs", "tlbs_f join static_f using (session_id)", _COMBINED, {**STATIC_CTE, **TLBS_CTE})


@register(
    "feature_missingness",
    "select feature, n_missing, n_rows, rows_with_any from ("
    + " union all ".join(
        f"select '{c}' as feature, count(*) - count({c}) as n_missing from static_f"
        for c in static_sql()
    )
    + ") cross join (select count(*) as n_rows, "
    + "count(*) filter (" + " or ".join(f"{c} is null" for c in static_sql())
    + ") as rows_with_any from static_f)",
    others=["feature", "n_missing", "n_rows", "rows_with_any"], extra=STATIC_CTE,
)
def feature_missingness(spark, d):
    f = X.static_features()
    return X.missingness(f.apply(clean(spark, d)), f.columns, only_missing=False)


@register(
    "trial_positions",
    """
select session_id, scene_index, trial_num,
  case when hi > lo then (trial_num - lo) / (hi - lo)::double else 0 end as trial_norm
from (select *, min(trial_num) over (partition by session_id) as lo,
        max(trial_num) over (partition by session_id) as hi
      from (select *, row_number() over (partition by session_id order by scene_index)
              as trial_num from clean))""",
    others=["session_id", "scene_index", "trial_num"], nums=["trial_norm"],
)
def trial_positions(spark, d):
    rows = P.with_trial_norm(P.trial_numbers(clean(spark, d), block_scenes=8))
    return rows.select("session_id", "scene_index", "trial_num", "trial_norm")


@register(
    "first_bias_signals",
    """
select r.band, r.session_id, scene_index, bias from (
  select *, case when phq9_score <= 4 then 'minimal' when phq9_score <= 14 then 'moderate'
                 else 'severe' end as band, bias_neg_vs_pos as bias
  from clean join forms using (session_id)
  where scene_valence_pair = 'negative_vs_positive' and phq9_score is not null) r
join (select band, session_id, row_number() over (partition by band order by session_id) as n
      from (select distinct session_id, case when phq9_score <= 4 then 'minimal'
              when phq9_score <= 14 then 'moderate' else 'severe' end as band
            from clean join forms using (session_id)
            where scene_valence_pair = 'negative_vs_positive' and phq9_score is not null)) c
  on c.session_id = r.session_id and c.n <= 5""",
    others=["band", "session_id", "scene_index"], nums=["bias"],
)
def first_bias_signals(spark, d):
    return X.first_signals(clean(spark, d), I.forms(spark, d))


@register(
    "pair_valence_long",
    " union all ".join(
        f"select session_id, scene_index, scene_valence_pair, '{out}' as outcome, "
        f"'{v}' as valence, {out}_{v} as y from clean where {out}_{v} is not null "
        f"and scene_valence_pair = '{pair}'"
        for _, out in METRICS[:4] for pair, s in SUFFIX.items() for v in MEMBERS[s]
    ),
    others=["session_id", "scene_index", "scene_valence_pair", "outcome", "valence"], nums=["y"],
)
def pair_valence_long(spark, d):
    from fixatio.operators import mixed

    return mixed.melt_outcomes(clean(spark, d)).select(
        "session_id", "scene_index", "scene_valence_pair", "outcome", "valence", "y"
    )
