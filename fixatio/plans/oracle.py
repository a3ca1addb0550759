"""The same results as plain SQL over the source tables, for an independent check.

Written with whole-scene windows and range joins rather than the block-wise Spark plans.
"""

from __future__ import annotations

import re

CTES: dict[str, str] = {}

CTES["numbered"] = r"""
select *, row_number() over (partition by sid order by ts, event_id) - 1 as idx
from (select event_id, ts, user_id // 10 as sid, event_type, value,
             cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k from events)"""

CTES["stim"] = """
select 'img_' || p_partkey as image_id, p_partkey, folder, 'img://' || p_partkey as url,
  case when p_type in ('STANDARD', 'MEDIUM') then 'neutral' else 'stimulus' end as category,
  case when split_part(p_name, ' ', 1) in ('cold', 'old', 'small', 'blue')
       then '["Sad","' else '["Happy Face","' end || split_part(p_name, ' ', 2) || '"]' as labels,
  case when p_type in ('STANDARD', 'MEDIUM') then 'neutral'
       when split_part(p_name, ' ', 1) in ('cold', 'old', 'small', 'blue') then 'negative'
       else 'positive' end as valence
from part cross join (values ('set_0'), ('set_1'), ('set_2'), ('set_3')) f(folder)"""

CTES["stim_rank"] = """
select *, row_number() over (partition by folder, valence order by p_partkey) - 1 as p from stim"""

CTES["sched"] = """
select folder, cast(2 * p + 1 as int) as scene_index,
  case when p % 3 = 2 then neu else neg end as image_left_id,
  case when p % 3 = 1 then neu else pos end as image_right_id
from (select folder, p, max(case when valence = 'negative' then image_id end) as neg,
             max(case when valence = 'positive' then image_id end) as pos,
             max(case when valence = 'neutral' then image_id end) as neu
      from stim_rank group by folder, p)
where (case when p % 3 = 2 then neu else neg end) is not null
  and (case when p % 3 = 1 then neu else pos end) is not null"""

CTES["samples"] = """
select cast(n.sid as varchar) as session_id, 'set_' || (n.sid % 4) as folder, n.idx,
  cast(64 * n.idx as double) as t, n.k % 4 as fev, cast(64 * (1 + n.k % 5) as double) as fdur,
  case when n.k % 7 <> 0 then n.k / 100.0::double end as fpogx,
  case when n.k % 7 <> 0 then (cast(floor(n.value) as bigint) % 100) / 100.0::double end as fpogy,
  case when n.event_type <> 'error' and n.k % 10 <> 0 then n.k / 100.0::double end as rx,
  case when n.event_type <> 'error' and n.k % 10 <> 0
       then (cast(floor(n.value) as bigint) % 100) / 100.0::double end as ry,
  n.event_type = 'error' as blink,
  cast(2 * (n.idx // 30) + case when n.idx % 30 < 24 then 1 else 2 end as int) as scene_index,
  case when n.k = 98 then 'img_stray' when n.k % 3 = 0 then s.image_left_id
       when n.k % 3 = 1 then s.image_right_id end as image
from numbered n left join sched s
  on s.folder = 'set_' || (n.sid % 4) and s.scene_index = 2 * (n.idx // 30) + 1"""

CTES["forms"] = """
select cast(c_custkey as varchar) as session_id, 'u' || (c_custkey // 2) as uid,
  case when c_acctbal >= 0 then w % 28 end as phq9_score, (w // 28) % 64 as bdi_score,
  case when c_acctbal < 0 then 'unknown'
       else cast(cast(date '2024-01-01' + cast(c_custkey % 365 as int) as date) as varchar)
  end as created_at,
  case when c_acctbal < 0 then null when w % 28 <= 4 then 'minimal' when w % 28 <= 9 then 'mild'
       when w % 28 <= 14 then 'moderate' when w % 28 <= 19 then 'moderately_severe'
       else 'severe' end as phq9_severity,
  case when (w // 28) % 64 <= 13 then 'minimal' when (w // 28) % 64 <= 19 then 'mild'
       when (w // 28) % 64 <= 28 then 'moderate' else 'severe' end as bdi_severity
from (select *, cast(floor(abs(c_acctbal)) as bigint) as w from customer)"""

CTES["scene_rows"] = """
select session_id, folder, scene_index, count(*) as n_samples,
  case when count(*) < 2 then 0.0 else max(t) - min(t) end as duration_ms,
  min(t) as t_min, max(t) as t_max, sum(blink::int) as n_blink,
  count(*) - count(rx) as n_missing, count(case when fev = 1 then 1 end) as n_starts,
  arg_min(t, idx) as onset, list_sort(list(distinct image) filter (image is not null)) as seen,
  sum(blink::int)::double / count(*) as blink_ratio,
  (count(*) - count(rx))::double / count(*) as missing_gaze_ratio,
  case when scene_index % 2 <> 0 then 'stimulus' else 'fixation_cross' end as scene_type,
  count(*) >= 20 and max(t) - min(t) >= 1000
    and (count(*) - count(rx))::double / count(*) < 0.4
    and sum(blink::int)::double / count(*) < 0.4
    and count(case when fev = 1 then 1 end) >= 1 as scene_quality_valid
from samples group by session_id, folder, scene_index"""

CTES["session_q"] = """
select session_id, count(*) as total_samples, max(t) - min(t) as total_duration_ms,
  avg(blink::int) as blink_ratio, (count(*) - count(rx))::double / count(*) as missing_gaze_ratio,
  count(distinct scene_index) as n_scenes,
  (arg_max(t, idx) - arg_min(t, idx)) / (count(*) - 1) as mean_sampling_interval_ms,
  1000.0 / ((arg_max(t, idx) - arg_min(t, idx)) / (count(*) - 1)) as estimated_fps,
  count(*) >= 200 and max(t) - min(t) >= 30000
    and (count(*) - count(rx))::double / count(*) < 0.5
    and count(distinct scene_index) >= 10 as is_valid
from samples group by session_id"""

CTES["marked"] = """
select *, e - greatest(0, max(e - s) over (partition by session_id, scene_index order by pos)) as u,
  e - fev_e - greatest(0, coalesce(max(e - s) over (partition by session_id, scene_index
      order by pos rows between unbounded preceding and 1 preceding), 0)) as u_before
from (select *, (fev = 3)::int as fev_e,
        row_number() over w as pos,
        sum((fev = 1)::int) over w as s, sum((fev = 3)::int) over w as e
      from samples window w as (partition by session_id, scene_index order by idx))"""

CTES["bounds"] = """
select a.session_id, a.scene_index, a.no as fix_no, a.pos as p0, b.pos as p1, a.t as t0, b.t as t1,
  b.fdur as dur
from (select session_id, scene_index, s as no, pos, t from marked where fev = 1) a
join (select session_id, scene_index, u as no, pos, t, fdur from marked
      where fev = 3 and u > u_before) b using (session_id, scene_index, no)"""

CTES["fix"] = """
select x.session_id, x.scene_index, x.fix_no, any_value(x.t0) as t0, any_value(x.t1) as t1,
  any_value(x.dur) as dur, avg(m.fpogx) as fpog_x, avg(m.fpogy) as fpog_y, avg(m.rx) as rx,
  avg(m.ry) as ry, count(*) as n_samples, any_value(i.image) as image
from bounds x join marked m on m.session_id = x.session_id and m.scene_index = x.scene_index
  and m.pos between x.p0 and x.p1
left join (
  select session_id, scene_index, fix_no, image from (
    select x.session_id, x.scene_index, x.fix_no, m.image, row_number() over (
      partition by x.session_id, x.scene_index, x.fix_no order by count(*) desc, min(m.pos)) as r
    from bounds x join marked m on m.session_id = x.session_id
      and m.scene_index = x.scene_index and m.pos between x.p0 and x.p1
    where m.image is not null
    group by x.session_id, x.scene_index, x.fix_no, m.image) where r = 1) i
  on i.session_id = x.session_id and i.scene_index = x.scene_index and i.fix_no = x.fix_no
group by x.session_id, x.scene_index, x.fix_no"""

CTES["blinks"] = """
select session_id, scene_index, run as blink_no, min(t) filter (blink) as start_timestamp,
  coalesce(max(t) filter (not blink), max(t) filter (blink)) as end_timestamp,
  count(*) filter (blink) - (count(*) filter (not blink) = 0)::int as n_samples
from (select *, sum((blink and not pb)::int) over (partition by session_id, scene_index
             order by idx) as run
      from (select *, coalesce(lag(blink) over (partition by session_id, scene_index
                   order by idx), false) as pb from samples))
where blink or pb group by session_id, scene_index, run"""

CTES["shown"] = """
select r.*, s.image_left_id, s.image_right_id, s.image_left_id is not null as schedule_provided,
  case when s.image_left_id is not null then [s.image_left_id, s.image_right_id]
       else coalesce(r.seen, []) end as images
from scene_rows r join session_q q on q.session_id = r.session_id and q.is_valid
left join sched s on s.folder = r.folder and s.scene_index = r.scene_index"""

CTES["slots"] = """
select h.session_id, h.scene_index, h.folder, h.onset, h.slot, h.image,
  coalesce(s.valence, 'unknown') as valence
from (select session_id, scene_index, folder, onset, unnest(images) as image,
             generate_subscripts(images, 1) - 1 as slot from shown) h
left join stim s on s.folder = h.folder and s.image_id = h.image"""

CTES["img_rows"] = """
select f.session_id, f.scene_index, f.image, coalesce(sum(dur), 0) as dwell, count(*) as cnt,
  sum((f.image is distinct from prev)::int) - 1 as revisits, arg_min(t0, fix_no) - any_value(onset) as ttff,
  sum(greatest(least(t1, onset + 500) - greatest(t0, onset), 0)) as early
from (select *, lag(image) over (partition by session_id, scene_index order by fix_no) as prev
      from fix) f join scene_rows r using (session_id, scene_index)
where f.image is not null group by f.session_id, f.scene_index, f.image"""

CTES["slot_metrics"] = """
select s.*, coalesce(i.dwell, 0) as dwell, coalesce(i.cnt, 0) as cnt,
  coalesce(i.revisits, 0) as revisits, i.ttff, coalesce(i.early, 0) as early,
  case when t.total > 0 then coalesce(i.dwell, 0) / t.total else 0 end as prop,
  t.first_image, coalesce(t.n, 0) > 0 as looked
from slots s left join img_rows i using (session_id, scene_index, image)
left join (select session_id, scene_index, count(*) as n,
             sum(case when image is not null then dur end) as total,
             arg_min(image, case when image is not null then fix_no end) as first_image
           from fix group by session_id, scene_index) t using (session_id, scene_index)"""


def _valence_columns() -> str:
    cols = []
    for v in ("negative", "positive", "neutral"):
        mine = f"valence = '{v}'"
        for out, src in (("dwell_time_ms", "dwell"), ("fixation_count", "cnt"),
                         ("fixation_proportion", "prop"), ("revisit_count", "revisits"),
                         ("dwell_time_500ms", "early")):
            cols.append(f"sum({src}::double) filter ({mine} and looked) as {out}_{v}")
        cols.append(
            f"case when arg_min(coalesce(ttff, -1), slot) filter ({mine}) >= 0 "
            f"then min(ttff) filter ({mine}) end as ttff_ms_{v}"
        )
    for suffix, a, b in (("neg_vs_pos", "negative", "positive"),
                         ("neg_vs_neu", "negative", "neutral"),
                         ("pos_vs_neu", "positive", "neutral")):
        sa = f"sum(dwell) filter (valence = '{a}')"
        sb = f"sum(dwell) filter (valence = '{b}')"
        cols.append(
            f"case when {sa} + {sb} > 0 then ({sa} - {sb}) / ({sa} + {sb}) end as bias_{suffix}"
        )
    for i in (0, 1):
        here = f"filter (slot = {i})"
        cols += [f"max(image) {here} as image_id_img{i}", f"max(valence) {here} as valence_img{i}"]
        for out, src in (("dwell_time_ms", "dwell"), ("fixation_count", "cnt"),
                         ("fixation_proportion", "prop"), ("revisit_count", "revisits"),
                         ("ttff_ms", "ttff")):
            cols.append(f"max({src}::double) {here} as {out}_img{i}")
    return ",\n  ".join(cols)


CTES["valence_part"] = f"""
select session_id, scene_index, {_valence_columns()},
  array_to_string(list_sort(list(distinct valence)), '_vs_') as scene_valence_pair,
  max(case when image = first_image then valence end) as first_fixation_valence
from slot_metrics group by session_id, scene_index"""

CTES["paths"] = """
select session_id, scene_index, sum(d) as path, count(*) - 1 as steps
from (select session_id, scene_index,
        sqrt(power(rx - lag(rx) over w, 2) + power(ry - lag(ry) over w, 2)) as d
      from fix where rx is not null and ry is not null
      window w as (partition by session_id, scene_index order by fix_no))
group by session_id, scene_index"""

CTES["fix_scene"] = """
select session_id, scene_index, count(*) as n, avg(dur) as mean_dur, sum(dur) as total_dur,
  arg_min(image, case when image is not null then fix_no end) as first_image,
  arg_min(dur, case when image is not null then fix_no end) as first_dur
from fix group by session_id, scene_index"""

CTES["transitions"] = """
select session_id, scene_index,
  case when list_contains(images, prev) then prev else 'other' end as from_aoi,
  case when list_contains(images, image) then image else 'other' end as to_aoi, count(*) as n
from (select *, lag(image) over w as prev, row_number() over w as r from fix
      window w as (partition by session_id, scene_index order by fix_no))
join shown using (session_id, scene_index) where r > 1
group by all"""

CTES["trans_scene"] = """
select session_id, scene_index, count(*) as cells, -sum(p * log2(p)) as h
from (select *, n / sum(n) over (partition by session_id, scene_index, from_aoi) as p
      from transitions) group by session_id, scene_index"""

CTES["scene"] = """
select h.session_id, h.folder, h.scene_index, h.scene_type, h.images as image_ids,
  len(h.images) as n_images, h.duration_ms, h.n_samples, h.scene_quality_valid, h.blink_ratio,
  h.missing_gaze_ratio, h.schedule_provided, coalesce(h.seen, []) as detected_image_ids,
  case when h.schedule_provided
       then list_sort(list_filter(coalesce(h.seen, []), lambda x: not list_contains(h.images, x)))
       else [] end as unexpected_detected_images,
  h.image_left_id, h.image_right_id,
  case when h.schedule_provided then v.valence_img0 end as valence_left,
  case when h.schedule_provided then v.valence_img1 end as valence_right,
  coalesce(f.n, 0)::double as fixation_count, f.mean_dur as mean_fixation_duration_ms,
  coalesce(f.total_dur, 0)::double as total_fixation_duration_ms,
  case when h.duration_ms > 0 then coalesce(f.n, 0) / (h.duration_ms / 1000) end as fixation_rate_per_sec,
  f.first_dur as first_fixation_duration_ms, coalesce(p.path, 0)::double as scanpath_length,
  greatest(0, coalesce(f.n, 0) - 1)::double as saccade_count,
  case when h.duration_ms > 0 then greatest(0, coalesce(f.n, 0) - 1) / (h.duration_ms / 1000) end
    as saccade_rate_per_sec,
  case when p.steps > 0 then p.path / p.steps end as mean_saccade_amplitude,
  coalesce(b.n, 0)::double as blink_count,
  case when h.duration_ms > 0 then coalesce(b.n, 0) / (h.duration_ms / 60000) end
    as blink_rate_per_min,
  case when len(h.images) > 0
       then coalesce(x.cells, 0) / ((len(h.images) + 1) * (len(h.images) + 1))::double end
    as transition_matrix_density,
  case when len(h.images) > 0 then coalesce(x.h, 0)::double end as gaze_transition_entropy,
  f.first_image as first_fixation_image,
  v.* exclude (session_id, scene_index)
from shown h
left join fix_scene f using (session_id, scene_index)
left join paths p using (session_id, scene_index)
left join (select session_id, scene_index, count(*) as n from blinks
           group by session_id, scene_index) b using (session_id, scene_index)
left join trans_scene x using (session_id, scene_index)
left join valence_part v using (session_id, scene_index)"""

CTES["clean"] = """
select * from scene where scene_type = 'stimulus' and scene_quality_valid
  and scene_valence_pair in ('negative_vs_positive', 'negative_vs_neutral', 'neutral_vs_positive')
  and duration_ms between 500 and 10000"""


#: Suppliers dealt to five folds one by one, largest first, each to the first lightest fold.
SUPPLIER_FOLDS = """
with recursive g as (
  select l_suppkey, n, row_number() over (order by n desc, md5(cast(l_suppkey as varchar)), l_suppkey) as i
  from (select l_suppkey, count(*) as n from lineitem group by l_suppkey)
), dealt(i, l_suppkey, fold, loads) as (
  select 0::bigint, null::bigint, null::int, [0, 0, 0, 0, 0]::bigint[]
  union all
  select g.i, g.l_suppkey, list_position(loads, list_min(loads)) - 1,
    [loads[f + 1] + case when f + 1 = list_position(loads, list_min(loads)) then g.n else 0 end for f in range(5)]
  from dealt d join g on g.i = d.i + 1
) select l_suppkey, fold from dealt where i > 0"""


def sql(final: str, extra: dict[str, str] | None = None) -> str:
    """A statement with just the CTEs it needs, in order."""
    ctes = {**CTES, **(extra or {})}
    names = re.compile(r"\b(" + "|".join(ctes) + r")\b")
    need: list[str] = []

    def visit(text: str) -> None:
        for name in names.findall(text):
            if name not in need and ctes[name] is not text:
                visit(ctes[name])
                if name not in need:
                    need.append(name)

    visit(final)
    if not need:
        return final
    body = ",\n".join(f"{n} as ({ctes[n].strip()})" for n in need)
    return f"with {body}\n{final.strip()}"


def rounded(name: str, digits: int) -> str:
    """Rounded double under its own name; the same rounding as on the Spark side."""
    return f"round({name}::double, {digits}) + 0.0 as {name}"


def significant(name: str) -> str:
    """A double to seven significant digits, as text; the same form as on the Spark side.

    The factor moves decimals that stand exactly between two digits off that place."""
    return f"printf('%.6e', {name}::double * 1.0000000037::double + 0.0) as {name}"
