"""Events, quality and scene tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fixatio.operators import events as E
from fixatio.operators import prepare as P
from fixatio.operators import scene as S
from fixatio.plans import inputs as I
from fixatio.plans.registry import register

@register(
    "stimuli_table",
    "select * from stim",
    others=["image_id", "folder", "category", "valence", "labels", "url"],
)
def stimuli_table(spark, d):
    return I._stimuli(spark, d).select(
        "image_id", "folder", "category", "valence", F.to_json("labels").alias("labels"), "url"
    )


@register(
    "stimulus_schedule",
    "select * from sched",
    others=["folder", "scene_index", "image_left_id", "image_right_id"],
)
def stimulus_schedule(spark, d):
    return I._schedule(spark, d)


@register(
    "forms_table",
    "select *, try_cast(created_at as timestamp) as created_ts from forms",
    others=["session_id", "uid", "phq9_score", "bdi_score", "phq9_severity", "bdi_severity",
            "cast(created_ts as varchar) as created_ts"],
)
def forms_table(spark, d):
    f = P.with_created_ts(I.forms(spark, d))
    return f.select(
        "session_id", "uid", "phq9_score", "bdi_score", "phq9_severity", "bdi_severity",
        F.date_format("created_ts", "yyyy-MM-dd HH:mm:ss").alias("created_ts"),
    )


@register(
    "sessions_table",
    "select s.session_id, s.folder as test_version, f.uid, f.created_at from "
    "(select distinct session_id, folder from samples) s left join forms f using (session_id)",
    others=["session_id", "test_version", "uid", "created_at"],
)
def sessions_table(spark, d):
    files = I.scene_rows(spark, d).select("session_id", F.col("folder").alias("test_version"))
    return P.sessions_table(files.distinct(), I.forms(spark, d)).withColumnRenamed(
        "createdAt", "created_at"
    )


@register(
    "scene_quality",
    "select * from scene_rows",
    others=["session_id", "folder", "scene_index", "scene_type", "n_samples",
            "n_starts as n_fixation_starts", "scene_quality_valid",
            "coalesce(array_to_string(seen, ','), '') as detected_image_ids"],
    nums=["duration_ms", "blink_ratio", "missing_gaze_ratio"],
)
def scene_quality(spark, d):
    return E.scene_samples(I.samples(spark, d)).select(
        "session_id", "folder", "scene_index", "scene_type", "n_samples", "n_fixation_starts",
        "scene_quality_valid", "detected_image_ids", "duration_ms", "blink_ratio",
        "missing_gaze_ratio",
    )


@register(
    "session_quality",
    "select * from session_q",
    others=["session_id", "total_samples", "n_scenes", "is_valid"],
    nums=["total_duration_ms", "blink_ratio", "missing_gaze_ratio", "mean_sampling_interval_ms",
          "estimated_fps"],
)
def session_quality(spark, d):
    return E.session_quality(E.scene_samples(I.samples(spark, d))).drop("folder")


_FIX_TEXT = ["session_id", "scene_index", "fix_no", "n_samples", "image"]


@register(
    "fixations",
    "select *, t0 as start_timestamp, t1 as end_timestamp, dur as duration_ms from fix",
    others=_FIX_TEXT,
    nums=["start_timestamp", "end_timestamp", "duration_ms", "fpog_x", "fpog_y", "rx", "ry"],
)
def fixations(spark, d):
    return E.extract_fixations(I.samples(spark, d)).drop("onset_ms", "folder")


@register(
    "fixation_pairing",
    "select session_id, scene_index, fix_no, p1 - p0 + 1 as n_samples, t1 - t0 as span_ms "
    "from bounds",
    others=["session_id", "scene_index", "fix_no", "n_samples"],
    nums=["span_ms"],
)
def fixation_pairing(spark, d):
    """Pairing in small blocks, so that most scenes are stitched together from several."""
    f = E.extract_fixations(I.samples(spark, d), block_rows=7)
    return f.select(
        "session_id", "scene_index", "fix_no", "n_samples",
        (F.col("end_timestamp") - F.col("start_timestamp")).alias("span_ms"),
    )


@register(
    "blinks",
    "select *, end_timestamp - start_timestamp as duration_ms from blinks",
    others=["session_id", "scene_index", "blink_no", "n_samples"],
    nums=["start_timestamp", "end_timestamp", "duration_ms"],
)
def blinks(spark, d):
    return E.extract_blinks(I.samples(spark, d)).drop("folder")


@register(
    "image_sides",
    """
select session_id, scene_index,
  coalesce(l, f[1]) as left_image, coalesce(r, case when l is null then f[2] else f[1] end)
    as right_image
from (
  select session_id, scene_index, l, r,
    list_filter(a, lambda x: x is distinct from l and x is distinct from r) as f
  from (select session_id, scene_index, list(image order by first) as a,
          arg_max(image, case when m < 0.5 then first end) as l,
          arg_max(image, case when not coalesce(m < 0.5, false) then first end) as r
        from (select session_id, scene_index, image, min(idx) as first, avg(rx) as m
              from samples where image is not null group by session_id, scene_index, image)
        group by session_id, scene_index))""",
    others=["session_id", "scene_index", "left_image", "right_image"],
)
def image_sides(spark, d):
    return E.image_sides(I.samples(spark, d)).drop("folder")


_LISTS = ["image_ids", "detected_image_ids", "unexpected_detected_images"]
_SCENE_NUMS = [c for c, t in S.SCENE_COLUMNS.items() if t == "double"]
_SCENE_REST = [c for c, t in S.SCENE_COLUMNS.items() if t != "double" and c not in _LISTS]


@register(
    "scene_metrics",
    "select * from scene",
    others=[*_SCENE_REST, *[f"array_to_string({c}, ',') as {c}" for c in _LISTS]],
    nums=_SCENE_NUMS,
)
def scene_metrics(spark, d):
    """The whole path from samples to the wide table, not read from a stored stage."""
    return S.scene_metrics(
        I.samples(spark, d), I.stimuli(spark, d), I.schedule(spark, d),
        fixations=I.fixations(spark, d), scene_rows=I.scene_rows(spark, d),
    )


@register(
    "transition_matrix",
    "select * from transitions",
    others=["session_id", "scene_index", "from_aoi", "to_aoi", "n"],
)
def transition_matrix(spark, d):
    near = S.with_neighbour(I.fixations(spark, d))
    return S.transition_counts(near, I.scenes(spark, d)).drop("folder")


@register(
    "image_metrics",
    "select *, dwell as dwell_time_ms, ttff as ttff_ms, early as dwell_time_500ms from img_rows",
    others=["session_id", "scene_index", "image", "cnt as fixation_count",
            "revisits::bigint as revisit_count"],
    nums=["dwell_time_ms", "ttff_ms", "dwell_time_500ms"],
)
def image_metrics(spark, d):
    """All fixated images, also those no schedule lists; small blocks to exercise stitching."""
    return S.image_metrics(S.with_neighbour(I.fixations(spark, d), block_rows=2)).drop("folder")


@register(
    "scanpath",
    "select session_id, scene_index, coalesce(path, 0) as scanpath_length, "
    "case when steps > 0 then path / steps end as mean_saccade_amplitude, "
    "greatest(0, n - 1) as saccade_count, mean_dur as mean_fixation_duration_ms, "
    "total_dur as total_fixation_duration_ms, f.first_image as first_fixation_image, "
    "first_dur as first_fixation_duration_ms "
    "from fix_scene f left join paths using (session_id, scene_index)",
    others=["session_id", "scene_index", "saccade_count", "first_fixation_image"],
    nums=["scanpath_length", "mean_saccade_amplitude", "mean_fixation_duration_ms",
          "total_fixation_duration_ms", "first_fixation_duration_ms"],
)
def scanpath(spark, d):
    m = S.general_metrics(I.fixations(spark, d), block_rows=2)
    return m.drop("folder", "fixation_count", "on_image_ms")
