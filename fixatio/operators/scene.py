"""Attention metrics of one scene, from its fixations.

Fixations are numbered 1.. inside a scene, so position alone says where a block of
them ends. The last row of each block is repeated at the head of the next one, which
gives every row its predecessor without any single task seeing the whole scene.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixatio import model as M
from fixatio.functions import columns as C
from fixatio.operators import events as E
from fixatio.operators.blocks import UNB

KEY = M.SCENE_KEY
FIX_BLOCK = 1 << 17


def with_neighbour(fixations: DataFrame, block_rows: int = FIX_BLOCK) -> DataFrame:
    """Add ``has_prev`` and ``prev_image``: the fixation before, in the scene."""
    own = F.floor((F.col("fix_no") - 1) / F.lit(block_rows)).cast("long")
    copies = F.when(F.col("fix_no") % block_rows == 0, F.array(own, own + 1)).otherwise(
        F.array(own)
    )
    w = Window.partitionBy(*KEY, "_blk").orderBy("fix_no")
    return (
        fixations.withColumn("_own", own)
        .withColumn("_blk", F.explode(copies))
        .withColumn("has_prev", F.lag("fix_no").over(w).isNotNull())
        .withColumn("prev_image", F.lag("image").over(w))
        .filter(F.col("_blk") == F.col("_own"))
        .drop("_own")
    )


def general_metrics(fixations: DataFrame, block_rows: int = FIX_BLOCK) -> DataFrame:
    """Counts, durations, scanpath and first fixated image per scene (scenes with fixations)."""
    own = F.floor((F.col("fix_no") - 1) / F.lit(block_rows)).cast("long")
    w = Window.partitionBy(*KEY, "_blk").orderBy("fix_no").rowsBetween(UNB, -1)
    point = F.when(
        F.col("rx").isNotNull() & F.col("ry").isNotNull(), F.struct("rx", "ry", "fix_no")
    )
    rows = (
        fixations.withColumn("_blk", own)
        .withColumn("_p", point)
        .withColumn("_q", F.last("_p", ignorenulls=True).over(w))
    )
    by_image = F.when(F.col("image").isNotNull(), F.col("fix_no"))
    by_point = F.when(F.col("_p").isNotNull(), F.col("fix_no"))
    blocks = rows.groupBy(*KEY, "_blk").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("duration_ms").alias("dur"),
        F.sum(F.when(F.col("image").isNotNull(), F.col("duration_ms"))).alias("on_image"),
        F.count("duration_ms").alias("n_dur"),
        F.sum(distance("_p", "_q")).alias("path"),
        F.count("_p").alias("n_points"),
        F.min_by("_p", by_point).alias("head"),
        F.max_by("_p", by_point).alias("tail"),
        F.min(by_image).alias("ff"),
        F.min_by("image", by_image).alias("ff_image"),
        F.min_by("duration_ms", by_image).alias("ff_dur"),
    )
    across = Window.partitionBy(*KEY).orderBy("_blk").rowsBetween(UNB, -1)
    joined = blocks.withColumn("_q", F.last("tail", ignorenulls=True).over(across))
    return (
        joined.groupBy(*KEY)
        .agg(
            F.sum("n").alias("fixation_count"),
            C.ratio(F.sum("dur"), F.sum("n_dur")).alias("mean_fixation_duration_ms"),
            F.coalesce(F.sum("dur"), F.lit(0.0)).alias("total_fixation_duration_ms"),
            (
                F.coalesce(F.sum("path"), F.lit(0.0))
                + F.coalesce(F.sum(distance("head", "_q")), F.lit(0.0))
            ).alias("scanpath_length"),
            (F.sum("n_points") - 1).alias("_steps"),
            F.sum("on_image").alias("on_image_ms"),
            F.min_by("ff_image", "ff").alias("first_fixation_image"),
            F.min_by("ff_dur", "ff").alias("first_fixation_duration_ms"),
        )
        .withColumn("saccade_count", F.greatest(F.lit(0), F.col("fixation_count") - 1))
        .withColumn("mean_saccade_amplitude", C.ratio("scanpath_length", "_steps"))
        .drop("_steps")
    )


def distance(a: str, b: str) -> Column:
    dx = F.col(f"{a}.rx") - F.col(f"{b}.rx")
    dy = F.col(f"{a}.ry") - F.col(f"{b}.ry")
    return F.sqrt(dx * dx + dy * dy)


def image_metrics(neighbours: DataFrame, epoch_ms: float = M.EARLY_EPOCH_MS) -> DataFrame:
    """Dwell, counts, revisits, first look and early dwell per fixated image of a scene."""
    new_visit = ~F.col("image").eqNullSafe(F.col("prev_image"))
    return (
        neighbours.filter(F.col("image").isNotNull())
        .groupBy(*KEY, "image")
        .agg(
            F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("dwell_time_ms"),
            F.count(F.lit(1)).alias("fixation_count"),
            (F.sum(new_visit.cast("long")) - 1).alias("revisit_count"),
            F.min_by(F.col("start_timestamp") - F.col("onset_ms"), "fix_no").alias("ttff_ms"),
            F.sum(overlap("start_timestamp", "end_timestamp", "onset_ms", epoch_ms)).alias(
                "dwell_time_500ms"
            ),
        )
    )


def overlap(start: str, end: str, onset: str, length: float) -> Column:
    """Length of the part of [start, end] inside [onset, onset + length]."""
    part = F.least(F.col(end), F.col(onset) + length) - F.greatest(F.col(start), F.col(onset))
    return F.greatest(part, F.lit(0.0))


def transition_counts(neighbours: DataFrame, scene_images: DataFrame) -> DataFrame:
    """Long transition matrix of each scene: counts by (from_aoi, to_aoi), ``other`` included."""
    steps = (
        neighbours.filter("has_prev")
        .groupBy(*KEY, F.col("prev_image").alias("f"), F.col("image").alias("t"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(scene_images.select(*KEY, "image_ids"), KEY)
    )

    def aoi(c):
        known = F.array_contains("image_ids", F.col(c))
        return F.when(known, F.col(c)).otherwise("other")

    return steps.groupBy(*KEY, aoi("f").alias("from_aoi"), aoi("t").alias("to_aoi")).agg(
        F.sum("n").alias("n")
    )


def transition_metrics(transitions: DataFrame) -> DataFrame:
    """Non-zero cells and entropy per scene.

    Per row of the matrix with total T: -sum p log2 p = log2 T - (sum n log2 n) / T.
    """
    rows = transitions.groupBy(*KEY, "from_aoi").agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("n").alias("t"),
        F.sum(F.col("n") * F.log2("n")).alias("q"),
    )
    return rows.groupBy(*KEY).agg(
        F.sum("cells").alias("transition_cells"),
        F.sum(F.log2("t") - F.col("q") / F.col("t")).alias("_h"),
    )


def shown_images(
    scenes: DataFrame, schedule: DataFrame | None
) -> DataFrame:
    """Images of each scene: the scheduled pair if there is one, else those seen."""
    if schedule is None:
        rows = scenes.withColumn("image_left_id", F.lit(None).cast("string")).withColumn(
            "image_right_id", F.lit(None).cast("string")
        )
    else:
        plan = schedule.select("folder", "scene_index", "image_left_id", "image_right_id")
        rows = scenes.join(plan, ["folder", "scene_index"], "left")
    given = F.col("image_left_id").isNotNull() | F.col("image_right_id").isNotNull()
    pair = F.array_compact(F.array("image_left_id", "image_right_id"))
    return (
        rows.withColumn("schedule_provided", given)
        .withColumn("image_ids", F.when(given, pair).otherwise(F.col("detected_image_ids")))
        .withColumn(
            "unexpected_detected_images",
            F.when(given, F.sort_array(F.array_except("detected_image_ids", pair))).otherwise(
                F.array().cast("array<string>")
            ),
        )
        .withColumn("n_images", F.size("image_ids"))
    )


def with_valence(df: DataFrame, stimuli: DataFrame, image: str, out: str) -> DataFrame:
    """Look up an image's valence in its folder; images without an entry are ``unknown``."""
    lookup = stimuli.select("folder", F.col("image_id").alias(image), F.col("valence").alias(out))
    return df.join(lookup, ["folder", image], "left").withColumn(
        out, F.coalesce(out, F.when(F.col(image).isNotNull(), F.lit("unknown")))
    )


_PER_IMAGE = ["dwell_time_ms", "fixation_count", "fixation_proportion", "revisit_count"]


def valence_columns() -> list[Column]:
    """Aggregates for the per-valence, per-slot and bias columns of each scene.

    They fold one row per scene and shown image, with its position, valence, the image's
    metrics (NULL if never fixated), the scene's first fixated image and whether the scene
    has any fixation.
    """
    looked = F.col("has_fixations")
    out = []
    present = {v: F.max((F.col("valence") == v).cast("int")) for v in M.VALENCES}
    any_fix = F.max(looked.cast("int")) == 1

    def total(metric, v):
        return F.sum(F.when(F.col("valence") == v, F.coalesce(metric, F.lit(0))).cast("double"))

    for v in M.VALENCES:
        mine = F.col("valence") == v
        for m in _PER_IMAGE:
            out.append(F.when(any_fix, total(m, v)).alias(f"{m}_{v}"))
        # A first shown image that was never looked at leaves the whole valence unseen.
        first_seen = F.min_by("ttff_ms", F.when(mine, F.col("slot")))
        best = F.min(F.when(mine, F.col("ttff_ms")))
        out.append(F.when(first_seen.isNotNull(), best).alias(f"ttff_ms_{v}"))
        out.append(
            F.when(any_fix & (present[v] == 1), total("dwell_time_500ms", v)).alias(
                f"dwell_time_500ms_{v}"
            )
        )
    for pair, (a, b) in {
        "neg_vs_pos": ("negative", "positive"),
        "neg_vs_neu": ("negative", "neutral"),
        "pos_vs_neu": ("positive", "neutral"),
    }.items():
        da, db = total("dwell_time_ms", a), total("dwell_time_ms", b)
        out.append(F.when(da + db > 0, (da - db) / (da + db)).alias(f"bias_{pair}"))
    for i in (0, 1):
        here = F.col("slot") == i

        def at(c, zero=False, here=here):
            value = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if zero else F.col(c)
            return F.max(F.when(here, value))

        out += [at("image").alias(f"image_id_img{i}"), at("valence").alias(f"valence_img{i}")]
        out += [at(m, zero=True).alias(f"{m}_img{i}") for m in _PER_IMAGE]
        out.append(at("ttff_ms").alias(f"ttff_ms_img{i}"))
    label = F.array_join(F.sort_array(F.collect_set("valence")), "_vs_")
    out += [
        label.alias("scene_valence_pair"),
        F.max(
            F.when(F.col("image") == F.col("first_fixation_image"), F.col("valence"))
        ).alias("first_fixation_valence"),
    ]
    return out


def scene_metrics(
    samples: DataFrame,
    stimuli: DataFrame | None = None,
    schedule: DataFrame | None = None,
    gates: M.Gates = M.Gates(),
    fixations: DataFrame | None = None,
    scene_rows: DataFrame | None = None,
    block_rows: int = M.BLOCK_ROWS,
    keep_invalid_sessions: bool = False,
) -> DataFrame:
    """The wide scene table: one row per scene of every session that passes its gate.

    ``fixations`` and ``scene_rows`` (see :func:`events.scene_samples`) are read several
    times; give them as stored tables where the samples are many.
    """
    if fixations is None:
        fixations = E.extract_fixations(samples, block_rows)
    if scene_rows is None:
        scene_rows = E.scene_samples(samples, gates)
    scenes = scene_rows
    if not keep_invalid_sessions:
        valid = E.session_quality(scene_rows, gates).filter("is_valid")
        scenes = scene_rows.join(valid, ["session_id", "folder"], "left_semi")
    shown = shown_images(scenes, schedule)
    near = with_neighbour(fixations)
    base = (
        shown.join(general_metrics(fixations), KEY, "left")
        .join(E.blink_counts(samples, block_rows), KEY, "left")
        .fillna(
            0,
            ["fixation_count", "total_fixation_duration_ms", "scanpath_length", "saccade_count",
             "blink_count"],
        )
    )
    # One row per shown image that carries its scene along, so that the scene is put
    # together in one go; a scene without images keeps one row.
    slots = base.select(
        *KEY, "first_fixation_image", "on_image_ms",
        (F.col("fixation_count") > 0).alias("has_fixations"),
        F.struct(*[c for c in base.columns if c not in KEY]).alias("scene"),
        F.posexplode_outer("image_ids").alias("slot", "image"),
    ).join(image_metrics(near), [*KEY, "image"], "left")
    share = C.ratio("dwell_time_ms", "on_image_ms")
    slots = slots.withColumn("fixation_proportion", F.coalesce(share, F.lit(0.0)))
    if stimuli is None:
        unknown = F.when(F.col("image").isNotNull(), F.lit("unknown"))
        slots = slots.withColumn("valence", unknown)
    else:
        slots = with_valence(slots, stimuli, "image", "valence")
    whole = slots.groupBy(*KEY).agg(F.first("scene").alias("scene"), *valence_columns())
    images = F.col("scene.n_images")
    seconds = F.col("duration_ms") / 1000.0
    cells = (images + 1) * (images + 1)
    wide = (
        whole.join(transition_metrics(transition_counts(near, shown)), KEY, "left")
        .withColumn(
            "transition_matrix_density",
            F.when(images > 0, F.coalesce("transition_cells", F.lit(0)) / cells),
        )
        .withColumn(
            "gaze_transition_entropy", F.when(images > 0, F.coalesce("_h", F.lit(0.0)) + 0.0)
        )
        .withColumn("scene_valence_pair", F.when(images > 0, F.col("scene_valence_pair")))
        .select("*", "scene.*")
        .withColumns({
            "fixation_rate_per_sec": C.ratio("fixation_count", seconds),
            "saccade_rate_per_sec": C.ratio("saccade_count", seconds),
            "blink_rate_per_min": C.ratio("blink_count", seconds / 60),
            "valence_left": F.when(F.col("schedule_provided"), F.col("valence_img0")),
            "valence_right": F.when(F.col("schedule_provided"), F.col("valence_img1")),
        })
    )
    return wide.selectExpr(*[f"cast(`{c}` as {t}) as `{c}`" for c, t in SCENE_COLUMNS.items()])


def _scene_columns() -> dict[str, str]:
    text, num, ids = "string", "double", "array<string>"
    cols = {
        "session_id": "string", "folder": text, "scene_index": "int", "scene_type": text,
        "image_ids": ids, "n_images": "int", "duration_ms": num, "n_samples": "long",
        "scene_quality_valid": "boolean", "blink_ratio": num, "missing_gaze_ratio": num,
        "schedule_provided": "boolean", "detected_image_ids": ids,
        "unexpected_detected_images": ids, "image_left_id": text, "image_right_id": text,
        "valence_left": text, "valence_right": text,
    }
    cols |= {c: num for c in GENERAL}
    cols |= {"first_fixation_image": text, "first_fixation_valence": text,
             "scene_valence_pair": text}
    cols |= {c: num for c in M.BIASES}
    for v in M.VALENCES:
        cols |= {f"{m}_{v}": num for m in VALENCE_METRICS}
    for i in (0, 1):
        cols |= {f"image_id_img{i}": text, f"valence_img{i}": text}
        cols |= {f"{m}_img{i}": num for m in [*_PER_IMAGE, "ttff_ms"]}
    return cols


GENERAL = [
    "fixation_count", "mean_fixation_duration_ms", "total_fixation_duration_ms",
    "fixation_rate_per_sec", "first_fixation_duration_ms", "scanpath_length", "saccade_count",
    "saccade_rate_per_sec", "mean_saccade_amplitude", "blink_count", "blink_rate_per_min",
    "transition_matrix_density", "gaze_transition_entropy",
]
VALENCE_METRICS = [*_PER_IMAGE, "ttff_ms", "dwell_time_500ms"]
SCENE_COLUMNS = _scene_columns()
