"""Filters, derived columns and joins that every analysis shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixatio import model as M
from fixatio.functions import columns as C
from fixatio.operators import blocks as B

SCORES = ["phq9_score", "bdi_score"]


def stimulus_trials(scenes: DataFrame) -> DataFrame:
    """Stimulus scenes of the three pair kinds, whatever their quality."""
    return scenes.filter(
        (F.col("scene_type") == "stimulus") & F.col("scene_valence_pair").isin(M.PAIR_NAMES)
    )


def clean_trials(scenes: DataFrame) -> DataFrame:
    """Stimulus trials of good quality and plausible length."""
    return stimulus_trials(scenes).filter(
        F.col("scene_quality_valid")
        & F.col("duration_ms").between(M.TRIAL_MIN_MS, M.TRIAL_MAX_MS)
    )


def with_created_ts(forms: DataFrame, col: str = "createdAt") -> DataFrame:
    return forms.withColumn("created_ts", C.safe_timestamp(col))


def with_severity(forms: DataFrame) -> DataFrame:
    return forms.withColumn("phq9_severity", C.severity("phq9_score", M.PHQ9)).withColumn(
        "bdi_severity", C.severity("bdi_score", M.BDI)
    )


def sessions_table(files: DataFrame, forms: DataFrame) -> DataFrame:
    """Recorded sessions with the user and date of their questionnaire, if any."""
    return files.join(forms.select("session_id", "uid", "createdAt"), "session_id", "left")


def join_forms(df: DataFrame, forms: DataFrame, cols: Sequence[str] = ("uid", *SCORES)) -> DataFrame:
    return df.join(forms.select("session_id", *cols), "session_id")


def trial_numbers(trials: DataFrame, block_scenes: int = 1 << 16) -> DataFrame:
    """``trial_num`` 1.. in scene order inside each session, and the session's ``n_trials``."""
    return B.number_rows(
        trials, ["session_id"], ["scene_index"], B.block("scene_index", block_scenes),
        "trial_num", "n_trials",
    )


def with_trial_norm(trials: DataFrame) -> DataFrame:
    """Trial number scaled to 0..1 inside the session; 0 where there is one trial only."""
    part = (F.col("trial_num") - 1) / (F.col("n_trials") - 1)
    return trials.withColumn("trial_norm", F.when(F.col("n_trials") > 1, part).otherwise(0.0))


def with_thirds(trials: DataFrame) -> DataFrame:
    """First and last third of each session's trials (``is_early``); the middle is dropped."""
    n = F.col("n_trials")
    return trials.withColumn("is_early", F.col("trial_num") <= n / 3).filter(
        F.col("is_early") | (F.col("trial_num") > 2 * n / 3)
    )


def with_z_scores(rows: DataFrame, cols: dict[str, str]) -> DataFrame:
    """Standard scores over all rows (sample deviation); ``new: old`` column names."""
    stats = rows.agg(
        *[F.avg(old).alias(f"_m_{new}") for new, old in cols.items()],
        *[F.stddev_samp(old).alias(f"_s_{new}") for new, old in cols.items()],
    )
    out = rows.crossJoin(F.broadcast(stats))  # one row
    for new, old in cols.items():
        z = F.try_divide(F.col(old) - F.col(f"_m_{new}"), F.col(f"_s_{new}"))
        out = out.withColumn(new, z).drop(f"_m_{new}", f"_s_{new}")
    return out


def mixed_model_trials(scenes: DataFrame, forms: DataFrame) -> DataFrame:
    """Clean trials with trial position, user and standardised scores."""
    rows = with_trial_norm(join_forms(trial_numbers(clean_trials(scenes)), forms))
    return with_z_scores(rows, {"phq9_z": "phq9_score", "bdi_z": "bdi_score"})


def median_split(
    rows: DataFrame, score: str, out: str = "score_group", keys: Sequence[str] = ()
) -> DataFrame:
    """``Low`` below the median over all rows (of the same keys), ``High`` from it on."""
    cut = B.exact_quantiles(rows, keys, score, {"_median": 0.5})
    group = F.when(F.col(score) < F.col("_median"), "Low").when(
        F.col(score) >= F.col("_median"), "High"
    )
    both = B.join_blocks(rows, cut, keys) if keys else rows.crossJoin(F.broadcast(cut))  # one row
    return both.withColumn(out, group).drop("_median")


def trim(rows: DataFrame, value: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows whose value lies between two quantiles of it."""
    cut = B.exact_quantiles(rows, [], value, {"_lo": low, "_hi": high})
    return (
        rows.crossJoin(F.broadcast(cut))  # one row
        .filter(F.col(value).between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


def targets(users: DataFrame) -> DataFrame:
    """Binary, extreme-group and class targets from the two scores."""
    return (
        users.withColumn("phq9_depressed", C.is_case("phq9_score", M.PHQ9))
        .withColumn("bdi_depressed", C.is_case("bdi_score", M.BDI))
        .withColumn("phq9_extreme", C.extreme_label("phq9_score", M.PHQ9))
        .withColumn("bdi_extreme", C.extreme_label("bdi_score", M.BDI))
        .withColumn("phq9_severity_class", C.severity_class("phq9_score", M.PHQ9))
        .withColumn("bdi_severity_class", C.severity_class("bdi_score", M.BDI))
    )


def model_rows(df: DataFrame, features: Sequence[str], target: Sequence[str]) -> DataFrame:
    """Missing features become 0; rows without a target are dropped."""
    return df.fillna(0, list(features)).dropna(subset=list(target))


def fixation_valence(fixations: DataFrame, stimuli: DataFrame) -> DataFrame:
    """Valence of the image under each fixation, ``off_image`` where there is none."""
    look = stimuli.select("folder", F.col("image_id").alias("image"), "valence")
    return fixations.join(look, ["folder", "image"], "left").withColumn(
        "valence", F.coalesce("valence", F.lit("off_image"))
    )


def first_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int
) -> DataFrame:
    """First k rows of each group. Spark keeps k rows per group and task before it shuffles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def sessions_with(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("session_id"), "session_id", "left_semi")


def sessions_without(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("session_id"), "session_id", "left_anti")
