"""Gaze-domain tables derived from the generic test tables.

``events`` become gaze samples, ``part`` the stimulus set, ``customer`` the
questionnaires. Every row of each source table is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.functions import columns as C
from fixatio.operators import blocks as B
from fixatio.operators import events as E
from fixatio.operators import scene as S
from fixatio.plans.stages import stage

N_FOLDERS = 4
STEP_MS = 64
NEGATIVE_WORDS = ("cold", "old", "small", "blue")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part is an image of every folder; its type and name give category and labels."""
    word = F.split("p_name", " ")[0]
    label = F.when(word.isin(*NEGATIVE_WORDS), "Sad").otherwise("Happy Face")
    neutral = F.col("p_type").isin("STANDARD", "MEDIUM")
    return (
        table(spark, sf_dir, "part")
        .select(
            "p_partkey",
            F.concat(F.lit("img_"), F.col("p_partkey")).alias("image_id"),
            F.explode(F.array(*[F.lit(f"set_{i}") for i in range(N_FOLDERS)])).alias("folder"),
            F.when(neutral, " neutral ").otherwise("stimulus").alias("category"),
            F.array(label, F.split("p_name", " ")[1]).alias("labels"),
            F.concat(F.lit("img://"), F.col("p_partkey")).alias("url"),
        )
        .withColumn("valence", C.valence())
        .withColumn("category", F.trim("category"))
    )


def _schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene 2p + 1 of a folder shows two images, by rank of the part inside its valence."""
    ranked = B.number_rows(
        stimuli(spark, sf_dir), ["folder", "valence"], ["p_partkey"],
        B.block("p_partkey", 1 << 18), "rank",
    ).select("folder", "valence", (F.col("rank") - 1).alias("p"), "image_id")
    kind = F.col("p") % 3
    by_place = (
        ranked.groupBy("folder", "p")
        .pivot("valence", ["negative", "positive", "neutral"])
        .agg(F.first("image_id"))
    )
    left = F.when(kind == 2, F.col("neutral")).otherwise(F.col("negative"))
    right = F.when(kind == 1, F.col("neutral")).otherwise(F.col("positive"))
    return by_place.select(
        "folder",
        (2 * F.col("p") + 1).cast("int").alias("scene_index"),
        left.alias("image_left_id"),
        right.alias("image_right_id"),
    ).filter("image_left_id is not null and image_right_id is not null")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.floor(F.col("user_id") / 10).cast("long").alias("sid"),
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    minute = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000)
    rows = B.number_rows(raw, ["sid"], ["ts", "event_id"], minute, "sample_no")
    idx = F.col("sample_no") - 1
    p = F.floor(idx / 30)
    odd = (2 * p + 1).cast("int")
    blink = F.col("event_type") == "error"
    k = F.col("k")
    rows = rows.select(
        F.col("sid").cast("string").alias("session_id"),
        F.concat(F.lit("set_"), F.col("sid") % N_FOLDERS).alias("folder"),
        idx.alias("sample_idx"),
        (idx * STEP_MS).cast("double").alias("timestamp_ms"),
        F.lit(1.0).alias("tev"),
        (k % 4).cast("double").alias("fev"),
        (STEP_MS * (1 + k % 5)).cast("double").alias("fdur"),
        F.when(k % 7 != 0, k / 100).alias("fpogx"),
        F.when(k % 7 != 0, F.floor("value") % 100 / 100).alias("fpogy"),
        F.when(~blink & (k % 10 != 0), k / 100).alias("rx"),
        F.when(~blink & (k % 10 != 0), F.floor("value") % 100 / 100).alias("ry"),
        blink.alias("blink"),
        "k",
        odd.alias("odd_scene"),
        F.when(idx % 30 < 24, odd).otherwise(odd + 1).alias("scene_index"),
    )
    plan = schedule(spark, sf_dir).withColumnRenamed("scene_index", "odd_scene")
    shown = (
        F.when(k == 98, "img_stray")
        .when(k % 3 == 0, F.col("image_left_id"))
        .when(k % 3 == 1, F.col("image_right_id"))
        .otherwise("no_image")
    )
    return (
        rows.join(plan, ["folder", "odd_scene"], "left")
        .withColumn("image", C.real_image(shown))
        .drop("k", "odd_scene", "image_left_id", "image_right_id")
    )


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One questionnaire pair per customer; two neighbouring customers are one user.

    A negative balance stands for a missing first score and an unreadable date.
    """
    whole = F.floor(F.abs("c_acctbal")).cast("long")
    owes = F.col("c_acctbal") < 0
    day = F.date_add(F.to_date(F.lit("2024-01-01")), (F.col("c_custkey") % 365).cast("int"))
    return (
        table(spark, sf_dir, "customer")
        .select(
            F.col("c_custkey").cast("string").alias("session_id"),
            F.concat(F.lit("u"), F.floor(F.col("c_custkey") / 2)).alias("uid"),
            F.when(~owes, whole % 28).alias("phq9_score"),
            (F.floor(whole / 28) % 64).alias("bdi_score"),
            F.when(owes, "unknown").otherwise(day.cast("string")).alias("createdAt"),
        )
        .withColumn("phq9_severity", C.severity("phq9_score", _PHQ9))
        .withColumn("bdi_severity", C.severity("bdi_score", _BDI))
    )


from fixatio.model import BDI as _BDI, PHQ9 as _PHQ9  # noqa: E402


def stimuli(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "stimuli", lambda: _stimuli(spark, sf_dir))


def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "schedule", lambda: _schedule(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, sf_dir, "samples", lambda: _samples(spark, sf_dir))


def scene_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "scene_rows", lambda: E.scene_samples(samples(spark, sf_dir))
    )


def fixations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark, sf_dir, "fixations", lambda: E.extract_fixations(samples(spark, sf_dir))
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(
        spark,
        sf_dir,
        "scene_metrics",
        lambda: S.scene_metrics(
            samples(spark, sf_dir),
            stimuli(spark, sf_dir),
            schedule(spark, sf_dir),
            fixations=fixations(spark, sf_dir),
            scene_rows=scene_rows(spark, sf_dir),
        ),
    )
