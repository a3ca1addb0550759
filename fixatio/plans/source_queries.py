"""The file sources: given tables written as the raw files of a recording study and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.operators import blocks as B
from fixatio.operators import prepare as P
from fixatio.plans import inputs as I
from fixatio.plans.registry import register
from fixatio.plans.stages import keep, new_folder
from fixatio.sources import raw
from fixatio.sources import tables as TB


def _configs(spark: SparkSession, d: str) -> str:
    """A configuration per set of images, in parts: its scheduled pairs, a line each, beside their
    positions in the list."""
    look = I.stimuli(spark, d).select(
        "folder", "image_id", F.struct(F.concat(F.lit(" "), "category").alias("category"), "labels", "url").alias("meta")
    )
    pairs = I.schedule(spark, d)
    for side in ("left", "right"):
        # Images are as many as pairs: by their size in files, which packs well, they would be sent to all tasks.
        mine = look.select("folder", F.col("image_id").alias(f"image_{side}_id"), F.col("meta").alias(side))
        pairs = pairs.join(mine.hint("merge"), ["folder", f"image_{side}_id"])
    pairs = keep(pairs)  # numbering reads them twice
    # Scenes are the odd numbers; a set's pairs are numbered in blocks of them.
    placed = B.number_rows(pairs, ["folder"], ["scene_index"], B.block("scene_index", 4096), "_no")
    line = F.to_json(F.struct(
        (F.col("_no") - 1).alias("position"),
        F.map_from_arrays(F.array("image_left_id", "image_right_id"), F.array("left", "right")).alias("images"),
    ))
    folder = new_folder(spark, "configs")
    placed.select(F.col("folder").alias("set"), line.alias("value")).write.partitionBy("set").text(folder)
    return folder


@register(
    "files_schedule",
    "select folder, cast(2 * (row_number() over (partition by folder order by scene_index)) - 1 as int) as scene_index, "
    "image_left_id, image_right_id from sched",
    others=["folder", "scene_index", "image_left_id", "image_right_id"],
)
def files_schedule(spark, d):
    """Schedules read from configuration files."""
    return raw.read_schedule(spark, _configs(spark, d), in_parts=True)


@register(
    "files_stimuli",
    "select * from stim s where exists (select 1 from sched c where c.folder = s.folder "
    "and s.image_id in (c.image_left_id, c.image_right_id))",
    others=["image_id", "folder", "category", "valence", "labels", "url"],
)
def files_stimuli(spark, d):
    """Stimuli read from configuration files, lists as JSON."""
    return TB.lists_as_json(raw.read_stimuli(spark, _configs(spark, d), in_parts=True))


@register(
    "files_forms",
    "select session_id, uid, phq9_score, bdi_score, phq9_severity, bdi_severity from forms",
    others=["session_id", "uid", "phq9_severity", "bdi_severity"], nums=["phq9_score", "bdi_score"],
)
def files_forms(spark, d):
    """Questionnaires read from CSV files with the names of their source."""
    rows = I.forms(spark, d)
    names = {"session_id": "sid", "uid": "uid", "phq9_score": "phq-9_score", "bdi_score": "bdi_score"}
    folder = new_folder(spark, "forms")
    named = rows.select(F.lit(0).alias("Unnamed: 0"), *[F.col(c).alias(n) for c, n in names.items()])
    named.write.option("header", True).csv(folder)
    return raw.read_forms(spark, folder).select(
        "session_id", "uid", "phq9_score", "bdi_score", "phq9_severity", "bdi_severity"
    )


#: Samples of a recording in one of its files.
FILE_SAMPLES = 1 << 18


def _recordings(spark: SparkSession, d: str) -> str:
    """Recordings as CSV files in a folder per set and session, half of the sets with other column
    order; a missing image or number is written as one of the marks that stand for it.

    A file holds up to ``FILE_SAMPLES`` successive samples, whichever tasks held them before: the number
    of files follows from sessions and samples alone, not from the tasks."""
    rows = I.samples(spark, d)
    raw_names = {
        "": "sample_idx", "TIMESTAMP": "timestamp_ms", "TEV": "tev", "FEV": "fev", "FDUR": "fdur", "FPOGX": "fpogx",
        "FPOGY": "fpogy", "RX": "rx", "RY": "ry", "BLINK": "blink", "IMAGE": "image", "SCENE_INDEX": "scene_index",
    }
    def marked_by(*marks: str):
        return F.get(F.array(*[F.lit(m) for m in marks]), F.pmod("sample_idx", F.lit(len(marks))).cast("int"))

    number = marked_by("nan", "None", "null", "")
    marked = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), number) for c in ("tev", "rx", "ry")}).withColumn(
        "image", F.coalesce("image", marked_by("no_image", "nan", ""))
    )
    folder = new_folder(spark, "recordings")
    for i in range(I.N_FOLDERS):
        names = list(raw_names.items())[:: 1 if i % 2 else -1]
        one = marked.filter(F.col("folder") == f"set_{i}").repartition("session_id", B.block("sample_idx", FILE_SAMPLES))
        one.select(F.col("session_id").alias("session"), *[F.col(c).alias(n or "_c") for n, c in names]).withColumnRenamed(
            "_c", " "
        ).write.option("header", True).partitionBy("session").csv(f"{folder}/set_{i}")
    return folder


@register(
    "files_samples",
    "select session_id, folder, idx as sample_idx, t as timestamp_ms, fev::double as fev, fdur, rx, ry, blink, image, "
    "scene_index from samples",
    others=["session_id", "folder", "sample_idx", "blink", "image", "scene_index"],
    nums=["timestamp_ms", "fev", "fdur", "rx", "ry"],
)
def files_samples(spark, d):
    """Samples read from recordings with two kinds of headers and marks for missing values."""
    rows = raw.read_samples(spark, _recordings(spark, d))
    return rows.select(
        "session_id", "folder", "sample_idx", "timestamp_ms", "fev", "fdur", "rx", "ry", "blink", "image", "scene_index"
    )


@register(
    "files_inventory", "select distinct session_id, folder as test_version from samples",
    others=["session_id", "test_version"],
)
def files_inventory(spark, d):
    """Sessions and their sets from the paths of the recordings alone."""
    return raw.session_files(spark, _recordings(spark, d)).distinct()


@register(
    "files_sessions",
    "select s.session_id, s.folder as test_version, f.uid from "
    "(select distinct session_id, folder from samples) s left join forms f using (session_id)",
    others=["session_id", "test_version", "uid"],
)
def files_sessions(spark, d):
    """Sessions written through the sink, overwritten, and read again."""
    files = I.scene_rows(spark, d).select("session_id", F.col("folder").alias("test_version")).distinct()
    target = new_folder(spark, "sessions")
    table = P.sessions_table(files, I.forms(spark, d)).select("session_id", "test_version", "uid")
    TB.write_table(table.limit(1), target)
    TB.write_table(table, target)
    return TB.read_table(spark, target)
