"""Readers of raw files. Each reads a whole folder tree as one DataFrame."""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.functions import columns as C
from fixatio.operators import blocks as B
from fixatio.plans.stages import keep

# Raw column names of a recording, as text: numbers are parsed afterwards, so that a bad
# value costs one NULL and not the file. The unnamed first column is the row number.
RAW_COLUMNS = ["TIMESTAMP", "TEV", "FEV", "FDUR", "FPOGX", "FPOGY", "RX", "RY", "BLINK", "IMAGE",
               "SCENE_INDEX"]
CONFIG_TYPE = "array<map<string, struct<category: string, labels: array<string>, url: string>>>"


# A recording is the file <set>/<session>.csv, or any number of files in the folder
# <set>/session=<session>, so that a long one is neither written nor held by a single task.
def _folder(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)/(session=[^/]+/)?[^/]+$", 1)


def _session(path) -> F.Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(path, r"/session=([^/]+)/[^/]+$", 1), F.lit("")), F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    )


def session_files(spark: SparkSession, path: str) -> DataFrame:
    """Recordings under a folder: session and set name from the paths, once for each file; no
    contents are read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.csv").load(path).select("path")
    )
    return files.select(
        F.url_decode(_session(F.col("path"))).alias("session_id"),
        F.url_decode(_folder(F.col("path"))).alias("test_version"),
    )


def _names(header: str) -> list[str]:
    """Column names of a header line; an empty one is the row number's."""
    names = next(csv.reader([header.lstrip("\ufeff")]))
    return ["_idx" if n.strip() in ("", "Unnamed: 0") else n.strip() for n in names]


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Gaze samples of all recordings under a folder, typed, without rows that have no scene.

    Columns are found by the header of each file, so files with other columns, another order,
    or without the unnamed row-number column can lie in one tree; a file without a header
    fails the query. The row number is the order of the samples, and samples whose number
    cannot be read come first; files without that column are numbered by time, ties by the
    other columns.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.rtrim("value").alias("line"))
        .filter("line <> ''")
    )
    bare, is_header = F.translate("line", '"\ufeff ', ""), F.lit(True)
    for n in ("TIMESTAMP", "SCENE_INDEX"):
        is_header = is_header & bare.contains(n) & F.array_contains(F.split(bare, ","), n)
    of_file = keep(lines.groupBy("file").agg(F.min(F.when(is_header, F.col("line"))).alias("header")).select(
        "file", "header", F.url_decode(_session(F.col("file"))).alias("session_id"), F.url_decode(_folder(F.col("file"))).alias("folder")
    ))
    # The different headers, not the files, are what the plan grows with.
    headers = [r["header"] for r in of_file.select("header").distinct().collect()]
    if None in headers:
        name = of_file.filter("header is null").first()["file"]
        raise ValueError(f"{name}: no header with TIMESTAMP and SCENE_INDEX")
    names = {h: _names(h) for h in headers or [",".join(RAW_COLUMNS)]}
    # Only lines with quotes need the parser, once for each width of their headers.
    quoted = F.col("line").contains('"')
    cells, parsed = F.when(~quoted, F.split("line", ",")).alias("cells"), {}
    for width in sorted({len(n) for n in names.values()}):
        mine = quoted & F.col("header").isin([h for h, n in names.items() if len(n) == width])
        parsed[width] = F.when(mine, F.from_csv("line", ", ".join(f"c{i} string" for i in range(width)))).alias(f"w{width}")
    rows = lines.filter(~is_header).join(of_file, "file").select("session_id", "folder", "header", cells, *parsed.values())

    def field(n: str) -> Column:
        """The wanted field as text; a column that is missing, or a field without text, is NULL."""
        found = [
            F.when(F.col("header") == h, F.coalesce(F.nullif(F.get("cells", F.lit(at)), F.lit("")), F.col(f"w{len(own)}")[f"c{at}"]))
            for h, own, at in ((h, own, own.index(n)) for h, own in names.items() if n in own)
        ]
        return (F.coalesce(*found) if found else F.lit(None).cast("string")).alias(n)

    plain = [h for h, n in names.items() if headers and "_idx" not in n]
    rows = rows.select(
        "session_id", "folder", F.col("header").isin(plain).alias("plain"), F.struct(*[field(n) for n in ["_idx", *RAW_COLUMNS]]).alias("r")
    )
    typed = rows.select(
        "session_id",
        "folder",
        F.coalesce(C.number("r._idx").cast("long"), F.lit(-1).cast("long")).alias("sample_idx"),
        C.number("r.TIMESTAMP").alias("timestamp_ms"),
        *[C.number(f"r.{n}").alias(n.lower()) for n in RAW_COLUMNS[1:8]],
        C.flag("r.BLINK").alias("blink"),
        C.real_image("r.IMAGE").alias("image"),
        C.number("r.SCENE_INDEX").try_cast("int").alias("scene_index"),
        "plain",
    ).filter(F.col("scene_index").isNotNull())
    if not plain:
        return typed.drop("plain")
    by_time = ["timestamp_ms", *[c for c in typed.columns if c not in ("timestamp_ms", "sample_idx", "plain")]]
    minute = F.floor(F.col("timestamp_ms") / 60_000).cast("long")
    own = B.number_rows(
        typed.filter("plain").drop("sample_idx"), ["session_id", "folder"], by_time, minute, "sample_idx"
    )
    rest = typed.filter("not plain").drop("plain")
    return rest.unionByName(own.withColumn("sample_idx", F.col("sample_idx") - 1).drop("plain"))


# One line of a configuration in parts.
LINE_TYPE = f"position long, images {CONFIG_TYPE.removeprefix('array<').removesuffix('>')}"


def _set_name(pattern: str) -> Column:
    return F.url_decode(F.regexp_extract("_metadata.file_path", pattern, 1)).alias("folder")


def _configs(spark: SparkSession, path: str) -> DataFrame:
    """One row per configuration file: set name and text."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(path).select(
        _set_name(r"([^/]+)\.json$"), F.trim("value").alias("text"),
    )


def _config_lines(spark: SparkSession, path: str) -> DataFrame:
    """Set name, list position and images of each line of the configurations in parts: folders
    set=<set> of files with one pair a line and its position in the list beside it."""
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        _set_name(r"/set=([^/]+)/[^/]+$"), F.from_json("value", LINE_TYPE).alias("line")
    )
    return lines.select("folder", F.col("line.position").alias("pos"), F.col("line.images").alias("pair"))


def read_stimuli(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """Images of all configuration files; a repeated image keeps its last entry.

    A file holds a list of two-image objects, or one object with all images. With ``in_parts``
    a list is spread over files, see ``_config_lines``.
    """
    listed = F.when(F.col("text").startswith("["), F.col("text")).otherwise(
        F.concat(F.lit("["), "text", F.lit("]"))
    )
    pairs = _config_lines(spark, path) if in_parts else _configs(spark, path).select(
        "folder", F.posexplode(F.from_json(listed, CONFIG_TYPE)).alias("pos", "pair")
    )
    entries = pairs.select("folder", "pos", F.explode("pair").alias("image_id", "meta"))
    last = entries.groupBy("folder", "image_id").agg(F.max_by("meta", "pos").alias("m"))
    return last.select(
        "image_id",
        "folder",
        F.trim(F.coalesce("m.category", F.lit(""))).alias("category"),
        C.valence("m.category", "m.labels").alias("valence"),
        F.coalesce("m.labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("m.url", F.lit("")).alias("url"),
    )


def read_schedule(spark: SparkSession, path: str, in_parts: bool = False) -> DataFrame:
    """Images of each scene: the pair at list position p belongs to scene 2p + 1, left first.

    A file that is not a list, or has a pair without exactly two images, fails the query. With
    ``in_parts`` a list is spread over files, see ``_config_lines``; a line without a position
    fails the query.
    """
    keys = F.map_keys("pair")
    wrong = F.concat("folder", F.lit(" position "), F.col("pos").cast("string"),
                     F.lit(": expected 2 images, got "), F.size(keys).cast("string"))
    pair = F.when(F.size(keys) == 2, keys).otherwise(F.raise_error(wrong))
    if in_parts:
        no_place = F.raise_error(F.concat("folder", F.lit(": a line without a position")))
        listed = _config_lines(spark, path).withColumn("pos", F.when(F.col("pos").isNotNull(), F.col("pos")).otherwise(no_place))
    else:
        config = F.from_json("text", CONFIG_TYPE)
        listed = _configs(spark, path).select(
            "folder",
            F.when(F.col("text").startswith("["), config).otherwise(
                F.raise_error(F.concat(F.col("folder"), F.lit(": expected a list of pairs")))
            ).alias("pairs"),
        ).select("folder", F.posexplode("pairs").alias("pos", "pair"))
    return (
        listed.select("folder", (2 * F.col("pos") + 1).cast("int").alias("scene_index"), pair.alias("k"))
        .select("folder", "scene_index", F.col("k")[0].alias("image_left_id"),
                F.col("k")[1].alias("image_right_id"))
    )


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """Questionnaires of a CSV file, or of a folder of such files with a header each: columns
    renamed, scores typed, severity bands added."""
    from fixatio.operators.prepare import with_severity

    raw = spark.read.option("header", True).csv(path)
    raw = raw.drop("_c0", "Unnamed: 0")
    names = {"sid": "session_id", "phq-9_score": "phq9_score"}
    names |= {f"phq-9_{i}": f"phq9_q{i}" for i in range(1, 10)}
    names |= {f"bdi_{i}": f"bdi_q{i}" for i in range(1, 22)}
    df = raw.withColumnsRenamed(names)
    scores = [c for c in df.columns if c.startswith(("phq9_", "bdi_"))]
    return with_severity(df.withColumns({c: C.number(c) for c in scores}))
