"""Stage tables: results that several later queries read are written once.

They go to the shared folder named by ``spark.checkpoint.dir``, so lost executors cost
a re-read and later queries prune columns and push filters into Parquet.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_DONE: dict[tuple[str, str, str], str] = {}
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a new folder of its own only in local mode without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    named = named or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="fixatio-")
    return _LOCAL[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own for files in the shared folder."""
    return f"{shared_folder(spark)}/fixatio-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a step of an operator to the shared folder and read it back, so that every later
    branch reads the same rows, also after a task was lost."""
    spark = df.sparkSession
    path = new_folder(spark, "step")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage(spark: SparkSession, source: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write ``build()`` once per application and source folder, and read it back."""
    app = spark.sparkContext.applicationId
    key = (app, source, name)
    if key not in _DONE:
        tag = hashlib.sha256(source.encode()).hexdigest()[:12]
        path = f"{shared_folder(spark)}/fixatio-{app}/{tag}/{name}"
        build().write.mode("overwrite").parquet(path)
        _DONE[key] = path
    return spark.read.parquet(_DONE[key])
