"""Table readers and the overwrite sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixatio.functions import columns as C


def read_table(spark: SparkSession, name_or_path: str) -> DataFrame:
    """A catalogue table, or a Parquet folder if the name has a slash."""
    if "/" in name_or_path:
        return spark.read.parquet(name_or_path)
    return spark.table(name_or_path)


def tidy_text(df: DataFrame) -> DataFrame:
    """Marker strings to NULL in every text column."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: C.clean_text(c) for c in text}) if text else df


def lists_as_json(df: DataFrame) -> DataFrame:
    """Array columns as JSON text, the stored form of lists."""
    arrays = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return df.withColumns({c: F.to_json(c) for c in arrays}) if arrays else df


def write_table(
    df: DataFrame, name_or_path: str, partition_by: Sequence[str] = (), fmt: str = "parquet"
) -> None:
    """Replace a table or folder, schema included.

    Rows of one partition value are written by the tasks that hold them, so a set that
    holds most of the rows does not meet in one task.
    """
    w = tidy_text(df).write.format(fmt).mode("overwrite").option("overwriteSchema", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if "/" in name_or_path:
        w.save(name_or_path)
    else:
        w.saveAsTable(name_or_path)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    return df.limit(n)
