"""Small helpers that the operators share: tables, stored steps, text columns as byte buffers."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixatio.plans.stages import shared_folder

#: The six ASCII white space characters of the contracts, and ASCII letters.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that the whole cluster shares."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/fixatio-{app}/llm/{name}-{uuid.uuid4().hex}"


def store(frame: DataFrame, name: str) -> DataFrame:
    """Write a step to the shared folder and read it back: lineage ends there, and a lost
    executor costs a read of the file, not the work before it."""
    path = scratch(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def per_worker(name: str, version: str, make: Callable[[], Any]) -> Any:
    """An object that a Python worker makes once and keeps between tasks; a new version replaces it."""
    home = sys.modules.setdefault("_fixatio_worker", types.ModuleType("_fixatio_worker"))
    if (getattr(home, name, None) or (None,))[0] != version:
        setattr(home, name, None)
        setattr(home, name, (version, make()))
    return getattr(home, name)[1]


def whole_row(frame: DataFrame, name: str = "row") -> Column:
    """All columns of a row as one struct, safe from clashes with an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias(name)


def row_key(*columns: str | Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns; equal rows get equal keys."""
    return [
        F.xxhash64(F.lit(0), *columns).alias("_k1"),
        F.xxhash64(F.lit(1), *columns).alias("_k2"),
    ]


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a string or binary array as one byte array and n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20):
    """Cut a batch into runs of rows of about ``limit`` bytes of the column, one row at least."""
    _, at = byte_buffer(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
