"""Ridge regression of all folds from one pass: sums of products by fold, solved on the driver.

A task adds up the products of its rows for each fold, a square of (features + 2) numbers; these are
summed in rounds of bounded fan-in, and one square per fold reaches the driver, whatever the number
of rows. The rows outside a fold are the total less the fold's own square.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring this module along

FAN_IN = 64  # squares that are summed at once

_SQUARE = "fold int, part int, square binary"


def fold_squares(rows: DataFrame, shift: np.ndarray) -> dict[int, np.ndarray]:
    """Per fold: sums of products of (1, features, label), features and label less ``shift``."""
    size = len(shift) + 1

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.asarray(batch.column("x").flatten(), np.float64).reshape(batch.num_rows, -1)
            held = np.column_stack([np.ones(len(x)), x - shift[:-1], batch.column("label").to_numpy() - shift[-1]])
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                mine = held[fold == f]
                total[f] = total.get(f, 0.0) + mine.T @ mine
        yield from (_row(f, TaskContext.get().partitionId(), square) for f, square in total.items())

    def added(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        square = np.sum([np.frombuffer(b, np.float64) for b in table.column("square").to_pylist()], axis=0)
        return pa.Table.from_batches([_row(table.column("fold")[0].as_py(), table.column("_to")[0].as_py(), square)])

    narrow = rows.select(F.col("fold").cast("int").alias("fold"), F.col("label").cast("double").alias("label"), vector_to_array("features").alias("x"))
    left, sums = rows.rdd.getNumPartitions(), narrow.mapInArrow(products, _SQUARE)
    while left > 1:
        sums = sums.withColumn("_to", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("fold", "_to").applyInArrow(added, _SQUARE)
        left = -(-left // FAN_IN)
    return {r.fold: np.frombuffer(r.square, np.float64).reshape(size, size) for r in sums.collect()}


def _row(fold: int, part: int, square: np.ndarray) -> pa.RecordBatch:
    ints = {"fold": [fold], "part": [part]}
    return pa.record_batch({**{c: pa.array(v, pa.int32()) for c, v in ints.items()}, "square": pa.array([square.tobytes()], pa.binary())})


def solve(square: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and weights of the unscaled features, from the sums of products of the rows.

    Features are scaled by their deviation (n - 1) before the penalty; constant ones get weight 0.
    """
    n, mean = square[0, 0], square[0, 1:] / square[0, 0]
    about = square[1:, 1:] - n * np.outer(mean, mean)
    spread = np.maximum(np.diag(about)[:-1], 0.0)
    used = spread > 1e-12 * np.maximum(np.diag(square)[1:-1], 1e-300)
    scale = np.sqrt(spread[used] / max(n - 1, 1))
    weights = np.zeros(len(spread))
    gram = about[:-1, :-1][np.ix_(used, used)] / np.outer(scale, scale)
    weights[used] = np.linalg.solve(gram + alpha * np.eye(len(scale)), about[:-1, -1][used] / scale) / scale
    return mean[-1] - weights @ mean[:-1], weights


def cross_predict(rows: DataFrame, k: int, alpha: float = 1.0) -> DataFrame:
    """Out-of-fold predictions: the columns but the features, ``prediction`` and ``score`` (null).

    ``rows`` has ``features``, ``label`` and ``fold`` without nulls. A fold that holds all rows has no
    model, and its rows are left out.
    """
    spark = rows.sparkSession
    fields = "fold int, _intercept double, _weights array<double>"
    models = []
    if not rows.isEmpty():
        first = rows.agg(Summarizer.mean(F.col("features")).alias("x"), F.avg("label").alias("y")).first()
        shift = np.append(first.x.toArray(), first.y)  # products about the mean keep their digits
        squares = fold_squares(rows, shift)
        total = np.sum(list(squares.values()), axis=0)
        for f, own in squares.items():
            if 0 <= f < k and len(squares) > 1:
                intercept, weights = solve(total - own, alpha)
                models.append((f, float(intercept + shift[-1] - weights @ shift[:-1]), weights.tolist()))
    place = F.broadcast(spark.createDataFrame(models, fields))  # a row for each fold
    products = F.zip_with(vector_to_array("features"), "_weights", lambda x, w: x * w)
    prediction = F.aggregate(products, F.col("_intercept"), lambda s, p: s + p)
    return rows.join(place, "fold").select(
        *[F.col(f"`{c}`") for c in rows.columns if c != "features"],
        prediction.alias("prediction"), F.lit(None).cast("double").alias("score"),
    )
