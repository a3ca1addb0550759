"""Vectors in packed blocks, and the grid of query blocks against document blocks.

Vectors are packed where they are read, in runs of rows: one row of a packed table holds some
hundred vectors. Query blocks meet document blocks by an equi-join on the cells of a grid; each
cell is a task of bounded size that returns the best few of each query, and a window over those
takes the best of all cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixatio.llm.common import store

BLOCK = 512  # vectors of a packed row
CELL_DOCS, CELL_QUERIES = 32, 4  # packed rows on the two sides of a cell


def packed(vectors: DataFrame, id_col: str, vector: str, query: Column, nonzero: bool = False) -> DataFrame:
    """Blocks (block, dim, n, ids, uids, values, is_query) of the vectors that take part, stored.

    A vector takes part if neither it nor its id is null, it has a component, and every component
    is finite (with ``nonzero``: and some component is not 0). ``uids`` number the rows, so that
    repeated rows stay apart; vectors of different lengths are in different blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, block = TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 36
        for batch in batches:
            column = batch.column("values")
            width = np.asarray(column.value_lengths().fill_null(0))
            flat = column.flatten()
            clean = np.asarray(flat.fill_null(math.nan), np.float64)
            start = np.cumsum(width) - width
            ids, asks = batch.column("id").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            for dim in np.unique(width[width > 0]):
                rows = np.flatnonzero(width == dim)
                x = clean[start[rows][:, None] + np.arange(dim)]
                ok = np.isfinite(x).all(1)
                if nonzero:
                    ok &= (x != 0).any(1)
                rows, x = rows[ok], x[ok]
                for lo in range(0, len(rows), BLOCK):
                    r = rows[lo:lo + BLOCK]
                    yield pa.record_batch({
                        "block": pa.array([block]), "dim": pa.array([int(dim)], pa.int32()), "n": pa.array([len(r)], pa.int32()),
                        "ids": pa.array([ids[r].astype(np.int64).tobytes()]), "uids": pa.array([(uid + r).astype(np.int64).tobytes()]),
                        "values": pa.array([x[lo:lo + BLOCK].tobytes()]),
                        "is_query": pa.array([asks[r].astype(np.uint8).tobytes()]),
                    })
                    block += 1
            uid += batch.num_rows

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("values"),
        F.coalesce(query, F.lit(False)).alias("query"),
    ).filter("id is not null and values is not null")
    return store(rows.mapInArrow(
        run, "block long, dim int, n int, ids binary, uids binary, values binary, is_query binary"
    ), "vectors")


def arrays(table: pa.Table, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """ids, uids, values (n x dim) and the row numbers of each block of a packed table."""
    join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    stops = np.cumsum(table.column("n").to_numpy())
    return (
        join("ids", np.int64), join("uids", np.int64), join("values", np.float64).reshape(-1, dim),
        [np.arange(b - n, b) for b, n in zip(stops, table.column("n").to_numpy())],
    )


def queries_of(blocks: DataFrame) -> DataFrame:
    """The query vectors of packed blocks, packed again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int, rows: list) -> pa.RecordBatch:
            ids, uids, values = (np.concatenate(x) for x in zip(*rows))
            return pa.record_batch({
                "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()]),
                "uids": pa.array([uids.tobytes()]), "values": pa.array([values.tobytes()]),
            })

        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i in range(table.num_rows):
                one = table.slice(i, 1)
                dim = one.column("dim")[0].as_py()
                ids, uids, values, _ = arrays(one, dim)
                ask = np.frombuffer(one.column("is_query")[0].as_py(), np.uint8).astype(bool)
                if ask.any():
                    held.setdefault(dim, []).append((ids[ask], uids[ask], values[ask]))
                    if sum(len(x[0]) for x in held[dim]) >= BLOCK:
                        yield out(dim, held.pop(dim))
        for dim, rows in held.items():
            yield out(dim, rows)

    return blocks.mapInArrow(run, "dim int, n int, ids binary, uids binary, values binary")


Search = Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]


def _grid(blocks: DataFrame) -> tuple[DataFrame, int, Column, Column]:
    """Stored query blocks, the number of columns of the grid, and a block's column and row in it."""
    asked = store(queries_of(blocks).withColumn("block", F.monotonically_increasing_id()), "queries")
    # How many columns and rows the grid has, from the numbers of packed rows (a hot vector is spread by its blocks).
    across = max(1, math.ceil(blocks.count() / CELL_DOCS))
    down = max(1, math.ceil(asked.count() / CELL_QUERIES))
    cell = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    return asked, across, cell(across), cell(down)


def _search_cells(queries: DataFrame, docs: DataFrame, search: Search, k: int, score_type: str) -> DataFrame:
    """Search every cell (dim, _q, _d): (quid, query_id, vec_id, uid, score). Queries that have a
    column ``within`` hand it to the search as well."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({
            "quid": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()),
            "uid": pa.array([], pa.int64()), "score": pa.array([], pa.int64() if score_type == "long" else pa.float64()),
        })
        if not left.num_rows or not right.num_rows:
            return empty
        left, right = left.sort_by("block"), right.sort_by("block")
        dim = left.column("dim")[0].as_py()
        q_ids, q_uids, q, _ = arrays(left, dim)
        documents = arrays(right, dim)
        more = ()
        if "within" in left.column_names:
            more = (np.frombuffer(b"".join(left.column("within").to_pylist()), np.float64),)
        rows, found, score = search((q_ids, q_uids, q), documents, k, *more)
        return pa.table({
            "quid": q_uids[rows], "query_id": q_ids[rows], "vec_id": documents[0][found], "uid": documents[1][found],
            "score": pa.array(score, pa.int64() if score_type == "long" else pa.float64()),
        })

    keys = ["dim", "_q", "_d"]
    return queries.groupBy(*keys).cogroup(docs.groupBy(*keys)).applyInArrow(
        run, f"quid long, query_id long, vec_id long, uid long, score {score_type}"
    )


def _ranked(some: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("quid").orderBy(F.desc("score"), "vec_id", "uid")
    return some.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def best_of_grid(blocks: DataFrame, search: Search, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best candidates of each query.

    ``search(queries, documents, k)`` gets (ids, uids, values) and (ids, uids, values, blocks) of a
    cell and returns query rows, document rows and scores: for each query, all candidates of the
    cell that may be among its k best, none of them the query's own row.
    """
    asked, across, column, row = _grid(blocks)
    down = max(1, math.ceil(asked.count() / CELL_QUERIES))
    docs = blocks.drop("is_query").withColumn("_d", column).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    )
    queries = asked.withColumn("_q", row).withColumn(
        "_d", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
    )
    return _ranked(_search_cells(queries, docs, search, k, score_type), k)


def best_in_two_passes(blocks: DataFrame, search: Search, k: int) -> DataFrame:
    """As ``best_of_grid``, for cosines: a query block first searches one column of the grid, and
    the distance of each query's k-th neighbour there goes with it to all other columns."""
    asked, across, column, row = _grid(blocks)
    down = max(1, math.ceil(asked.count() / CELL_QUERIES))
    home = F.pmod(F.xxhash64("block", F.lit(1)), F.lit(across)).cast("int")
    docs = blocks.drop("is_query").withColumn("_d", column).withColumn(
        "_q", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))
    )
    queries = asked.withColumn("_q", row)
    first = store(_search_cells(queries.withColumn("_d", home), docs, search, k, "double"), "first-cell")
    # A query has at most k rows here.
    known = first.groupBy("quid").agg(F.count("*").alias("n"), F.min("score").alias("score")).filter(F.col("n") >= k).select(
        "quid", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("within")
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, uids in zip(batch.column("block").to_pylist(), batch.column("uids").to_pylist()):
                u = np.frombuffer(uids, np.int64)
                yield pa.record_batch({"block": pa.array(np.full(len(u), block)), "at": pa.array(np.arange(len(u))), "quid": pa.array(u)})

    # The distances of a block, in its order: a block holds at most BLOCK and a few queries.
    places = asked.select("block", "uids").mapInArrow(unpack, "block long, at long, quid long").join(known, "quid", "left")
    packed_again = places.groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("within", F.lit(math.inf)).alias("d")))).alias("w")
    ).select("block", F.col("w.d").alias("w"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.array(w, np.float64).tobytes() for w in batch.column("w").to_pylist()]
            yield pa.record_batch({"block": batch.column("block"), "within": pa.array(data, pa.binary())})

    within = packed_again.mapInArrow(pack, "block long, within binary")
    others = queries.join(within, "block").withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).filter(
        F.col("_d") != home
    )
    return _ranked(first.unionByName(_search_cells(others, docs, search, k, "double")), k)


def k_best(score: np.ndarray, ids: np.ndarray, uids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        floor = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= floor)
    else:
        near = np.arange(len(score))
    return near[np.lexsort((uids[near], ids[near], -score[near]))[:k]]
