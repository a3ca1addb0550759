"""Gradient boosting by histograms, all folds and classes at once, on stored and binned rows.

Features are binned to bytes once. Each fold's model learns from the rows of the other folds.

If the rows fit into a task, a model is one task: it holds its binned rows and their scores and runs
all rounds on them; the models are one job. A node with more rows than its sibling is not added up:
its sums are those of the parent less the sibling's.

Otherwise the binned rows are stored once for every model, in parts. A level of the trees of all
models and classes is one job: tasks add up gradient and Hessian by node, feature and bin, the arrays
of a model are summed (in rounds of bounded fan-in), and the best split of each node comes back, a few
numbers each. The rows themselves never change: a job rebuilds their scores from the last stored ones
and the trees since, so a lost task is repeated from stored data alone. Scores are stored every few
rounds. Both ways take the same splits; sums differ in their last digits with the order of addition.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.plans.stages import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring this module along

BINS = 32
PART_ROWS = 100_000  # rows of a part
TASK_BYTES = 400_000_000  # a model whose rows take more than this is not held by one task
CHUNK = 1 << 15  # rows whose derivatives are added up at once: they stay near the processor
FAN_IN = 64  # arrays that are summed at once
STORED_ROUNDS = 10  # scores are stored after so many rounds

# --- fixed values: penalty on leaf weights, least Hessian of a child ---------------
LAMBDA, LEAST_HESSIAN = 1.0, 1.0
# ---------------------------------------------------------------------------------

_KEY = "model int, class int"
_SUMS = f"{_KEY}, part long, sums binary"
_SPLITS = f"{_KEY}, node int, feature int, bin int, g double, h double, gl double, hl double"


class Trees:
    """One round: a complete tree for each class. A node that does not split sends all to the left."""

    def __init__(self, classes: int, depth: int):
        self.depth = depth
        self.feature = np.zeros((classes, 2**depth - 1), np.int64)
        self.bin = np.full((classes, 2**depth - 1), 255, np.int64)
        self.leaf = np.zeros((classes, 2**depth))

    def walk(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """rows x classes: the node of the level that a row is in, numbered from 0."""
        out, flat, first = np.empty((len(bins), len(self.feature)), np.int64), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        for c, (feature, cut) in enumerate(zip(self.feature, self.bin)):
            at = np.zeros(len(bins), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (flat.take(first + feature.take(at)) > cut.take(at))
            out[:, c] = at - (2**depth - 1)
        return out

    def add_to(self, score: np.ndarray, bins: np.ndarray) -> None:
        score += self.leaf[np.arange(len(self.leaf)), self.walk(bins, self.depth)]


def gradients(task: str, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the loss, rows x classes; ``y`` numbers the classes."""
    if task == "regression":
        return score - y[:, None], np.ones_like(score)
    if task == "binary":
        p = 1 / (1 + np.exp(-score))
        return p - y[:, None], np.maximum(p * (1 - p), 1e-16)
    e = np.exp(score - score.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True)
    return p - (y[:, None] == np.arange(score.shape[1])), np.maximum(2 * p * (1 - p), 1e-16)


def bin_columns(bins: np.ndarray, n_bins: int) -> tuple[np.ndarray, int]:
    """Columns of numbers below the width, which is returned too: the bins of two features as one
    number (a last feature may be alone) or, for few rows, those of one."""
    columns = np.ascontiguousarray(bins.T).astype(np.int16 if n_bins <= 181 else np.int32)
    if len(bins) < 4 * n_bins**2:
        return columns, n_bins
    pairs = columns[::2] * n_bins
    pairs[: len(columns) // 2] += columns[1::2]
    return pairs, n_bins**2


def column_sums(columns: np.ndarray, width: int, g: np.ndarray, h: np.ndarray, node: np.ndarray, nodes: int, rows: np.ndarray | None = None) -> np.ndarray:
    """2 x columns x nodes x width: the derivatives by node and number. ``rows`` of the columns take
    part (all); ``g``, ``h`` and ``node`` are theirs."""
    out = np.zeros((2, len(columns), nodes * width))
    for a in range(0, len(node), CHUNK):
        some = slice(a, a + CHUNK)
        first, mine = node[some] * width, (g[some], h[some])
        for k, column in enumerate(columns):
            place = first + (column[some] if rows is None else column.take(rows[some]))
            for i in (0, 1):
                out[i, k] += np.bincount(place, mine[i], nodes * width)
    return out.reshape(2, len(columns), nodes, width)


def feature_sums(sums: np.ndarray, features: int, n_bins: int) -> np.ndarray:
    """2 x nodes x features x bins, from the sums of columns."""
    if sums.shape[3] == n_bins:
        return np.ascontiguousarray(sums.transpose(0, 2, 1, 3))
    pairs, out = sums.reshape(*sums.shape[:3], n_bins, n_bins), np.empty((2, sums.shape[2], features, n_bins))
    out[:, :, ::2] = pairs.sum(4).transpose(0, 2, 1, 3)
    out[:, :, 1::2] = pairs[:, : features // 2].sum(3).transpose(0, 2, 1, 3)
    return out


def add_sums(total: np.ndarray, g: np.ndarray, h: np.ndarray, node: np.ndarray, bins: np.ndarray, n_bins: int) -> None:
    """Add to ``total`` (classes x 2 x nodes x features x bins) the derivatives of the rows by node of
    the class, feature and bin."""
    classes, _, nodes, features, _ = total.shape
    columns, width = bin_columns(bins, n_bins)
    for c in range(classes):
        sums = column_sums(columns, width, g[:, c].copy(), h[:, c].copy(), node[:, c].copy(), nodes)
        total[c] += feature_sums(sums, features, n_bins)


def best_splits(sums: np.ndarray) -> list[tuple]:
    """(node, feature, bin, g, h, gl, hl) of each node from its sums (2 x nodes x features x bins);
    feature -1 where no split gains. Ties go to the first feature, then the lowest bin."""
    g, h = sums
    total_g, total_h = g[:, 0].sum(1), h[:, 0].sum(1)
    left_g, left_h = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
    all_g, all_h = total_g[:, None, None], total_h[:, None, None]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + LAMBDA) + right_g**2 / (right_h + LAMBDA) - all_g**2 / (all_h + LAMBDA)
    gain[(left_h < LEAST_HESSIAN) | (right_h < LEAST_HESSIAN)] = -np.inf
    out = []
    for node in range(len(g)):
        best = gain[node].max(initial=-np.inf)
        if best > 1e-9:
            # Sums differ in the last digits with the order of rows; near ties are ties.
            feature, b = divmod(int(np.flatnonzero(gain[node].ravel() >= best - 1e-9 * abs(best))[0]), gain.shape[2])
            out.append((node, feature, b, total_g[node], total_h[node], left_g[node, feature, b], left_h[node, feature, b]))
        else:
            out.append((node, -1, -1, total_g[node], total_h[node], 0.0, 0.0))
    return out


def _split_rows(model: int, label: int, splits: list[tuple]) -> pa.RecordBatch:
    node, feature, b, g, h, gl, hl = zip(*splits)
    ints = {"model": [model] * len(node), "class": [label] * len(node), "node": node, "feature": feature, "bin": b}
    return pa.record_batch({
        **{k: pa.array(v, pa.int32()) for k, v in ints.items()},
        **{k: pa.array(v, pa.float64()) for k, v in zip(("g", "h", "gl", "hl"), (g, h, gl, hl))},
    })


def bin_edges(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """Upper edges of the bins of each feature of ``_x``, from approximate quantiles of all rows."""
    n = len(rows.first()["_x"])
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])  # made once, not for each feature
    found = rows.agg(*[F.percentile_approx(F.col("_x")[i], shares, 10_000).alias(f"e{i}") for i in range(n)]).first()
    return [np.unique(np.array(e, float)) for e in found]


def binned_rows(rows: DataFrame, edges: list[np.ndarray], classes: list[float]) -> DataFrame:
    """(row, fold, y, bins): the columns but the features, the number of the label's class (without
    classes the label), and a byte for each feature."""

    def to_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column("_x").flatten(), np.float64).reshape(batch.num_rows, -1)
            out = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], 1).astype(np.uint8)
            y = batch.column("label").to_numpy().astype(float)
            if classes:
                y = np.searchsorted(classes, y).astype(float)
            yield pa.record_batch({
                "row": batch.column("row"), "fold": batch.column("fold"), "y": pa.array(y),
                "bins": pa.array([b.tobytes() for b in out], pa.binary()),
            })

    row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_x"]).alias("row")
    narrow = rows.select(row, F.col("label").cast("double").alias("label"), F.col("fold").cast("int").alias("fold"), "_x")
    return narrow.mapInArrow(to_bins, f"row {narrow.schema['row'].dataType.simpleString()}, fold int, y double, bins binary")


def fixed_bytes(column: pa.ChunkedArray) -> np.ndarray:
    """A column of byte strings of one length as rows, without a Python object for each."""
    held = pa.concat_arrays(column.chunks)
    ends = np.frombuffer(held.buffers()[1], np.int32)[held.offset : held.offset + len(held) + 1]
    return np.frombuffer(held.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(held), -1)


class HistogramBoosting:
    """Boosted trees for a ``task`` (binary, multiclass, regression)."""

    def __init__(self, task: str, rounds: int, depth: int, rate: float, bins: int = BINS):
        self.task, self.rounds, self.depth, self.rate, self.bins = task, rounds, depth, rate, bins

    # --- preparation -----------------------------------------------------------------

    def _binned(self, rows: DataFrame, classes: list[float]) -> tuple[DataFrame, int]:
        """(row, fold, y, bins), and the number of features."""
        edges = bin_edges(rows, self.bins)
        return binned_rows(rows, edges, classes), len(edges)

    def _in_parts(self, binned: DataFrame, n: int, models: list[int]) -> tuple[DataFrame, int]:
        """Stored (model, row, fold, y, bins), and in how many parts a model's rows lie."""
        parts = max(1, math.ceil(n / PART_ROWS))
        binned = binned.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn(
            "model", F.explode(F.array(*[F.lit(f) for f in models]))
        )
        # One file for each model and part: a hash could put several into one task.
        place = F.array_position(F.array(*[F.lit(f) for f in models]), F.col("model")) * parts + F.col("part")
        return keep(binned.repartitionByRange(parts * len(models), place)), parts

    # --- one level -------------------------------------------------------------------

    def _scores(self, batch: pa.RecordBatch, rows: np.ndarray, bins: np.ndarray, start: np.ndarray, trees: list[Trees]) -> np.ndarray:
        if "score" in batch.schema.names:
            held = batch.column("score").take(pa.array(rows)).to_pylist()
            score = np.frombuffer(b"".join(held), np.float64).reshape(len(rows), -1).copy()
        else:
            score = np.tile(start, (len(rows), 1))
        for tree in trees:
            tree.add_to(score, bins)
        return score

    def _by_model(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        model = batch.column("model").to_numpy()
        for m in np.unique(model).tolist():
            rows = np.flatnonzero(model == m)
            held = batch.column("bins").take(pa.array(rows)).to_pylist()
            yield m, rows, np.frombuffer(b"".join(held), np.uint8).reshape(len(rows), -1)

    def _level(self, state: DataFrame, parts: int, start: dict, since: dict, growing: dict, level: int) -> list:
        task, n_bins, nodes = self.task, self.bins, 2**level

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total: dict[int, np.ndarray] = {}
            for batch in batches:
                y, fold = batch.column("y").to_numpy(), batch.column("fold").to_numpy()
                for m, rows, bins in self._by_model(batch):
                    learn = fold[rows] != m
                    rows, bins = rows[learn], bins[learn]
                    if not len(rows):
                        continue
                    g, h = gradients(task, self._scores(batch, rows, bins, start[m], since[m]), y[rows])
                    node = growing[m].walk(bins, level)
                    if m not in total:
                        total[m] = np.zeros((g.shape[1], 2, nodes, bins.shape[1], n_bins))
                    add_sums(total[m], g, h, node, bins, n_bins)
            for m, all_classes in total.items():
                for c, one in enumerate(all_classes):
                    if parts == 1:  # the only part: these are the sums
                        yield _split_rows(m, c, best_splits(one.reshape(2, nodes, -1, n_bins)))
                    else:
                        yield pa.record_batch({
                            "model": pa.array([m], pa.int32()), "class": pa.array([c], pa.int32()),
                            "part": pa.array([TaskContext.get().partitionId()], pa.int64()), "sums": pa.array([one.tobytes()], pa.binary()),
                        })

        columns = [c for c in ("model", "fold", "y", "bins", "score") if c in state.columns]
        if parts == 1:
            return state.select(*columns).mapInArrow(sums, _SPLITS).collect()

        def added(table: pa.Table) -> np.ndarray:
            return np.sum([np.frombuffer(x, np.float64) for x in table.sort_by("part").column("sums").to_pylist()], axis=0)

        def some(table: pa.Table) -> pa.Table:
            return pa.table({
                "model": table.column("model")[:1], "class": table.column("class")[:1],
                "part": pa.array([table.column("_to")[0].as_py()], pa.int64()), "sums": pa.array([added(table).tobytes()], pa.binary()),
            })

        def split(table: pa.Table) -> pa.Table:
            one = added(table).reshape(2, nodes, -1, n_bins)
            return pa.Table.from_batches([_split_rows(table.column("model")[0].as_py(), table.column("class")[0].as_py(), best_splits(one))])

        partial, left = state.select(*columns).mapInArrow(sums, _SUMS), parts * len(start)
        while left > FAN_IN:
            partial = partial.withColumn("_to", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("model", "class", "_to").applyInArrow(some, _SUMS)
            left = math.ceil(left / FAN_IN)
        return partial.groupBy("model", "class").applyInArrow(split, _SPLITS).collect()

    # --- all rounds ------------------------------------------------------------------

    def _grow(self, tree: Trees, splits: list, level: int) -> None:
        """Enter the splits of one level, and the leaves after the last."""
        weight = lambda g, h: -self.rate * g / (h + LAMBDA)
        for r in splits:
            c, node = r["class"], 2**level - 1 + r["node"]
            if r["feature"] >= 0:
                tree.feature[c, node], tree.bin[c, node] = r["feature"], r["bin"]
            if level == self.depth - 1:
                if r["feature"] >= 0:
                    tree.leaf[c, 2 * r["node"]] = weight(r["gl"], r["hl"])
                    tree.leaf[c, 2 * r["node"] + 1] = weight(r["g"] - r["gl"], r["h"] - r["hl"])
                else:
                    tree.leaf[c, 2 * r["node"]] = weight(r["g"], r["h"])

    def cross_predict(self, rows: DataFrame, k: int) -> DataFrame:
        """Out-of-fold predictions: the columns but the features, ``prediction`` and ``score``
        (binary: the probability of the second class; else null).

        ``rows`` has ``features``, ``label`` and ``fold``; the label must not be null. A fold without
        rows, or that holds all rows, has no model. One class only: it is predicted, score 0.5 at most.
        """
        sizes = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("y")).collect()
        n, y = sum(r.n for r in sizes), sum(r.y for r in sizes)
        models = [r.fold for r in sizes if r.fold is not None and 0 <= r.fold < k and r.n < n]
        classes = [] if self.task == "regression" else sorted(r.label for r in rows.select(F.col("label").cast("double")).distinct().collect())
        outputs = len(classes) if self.task == "multiclass" else 1
        flat = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "features"], vector_to_array("features").alias("_x"))
        if not models:
            return flat.limit(0).drop("_x").withColumns({"prediction": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
        start = {}
        for r in sizes:
            if r.fold not in models:
                continue
            mean = (y - r.y) / (n - r.n)
            if self.task == "binary":
                share = min(max((mean - classes[0]) / ((classes[-1] - classes[0]) or 1.0), 1e-6), 1 - 1e-6)
                start[r.fold] = np.array([math.log(share / (1 - share))])
            else:
                start[r.fold] = np.full(outputs, mean if self.task == "regression" else 0.0)
        binned, features = self._binned(flat, classes)
        if n * (2 * features + 24 * outputs + 100) <= TASK_BYTES:
            return self._in_tasks(binned, start, classes)
        state, parts = self._in_parts(binned, n, models)
        since: dict[int, list[Trees]] = {m: [] for m in models}
        for done in range(1, self.rounds + 1):
            growing = {m: Trees(outputs, self.depth) for m in models}
            for level in range(self.depth):
                found: dict[int, list] = {m: [] for m in models}
                for r in self._level(state, parts, start, since, growing, level):
                    found[r.model].append(r)
                for m, splits in found.items():
                    self._grow(growing[m], splits, level)
            for m in models:
                since[m].append(growing[m])
            if done % STORED_ROUNDS == 0 and done < self.rounds:
                state, since = keep(self._scored(state, start, since)), {m: [] for m in models}
        return self._predicted(state, start, since, classes)

    # --- a model in a task -----------------------------------------------------------

    def _boosted(self, bins: np.ndarray, y: np.ndarray, asked: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Scores of the rows ``asked`` by a model of all rounds from the others."""
        (n, features), classes, n_bins = bins.shape, len(start), self.bins
        columns, width = bin_columns(bins, n_bins)
        score, out = np.repeat(start[:, None], n, 1), np.tile(start, (len(asked), 1))
        g, h, flat, first = np.empty_like(score), np.empty_like(score), bins.ravel(), np.arange(n) * features
        names = ("node", "feature", "bin", "g", "h", "gl", "hl")
        for _ in range(self.rounds):
            for a in range(0, n, CHUNK):
                some = slice(a, a + CHUNK)
                g[:, some], h[:, some] = (x.T for x in gradients(self.task, np.ascontiguousarray(score[:, some].T), y[some]))
            trees = Trees(classes, self.depth)
            for c in range(classes):
                node, nodes = np.zeros(n, np.int64), 1
                sums = feature_sums(column_sums(columns, width, g[c], h[c], node, 1), features, n_bins)
                for level in range(self.depth):
                    self._grow(trees, [{"class": c, **dict(zip(names, s))} for s in best_splits(sums)], level)
                    at = node + (nodes - 1)
                    node = 2 * node + (flat.take(first + trees.feature[c].take(at)) > trees.bin[c].take(at))
                    if level < self.depth - 1:
                        size, nodes, above = np.bincount(node, minlength=2 * nodes), 2 * nodes, sums
                        fewer = np.arange(0, nodes, 2) + (size[1::2] < size[::2])
                        rows = np.flatnonzero(np.isin(np.arange(nodes), fewer).take(node))
                        below = column_sums(columns, width, g[c].take(rows), h[c].take(rows), node.take(rows) >> 1, nodes // 2, rows)
                        sums = np.empty((2, nodes, features, n_bins))
                        sums[:, fewer] = feature_sums(below, features, n_bins)
                        sums[:, fewer ^ 1] = above - sums[:, fewer]
                score[c] += trees.leaf[c].take(node)
            trees.add_to(out, asked)
        return out

    def _in_tasks(self, binned: DataFrame, start: dict, classes: list[float]) -> DataFrame:
        state = keep(binned.withColumn("id", F.monotonically_increasing_id()))
        models = F.array(*[F.lit(m) for m in start])
        dealt = state.withColumn("model", F.explode(models))
        # One task for each model: a hash could put several into one. Rows it learns from leave their columns behind.
        dealt = dealt.withColumn("row", F.when(F.col("fold") == F.col("model"), F.col("row"))).repartitionByRange(len(start), "model")

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")  # sums depend on the order, in their last digits
            m = table.column("model")[0].as_py()
            asked = table.column("fold").fill_null(-1).to_numpy() == m
            bins, y, row = fixed_bytes(table.column("bins")), table.column("y").to_numpy(), table.column("row").filter(pa.array(asked))
            bins, y, others = bins[~asked], y[~asked], bins[asked]
            del table
            prediction, chance = self._answers(self._boosted(bins, y, others, start[m]), classes)
            return pa.table({
                "row": row, "prediction": pa.array(prediction, pa.float64()), "score": pa.array(chance, pa.float64()),
            })

        out = dealt.groupBy("model").applyInArrow(run, f"row {state.schema['row'].dataType.simpleString()}, prediction double, score double")
        return out.select("row.*", "prediction", "score")

    def _answers(self, score: np.ndarray, classes: list[float]) -> tuple[np.ndarray, list]:
        """Prediction of each row, and the probability of the second of two classes."""
        if self.task == "regression":
            return score[:, 0], [None] * len(score)
        if self.task == "binary":
            p = 1 / (1 + np.exp(-score[:, 0]))
            return np.where(p > 0.5, classes[-1], classes[0]), p.tolist()
        return np.array(classes)[score.argmax(1)], [None] * len(score)

    # --- rows in parts ---------------------------------------------------------------

    def _scored(self, state: DataFrame, start: dict, since: dict) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                score: list = [None] * batch.num_rows
                for m, rows, bins in self._by_model(batch):
                    for i, s in zip(rows.tolist(), self._scores(batch, rows, bins, start[m], since[m])):
                        score[i] = s.tobytes()
                out = batch.drop_columns(["score"]) if "score" in batch.schema.names else batch
                yield out.append_column("score", pa.array(score, pa.binary()))

        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema.fields if f.name != "score")
        return state.mapInArrow(run, f"{fields}, score binary")

    def _predicted(self, state: DataFrame, start: dict, since: dict, classes: list[float]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held: list[list] = [[], [], []]
                for m, rows, bins in self._by_model(batch):
                    score = self._scores(batch, rows, bins, start[m], since[m])
                    prediction, chance = self._answers(score, classes)
                    for column, x in zip(held, (rows.tolist(), prediction.tolist(), chance)):
                        column.extend(x)
                yield pa.record_batch({
                    "row": batch.column("row").take(pa.array(held[0], pa.int64())), "prediction": pa.array(held[1], pa.float64()),
                    "score": pa.array(held[2], pa.float64()),
                })

        mine = state.filter(F.col("fold") == F.col("model"))
        out = mine.mapInArrow(run, f"row {state.schema['row'].dataType.simpleString()}, prediction double, score double")
        return out.select("row.*", "prediction", "score")
