"""Random forests whose trees are each grown in one task, from a block of stored, binned rows.

Features are binned to bytes once. Rows are dealt into blocks by a hash of their number: as many as
the rows need, but no more than there are trees, so every row is in the block of some tree. A tree
takes a bootstrap of its block, drawn with the model's and the tree's number as key, so that a lost
task grows the same tree again, however trees are put together in tasks. Grown trees are rows of a
stored table; they meet the rows they predict in a join of blocks. The driver sees neither.

A task holds one block: BLOCK_ROWS rows of a byte per feature or, if the table has more than that
times the trees, its share of the rows (more trees make it smaller).
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

from fixatio.operators.boosting import bin_edges, binned_rows
from fixatio.plans.stages import keep

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks bring this module along

BINS = 256
BLOCK_ROWS = 100_000  # rows a tree is grown from
PART_ROWS = 200_000  # rows of a fold that meet a group of trees at once
TREE_GROUP = 25  # trees that meet rows at once, if a block has BLOCK_ROWS rows
CELLS = 1 << 16  # (row, feature) cells sorted at once, or one feature of all rows
COUNTED = 96  # rows from which a node's splits are found by counting rows by bin
ALL_ROWS = -1  # number of the model that leaves no fold out

# The mean target of the leaves, in order: the entries that are not 0, numbered (leaf x targets).
_TREE = "model int, tree int, feature array<int>, cut array<int>, left array<int>, entry array<int>, share array<double>, gain array<double>"


def _slot_bins(bins: np.ndarray, rows: np.ndarray, node: np.ndarray, picked: np.ndarray):
    """Slice of the slots -> the bin of each of the rows in the feature that a slot has at the row's node."""
    if picked.shape[1] == bins.shape[1] and (picked == picked[0]).all():  # all of them: a column after the other
        return np.ascontiguousarray(bins.take(rows, 0).T[picked[0]]).__getitem__
    flat, first, features = bins.ravel(), rows * bins.shape[1], np.ascontiguousarray(picked.T)
    return lambda some: flat.take(first + features[some].take(node, 1))


def _rises(gain: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Sums differ in the last digits with the order of rows; near ties are ties."""
    return gain > best + np.where(np.isinf(best), 0.0, 1e-9 * np.abs(best))


def _counted(bins, rows, weight, target, node, w, s, parent, picked):
    """Best (slot, cut, gain) of each node from sums by node and bin, CELLS cells or sums at a time."""
    (nodes, tried), n, width, classes = picked.shape, len(rows), s.shape[1], target.ndim == 1
    best, slot, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, int)
    slot_bins, first = _slot_bins(bins, rows, node, picked), (node * width + target if classes else node) * 256
    columns, size = () if classes else np.ascontiguousarray(target.T), nodes * 256 * (width if classes else 1)
    step = max(1, CELLS // max(n, size))
    for f in range(0, tried, step):
        place = first + slot_bins(slice(f, f + step))
        m = len(place)
        place[1:] += np.arange(size, m * size, size)[:, None]
        place = place.ravel()
        sums_of = lambda c, *shape: np.cumsum(np.bincount(place, c if m == 1 else np.tile(c, m), m * size).reshape(m, nodes, *shape, 256), -1)
        if classes:
            sums = sums_of(weight, width)
            lw, sums = sums.sum(2), np.moveaxis(sums, 2, 0)
        else:
            lw, sums = sums_of(weight), map(sums_of, columns)
        left, right = np.zeros_like(lw), np.zeros_like(lw)
        for k, ls in enumerate(sums):
            rs = s[:, k, None] - ls
            left += ls * ls
            right += rs * rs
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left / lw + right / (w[:, None] - lw) - parent[:, None]
        gain[(lw <= 0) | (lw >= w[:, None])] = -np.inf  # a side without rows
        tops = gain.max(2)
        top = tops.max(0)
        least = top - 1e-9 * np.abs(top)
        who = np.flatnonzero(_rises(top, best))
        which = (tops >= least).argmax(0)[who]
        at = (gain[which, who] >= least[who, None]).argmax(1)
        best[who], slot[who], cut[who] = gain[which, who, at], f + which, at
    return slot, cut, best


def _sums_of_rows(weight, weighted, node, w, s, starts):
    """What tells the rows of a node apart, its bits, and: that, in order of node and bin -> running
    weight and target sums inside the node."""
    base, targets = starts[node], np.ascontiguousarray(weighted.T)
    before_w, before_s = (np.cumsum(w) - w)[node], (np.cumsum(s, 0) - s)[node].T  # rows of other nodes

    def sums(low):
        row = low.astype(int) + base
        return np.cumsum(weight[row], 1) - before_w, (np.cumsum(t[row], 1) - b for t, b in zip(targets, before_s))

    place = np.arange(len(node)) - base
    return place, int(place.max() + 1).bit_length(), sums


def _sums_of_classes(weight, label, node, w, s, starts):
    """The same for classes: rows of a class and weight are alike, and one running sum holds several
    classes, as the sums of a node need few bits each (what overflows before it cancels)."""
    heavy, field, width = int(weight.max()).bit_length(), int(w.max()).bit_length(), s.shape[1]
    low, together = label << heavy | weight.astype(int), 63 // field
    kinds, much = np.divmod(np.arange(int(low.max()) + 1), 1 << heavy)
    packs = []
    for a in range(0, width, together):
        mine = range(a, min(width, a + together))
        pack = sum(s[:, k].astype(int) << field * (k - a) for k in mine)
        packs.append((np.where((kinds >= a) & (kinds < a + together), much << field * ((kinds - a) % together), 0), (np.cumsum(pack) - pack)[node], len(mine)))

    def sums(low):
        out = []
        for table, before, n in packs:
            run = np.cumsum(table[low], 1) - before
            out += [run >> field * k & (1 << field) - 1 for k in range(n)]
        return sum(out), out

    return low, int(low.max()).bit_length(), sums


def _sorted(bins, rows, weight, target, node, w, s, parent, picked):
    """The same from the rows in order of node and bin, CELLS cells at a time."""
    (nodes, tried), n = picked.shape, len(rows)
    best, slot, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, int)
    order = np.argsort(node.astype(np.uint16) if nodes <= 1 << 16 else node, kind="stable")
    rows, weight, target, node = rows[order], weight[order], target[order], node[order]
    slot_bins, last = _slot_bins(bins, rows, node, picked), np.r_[node[1:] != node[:-1], True]
    starts = np.r_[0, np.flatnonzero(last)[:-1] + 1]
    # A cell is one number: node, bin, and what tells the rows of the node apart.
    low, bits, sums = (_sums_of_classes if target.ndim == 1 else _sums_of_rows)(weight, target, node, w, s, starts)
    whole = np.uint32 if nodes << (bits + 8) < 1 << 32 else np.uint64
    first = (node.astype(whole) << (bits + 8)) + low.astype(whole)
    own_w, own_s, own_parent = w[node], s[node].T, parent[node]
    step = max(1, CELLS // n)
    for f in range(0, tried, step):
        cells = first + (slot_bins(slice(f, f + step)).astype(whole) << bits)
        cells.sort(axis=1)
        low, cells = cells & ((1 << bits) - 1), cells >> bits
        (lw, parts), left, right = sums(low), 0.0, 0.0
        for k, ls in enumerate(parts):
            rs = own_s[k] - ls
            left = left + ls * ls
            right = right + rs * rs
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left / lw + right / (own_w - lw) - own_parent
        gain[:, last] = -np.inf
        gain[:, :-1][cells[:, 1:] == cells[:, :-1]] = -np.inf  # cuts come after the last row of a bin
        tops = np.maximum.reduceat(gain, starts, axis=1)
        top = tops.max(0)
        least = top - 1e-9 * np.abs(top)
        which, better = (tops >= least).argmax(0), _rises(top, best)
        mine = gain[which[node], np.arange(n)]
        hit = np.flatnonzero((mine >= least[node]) & better[node])
        who, i = np.unique(node[hit], return_index=True)
        i = hit[i]
        best[who], slot[who], cut[who] = mine[i], f + which[who], cells[which[who], i] & 255
    return slot, cut, best


def level_splits(bins, weight, target, node, w, s, picked, rows=None):
    """Best (feature, cut, gain) of each node; feature -1 where the picked features are constant.

    ``rows`` are the rows of ``bins`` that take part (all), ``node`` numbers the node of each, and
    ``target`` is its target times its weight or, for 0/1 targets of classes, the number of its class.
    ``w`` and ``s`` are the nodes' weights and target sums, ``picked`` the features each node may use.
    Rows whose bin exceeds the cut go to the right. The gain is the decrease of the weighted squared
    error, which for classes is the decrease of the Gini impurity. Ties go to the feature picked
    first, then the lowest cut. Nodes of at least COUNTED rows are searched by counting, the others
    by sorting. Only the picked features of a row are read.
    """
    nodes, rows = len(w), np.arange(len(bins)) if rows is None else rows
    feature, cut, best, parent = np.full(nodes, -1), np.zeros(nodes, int), np.full(nodes, -np.inf), (s * s).sum(1) / w
    large = np.bincount(node, minlength=nodes) >= COUNTED
    for search, chosen in ((_counted, large), (_sorted, ~large)):
        some, at = np.flatnonzero(chosen), np.flatnonzero(chosen[node])
        if len(some):
            number = np.cumsum(chosen) - 1
            slot, cut[some], best[some] = search(
                bins, rows[at], weight[at], target[at], number[node[at]], w[some], s[some], parent[some], picked[some]
            )
            feature[some] = np.where(slot >= 0, picked[some, slot], -1)
    return feature, cut, best


def grow(bins: np.ndarray, target: np.ndarray, rng: np.random.Generator, tried: int, depth: int) -> dict[str, np.ndarray]:
    """One tree on a bootstrap of the rows: ``feature`` (-1: leaf), ``cut``, ``left`` (the right child
    follows it) and mean target of each node, and the gain of each feature, which sum to 1.

    Nodes are split until they are pure, their picked features constant, or the depth reached.
    The binned rows stay where they are; a level only has the numbers of its rows, in order of node.
    """
    (n, d), width = bins.shape, target.shape[1]
    drawn = np.bincount(rng.integers(n, size=n), minlength=n)
    bins, weight, target = bins[drawn > 0], drawn[drawn > 0].astype(float), target[drawn > 0]
    square = (target * target).sum(1) * weight
    classes = width > 1 and ((target == 0) | (target == 1)).all() and (target.sum(1) == 1).all()
    target = target.argmax(1) if classes else target * weight[:, None]
    out: dict[str, list] = {"feature": [], "cut": [], "left": [], "value": []}
    gain_of, at, node, nodes, end = np.zeros(d), np.arange(len(bins)), np.zeros(len(bins), int), 1, 1
    for level in range(depth + 1):
        w = np.bincount(node, weight, nodes)
        if classes:
            s = np.bincount(node * width + target, weight, nodes * width).reshape(nodes, width)
        else:
            s = np.stack([np.bincount(node, column, nodes) for column in target.T], 1)
        q = np.bincount(node, square, nodes)
        feature, cut, left = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes, int)
        impure = np.flatnonzero(q - (s * s).sum(1) / w > 1e-9 * q)
        if level < depth and len(impure):
            picked = np.tile(np.arange(d), (len(impure), 1)) if tried == d else rng.random((len(impure), d)).argpartition(tried, 1)[:, :tried]
            renumbered = np.full(nodes, -1)
            renumbered[impure] = np.arange(len(impure))
            rows = np.flatnonzero(renumbered[node] >= 0)
            f, c, g = level_splits(bins, weight[rows], target[rows], renumbered[node[rows]], w[impure], s[impure], picked, at[rows])
            feature[impure], cut[impure] = f, c
            np.add.at(gain_of, f[f >= 0], np.maximum(g[f >= 0], 0.0))
        split = np.flatnonzero(feature >= 0)
        left[split] = 2 * np.arange(len(split))
        for name, part in (("feature", feature), ("cut", cut), ("left", left + end), ("value", s / w[:, None])):
            out[name].append(part)
        rows = np.flatnonzero(feature[node] >= 0)
        if not len(rows):
            break
        old, row = node[rows], at[rows]
        new = left[old] + (bins.ravel().take(row * d + feature[old]) > cut[old])
        nodes, end = 2 * len(split), end + 2 * len(split)
        order = np.argsort(new.astype(np.uint16) if nodes <= 1 << 16 else new, kind="stable")
        rows, node, at = rows[order], new[order], row[order]
        weight, target, square = weight[rows], target[rows], square[rows]
    total = gain_of.sum()
    return {**{name: np.concatenate(parts) for name, parts in out.items()}, "gain": gain_of / total if total > 0 else gain_of}


def walk(tree: dict[str, np.ndarray], bins: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    at, rows = np.zeros(len(bins), int), np.arange(len(bins))
    while (inner := tree["feature"][at] >= 0).any():
        on, here = rows[inner], at[inner]
        at[inner] = tree["left"][here] + (bins[on, tree["feature"][here]] > tree["cut"][here])
    return at


def leaf_entries(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The entries of the leaves' mean targets that are not 0: a pure leaf of a class has one."""
    value = tree["value"][tree["feature"] < 0].ravel()
    entry = np.flatnonzero(value)
    return {"entry": entry, "share": value[entry]}


def leaf_values(tree: dict[str, np.ndarray], width: int) -> np.ndarray:
    """Back from the entries: the mean target of each leaf."""
    value = np.zeros(int((tree["feature"] < 0).sum()) * width)
    value[tree["entry"]] = tree["share"]
    return value.reshape(-1, width)


def _bytes(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(table.num_rows, -1)


def _lists(table: pa.Table, name: str) -> Iterator[np.ndarray]:
    """The lists of a column as arrays, without a Python number for each element."""
    column = table.column(name).combine_chunks()
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    yield from (values[a:b] for a, b in zip(ends[:-1], ends[1:]))


class BlockForest:
    """A forest for a ``task`` (class, regression); a node tries ``tried`` features (sqrt, all)."""

    def __init__(self, task: str, trees: int, depth: int, seed: int, tried: str):
        self.task, self.trees, self.depth, self.seed, self.tried = task, trees, depth, seed, tried

    def getNumTrees(self) -> int:  # noqa: N802 (the name that Spark ML's forests have)
        return self.trees

    def _prepared(self, rows: DataFrame) -> tuple[DataFrame, list[float]]:
        """Stored (row, fold, y, bins, id), and the classes in order."""
        flat = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c != "features"], vector_to_array("features").alias("_x"))
        classes = [] if self.task == "regression" else sorted(r.label for r in rows.select(F.col("label").cast("double").alias("label")).distinct().collect())
        binned = binned_rows(flat, bin_edges(flat, BINS), classes)
        return keep(binned.withColumn("id", F.monotonically_increasing_id())), classes

    def _blocks(self, n: int) -> int:
        return min(self.trees, max(1, math.ceil(n / BLOCK_ROWS)))

    def _parts(self, n: int) -> int:
        """Parts of a fold's ``n`` rows: trees are much larger than rows, and go to every part."""
        return max(1, math.ceil(n / PART_ROWS))

    def _grown(self, state: DataFrame, n: int, models: list[int], classes: list[float]) -> DataFrame:
        """Stored trees; a model's trees learn from the rows outside its fold."""
        blocks = self._blocks(n)
        wanted = math.ceil(4 * state.sparkSession.sparkContext.defaultParallelism / (blocks * len(models)))
        chunks = max(1, min(wanted, math.ceil(self.trees / blocks)))
        trees, depth, seed, tried_of = self.trees, self.depth, self.seed, self.tried

        def grow_some(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            model, block, chunk = (table.column(c)[0].as_py() for c in ("model", "block", "chunk"))
            bins, y = _bytes(table), table.column("y").to_numpy()
            target = np.eye(len(classes))[y.astype(int)] if classes else y[:, None]
            tried = max(1, math.isqrt(bins.shape[1])) if tried_of == "sqrt" else bins.shape[1]
            out: dict[str, list] = {name: [] for name in ("tree", "feature", "cut", "left", "entry", "share", "gain")}
            for t in range(block + blocks * chunk, trees, blocks * chunks):
                tree = grow(bins, target, np.random.default_rng([seed, model + 1, t]), tried, depth)
                out["tree"].append(t)
                for name, column in {**tree, **leaf_entries(tree)}.items():
                    if name in out:
                        out[name].append(column)
            ints = pa.list_(pa.int32())
            return pa.table({
                "model": pa.array([model] * len(out["tree"]), pa.int32()), "tree": pa.array(out["tree"], pa.int32()),
                **{name: pa.array(out[name], ints) for name in ("feature", "cut", "left", "entry")},
                **{name: pa.array(out[name], pa.list_(pa.float64())) for name in ("share", "gain")},
            })

        dealt = state.select("id", "fold", "y", "bins", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
        dealt = dealt.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))).filter(~F.col("fold").eqNullSafe(F.col("model")))
        dealt = dealt.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
        # One task for each group: a hash could put several into one.
        number = (F.array_position(F.array(*[F.lit(m) for m in models]), F.col("model")) * blocks + F.col("block")) * chunks + F.col("chunk")
        spread = dealt.drop("fold").withColumn("task", number).repartitionByRange(len(models) * blocks * chunks, "task")
        return keep(spread.groupBy("task").applyInArrow(grow_some, _TREE))

    def cross_predict(self, rows: DataFrame, k: int) -> DataFrame:
        """Out-of-fold predictions: the columns but the features, ``prediction`` and ``score``
        (two classes: the probability of the second; else null).

        ``rows`` has ``features``, ``label`` and ``fold``; the label must not be null. A fold without
        rows, or that holds all rows, has no model. One class only is always predicted.
        """
        sizes = rows.groupBy("fold").agg(F.count("*").alias("n")).collect()
        n = sum(r.n for r in sizes)
        models = [r.fold for r in sizes if r.fold is not None and 0 <= r.fold < k and r.n < n]
        if not models:
            return rows.drop("features").limit(0).withColumns({"prediction": F.lit(None).cast("double"), "score": F.lit(None).cast("double")})
        state, classes = self._prepared(rows)
        forest = self._grown(state, n, models, classes)
        width, parts = max(1, len(classes)), self._parts(max(r.n for r in sizes if r.fold in models))
        together = max(1, TREE_GROUP * BLOCK_ROWS // max(BLOCK_ROWS, n // self._blocks(n)))
        groups = math.ceil(self.trees / together)

        def vote(some: pa.Table, trees: pa.Table) -> pa.Table:
            total, trees = np.zeros((some.num_rows, width)), trees.sort_by("tree")
            if some.num_rows:
                bins, names = _bytes(some), ("feature", "cut", "left", "entry", "share")
                for columns in zip(*[_lists(trees, name) for name in names]):
                    tree = dict(zip(names, columns))
                    leaf = np.cumsum(tree["feature"] < 0) - 1
                    total += leaf_values(tree, width)[leaf[walk(tree, bins)]]
            ends = pa.array(np.arange(0, total.size + 1, width), pa.int32())
            return pa.table({"id": some.column("id").cast(pa.int64()), "votes": pa.ListArray.from_arrays(ends, pa.array(total.ravel()))})

        asked = state.filter(F.col("fold").isin(models)).select(
            "id", "bins", F.col("fold").alias("model"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"),
            F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"),
        )
        given = forest.select(
            "model", "tree", "feature", "cut", "left", "entry", "share", F.floor(F.col("tree") / together).cast("int").alias("grp"),
            F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        )
        key = ["model", "part", "grp"]
        votes = asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInArrow(vote, "id long, votes array<double>")
        mean = F.array(*[F.round(F.sum(F.col("votes")[i]) / self.trees, 12) for i in range(width)])
        per_row = votes.groupBy("id").agg(mean.alias("_mean"))
        if classes:
            place = F.array_position("_mean", F.array_max("_mean")).cast("int")
            prediction = F.element_at(F.array(*[F.lit(c) for c in classes]), place)
        else:
            prediction = F.col("_mean")[0]
        score = F.col("_mean")[1] if len(classes) == 2 else F.lit(None).cast("double")
        return state.select("id", "row").join(per_row, "id").select("row.*", prediction.alias("prediction"), score.alias("score"))

    def importances(self, rows: DataFrame) -> DataFrame:
        """(place, importance): each feature's share of a tree's gain, averaged over trees grown on all
        rows; trees without a split do not count."""
        state, classes = self._prepared(rows.withColumn("fold", F.lit(None).cast("int")))
        forest = self._grown(state, state.count(), [ALL_ROWS], classes).filter(F.size("feature") > 1)
        gains = forest.select("tree", F.posexplode("gain").alias("place", "gain"))
        return gains.groupBy("place").agg(F.avg("gain").alias("importance"))
