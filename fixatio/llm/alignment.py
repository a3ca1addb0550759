"""Alignment of two tokenizers' tokens by interval coalescing.

Both tokenizers cover the same bytes, so each token is an interval. The tokens of both, sorted by
their start, are coalesced: a group ends where a start reaches the greatest end so far. Within a
group every token of one side is linked with every one of the other. Texts are tokenized where they
are read; of each document its pairs of ids are kept, packed, with how often they are linked.

How many documents link a pair is counted with partial sums in every task. Scoring documents by
these counts needs each count where its pair occurs. The pairs that occur in more than a 65,536th of
all (document, pair) rows, of which there are at most 65,536, are handed to the tasks as one table;
all others, none of which is frequent by that very bound, meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatio.llm.common import per_worker, scratch, slices

HOT = 1 << 16  # a pair in more than this part of all rows is hot, so there are at most so many
_SLICE = 1 << 20  # bytes of text that are aligned at once
_LONG = 1 << 20  # longer texts go to the tokenizer itself
_WIDE = 1 << 14  # groups with more links are folded to distinct ids first, units with more are not kept
_GATHER = 1 << 22  # pairs that are folded at once
_FIELD = np.int64(20)  # bits of an id in a packed key
_MEET = re.compile(r"\s\s")


class ByteTokens:
    """Ids of a byte-level BPE and the bytes of each id.

    Latin-1 texts, on which all versions of the Unicode tables agree, go through a byte-pair encoder
    over the vocabulary of the tokenizer's file, if its ids are in the order of its merges; all
    others go through the tokenizer itself.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab, merges = file["model"]["vocab"], file["model"]["merges"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"] for t in file.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.bytes_of = [b""] * (1 + max(vocab.values()))
        for token, i in ranks.items():
            self.bytes_of[i] = token
        for token in special & vocab.keys():
            self.bytes_of[vocab[token]] = token.encode()
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        self.encoder = None
        if made == list(range(256, 256 + len(made))):
            self.encoder = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        out: list[list[int] | None] = [None] * len(texts)
        for i, x in enumerate(texts):
            if self.encoder is not None and len(x) < _LONG:
                try:
                    x.encode("latin-1")
                except UnicodeEncodeError:
                    continue
                out[i] = self.encoder.encode_ordinary(x)
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


class PieceTokens:
    """Ids of a sentencepiece model, which puts a space in front itself, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes_of = [
            bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in ((i, self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        ]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def coalesce(start: np.ndarray, end: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the intervals by start, and the number of the group of each in that order: a group
    breaks where a start reaches the greatest end before it."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order[1:]] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def _links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed keys (text, A id, B id) and numbers of the links of all groups; ``a`` and ``b`` lie
    group after group, n_a and n_b of them in each."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    keys, times = [], []
    wide = n_a * n_b > _WIDE
    for g in np.flatnonzero(wide).tolist():
        ids, n = np.unique(a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
        more, m = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
        keys.append((((text[g] << _FIELD) + ids)[:, None] << _FIELD).ravel().repeat(len(more)) + np.tile(more, len(ids)))
        times.append(np.outer(n, m).ravel())
    group = np.repeat(np.arange(len(n_a)), np.where(wide, 0, n_a))
    own = np.flatnonzero(~np.repeat(wide, n_a))
    again = n_b[group]
    i = np.repeat(np.arange(len(own)), again)
    j = first_b[group[i]] + np.arange(len(i)) - np.repeat(np.cumsum(again) - again, again)
    keys.append((((text[group[i]] << _FIELD) + a[own[i]]) << _FIELD) + b[j])
    times.append(np.ones(len(i), np.int64))
    if len(keys) == 1:
        return np.unique(keys[0], return_counts=True)
    key, times = np.concatenate(keys), np.concatenate(times)
    order = np.argsort(key, kind="stable")
    key = key[order]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[edge], np.add.reduceat(times[order], edge)


class Aligner:
    """Aligns texts with two encoders; keeps the tables that numpy needs, and units seen before.

    Both tokenizers end a token before a blank or line end that stands between two other characters
    than white space: no piece holds one after something else, and the byte-level pattern puts it in
    front of what follows. So a text in which no two white space characters meet falls into units
    that are tokenized and aligned each by itself, and most units are words that were seen before.
    Other texts are aligned whole.
    """

    def __init__(self, left, right, remember: int = 200_000):
        self.sides, self.remember = (left, right), remember
        self.length = [np.array([len(x) for x in s.bytes_of], np.int64) for s in self.sides]
        if max(map(len, self.length)) >= 1 << int(_FIELD):
            raise ValueError("vocabularies of 2**20 ids and more are not supported")
        self.wide = max(map(len, self.length))
        self.rendered = [f"{i}{c}".encode() for c in ",|;" for i in range(self.wide)]
        pieces = [x for s in self.sides[1:] for x in s.bytes_of if len(x) > 1]
        self.by_units = not any(b" " in x.lstrip(b" ") or b"\n" in x or (x[:2] == b"  " and x.strip(b" ")) for x in pieces)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.facts = np.zeros((0, 4), np.int64)  # n_a, n_b, n_groups, n_links of each unit
        self.shown: list[bytes] = []
        self.keys, self.key_at = np.zeros(0, np.int64), np.zeros(1, np.int64)  # its links

    def _whole(self, texts: list[bytes], side: int, ids: list[list[int]]) -> list[bool]:
        """Whether the bytes of the tokens are the text's, for each text."""
        table = self.sides[side].bytes_of
        return [b"".join([table[i] for i in x]) == text for x, text in zip(ids, texts)]

    def _core(self, flat: list[np.ndarray], count: list[np.ndarray]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Align texts that lie one after the other (both tokenizers end a token where one ends):
        their four numbers and shown groups; keys, times and offsets of the links of each."""
        n = len(count[0])
        end = [np.cumsum(self.length[s][flat[s]]) for s in (0, 1)]
        start = [e - self.length[s][flat[s]] for s, e in enumerate(end)]
        side = np.repeat(np.array([0, 1], np.int8), [len(x) for x in flat])
        order, number = coalesce(np.concatenate(start), np.concatenate(end), side)
        right = side[order].astype(bool)
        group = number[~right], number[right]  # of each token of A and of B
        n_groups = int(number[-1]) + 1
        n_a, n_b = (np.bincount(g, minlength=n_groups) for g in group)
        text = np.zeros(n_groups, np.int64)
        text[group[0]] = np.repeat(np.arange(n), count[0])
        # All tokens, group after group, A's before B's, each with the sign that follows it.
        last_a, last_b = np.cumsum(n_a), np.cumsum(n_b)
        shown = np.zeros(len(order), np.int64)
        place_a = np.arange(len(flat[0])) + (last_b - n_b)[group[0]]
        place_b = np.arange(len(flat[1])) + last_a[group[1]]
        shown[place_a], shown[place_b] = flat
        shown[place_a[last_a - 1]] += self.wide
        shown[place_b[last_b - 1]] += 2 * self.wide
        key, times = _links(*flat, n_a, n_b, text)
        linked = np.zeros(n, np.int64)
        np.add.at(linked, text, n_a * n_b)
        stops = np.concatenate([[0], np.cumsum(count[0] + count[1])]).tolist()
        signs = [self.rendered[x] for x in shown.tolist()]
        lines = [b"".join(signs[lo:hi])[:-1] for lo, hi in zip(stops, stops[1:])]
        facts = np.stack([count[0], count[1], np.bincount(text, minlength=n), linked], 1)
        return facts, lines, key, times, np.searchsorted(key >> (2 * _FIELD), np.arange(n + 1))

    def _learn(self, units: list[str]) -> None:
        """Enter new units. Those that are not given back, or have very many links, get no place."""
        latin, other = [], []
        for u in units:
            (latin if u.isascii() or max(u) < "\u0100" else other).append(u)
        for some in (latin, other):
            for lo in range(0, len(some), 1 << 15):
                self._enter(["a", *some[lo:lo + (1 << 15)]])  # the first one starts with a blank

    def _enter(self, units: list[str]) -> None:
        parts = [(u if u[0] == "\n" else " " + u) for u in units]
        data = [x.encode() for x in parts]
        joined = "".join(parts)
        flat = [np.array(s.encode([x])[0], np.int64) for s, x in zip(self.sides, (joined, joined[1:]))]
        stops, count = np.cumsum([len(x) for x in data]), []
        for s in (0, 1):
            same = b"".join([self.sides[s].bytes_of[i] for i in flat[s].tolist()]) == joined.encode()
            ends = np.cumsum(self.length[s][flat[s]])
            at = np.searchsorted(ends, stops)
            if not same or (ends[at] != stops).any():  # some unit is not given back: look for it
                if len(units) > 2:
                    middle = (1 + len(units)) // 2
                    self._enter(units[:middle])
                    self._enter(["a", *units[middle:]])
                return
            count.append(np.diff(np.concatenate([[0], at + 1])))
        facts, lines, key, times, at = self._core(flat, count)
        keep = np.flatnonzero(facts[:, 3] <= _WIDE)
        self.index.update((units[i], len(self.shown) + n) for n, i in enumerate(keep.tolist()))
        self.shown += [lines[i] for i in keep.tolist()]
        self.facts = np.concatenate([self.facts, facts[keep]])
        kept = np.isin(key >> (2 * _FIELD), keep)
        mask = np.int64((1 << int(2 * _FIELD)) - 1)
        self.keys = np.concatenate([self.keys, np.repeat(key[kept] & mask, times[kept])])
        self.key_at = np.concatenate([self.key_at, self.key_at[-1] + np.cumsum(facts[keep, 3])])

    def _units_of(self, texts: list[str | None]) -> dict[int, list[str]]:
        return {
            i: x.replace("\n", " \n").split(" ") for i, x in enumerate(texts)
            if x and not (x[0].isspace() or x[-1].isspace() or _MEET.search(x))
        }

    def align(self, texts: list[str | None]) -> dict[str, list]:
        """Per text: n_a, n_b, n_groups, n_links, groups (as bytes), and its pairs of ids with
        the number of their links (three arrays). Texts that are null or empty, or that a
        tokenizer does not give back byte by byte, have no tokens."""
        out: dict[str, list] = {k: [0] * len(texts) for k in ("n_a", "n_b", "n_groups", "n_links")}
        none = np.zeros(0, np.int64)
        out |= {"groups": [b""] * len(texts), "pairs": [(none, none, none)] * len(texts)}
        if len(self.index) > self.remember:
            self._forget()
        split = self._units_of(texts) if self.by_units else {}
        self._learn(sorted(set().union(*split.values()) - self.index.keys()))
        split = {i: units for i, units in split.items() if all(map(self.index.__contains__, units))}
        if split:
            self._put(out, list(split), *self._by_units(list(split.values())))
        live = [i for i, x in enumerate(texts) if x and i not in split]
        data = [b" " + texts[i].encode() for i in live]
        ids = [self.sides[0].encode([" " + texts[i] for i in live]), self.sides[1].encode([texts[i] for i in live])]
        good = [x and y for x, y in zip(*(self._whole(data, s, ids[s]) for s in (0, 1)))]
        live, *ids = ([x for x, ok in zip(these, good) if ok] for these in (live, *ids))
        if live:
            flat = [np.array([i for x in side for i in x], np.int64) for side in ids]
            self._put(out, live, *self._core(flat, [np.array([len(x) for x in side]) for side in ids]))
        return out

    def _by_units(self, split: list[list[str]]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """The same as ``_core`` gives for whole texts, from their units."""
        index, shown = self.index, self.shown
        units = [index[u] for words in split for u in words]
        stops = np.concatenate([[0], np.cumsum([len(w) for w in split])])
        lines = [b";".join([shown[i] for i in units[lo:hi]]) for lo, hi in zip(stops[:-1].tolist(), stops[1:].tolist())]
        u = np.array(units, np.int64)
        facts = np.add.reduceat(self.facts[u], stops[:-1])
        size = self.facts[u, 3]
        at = np.repeat(self.key_at[u] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        key = (np.repeat(np.arange(len(split)), facts[:, 3]) << (2 * _FIELD)) + self.keys[at]
        key, times = np.unique(key, return_counts=True)
        return facts, lines, key, times, np.searchsorted(key >> (2 * _FIELD), np.arange(len(split) + 1))

    def _put(self, out: dict[str, list], places: list[int], facts: np.ndarray, lines: list[bytes], key: np.ndarray, times: np.ndarray, at: np.ndarray) -> None:
        mask = np.int64((1 << int(_FIELD)) - 1)
        a, b = (key >> _FIELD) & mask, key & mask
        for k, i in enumerate(places):
            for name, x in zip(("n_a", "n_b", "n_groups", "n_links"), facts[k].tolist()):
                out[name][i] = x
            out["groups"][i] = lines[k]
            out["pairs"][i] = a[at[k]:at[k + 1]], b[at[k]:at[k + 1]], times[at[k]:at[k + 1]]


def _pairs_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row number, A id, B id and number of links of every packed pair of a batch."""
    packed = [b"".join(x or b"" for x in batch.column(c).to_pylist()) for c in ("_a", "_b", "_n")]
    a, b, n = (np.frombuffer(x, "<u4").astype(np.int64) for x in packed)
    size = np.array([len(x or b"") // 4 for x in batch.column("_n").to_pylist()], np.int64)
    return np.repeat(np.arange(batch.num_rows), size), a, b, n


def aligned(
    docs: DataFrame, left: str, right: str, pattern: str, text: str = "text", carry: list[str] | None = None,
    keep_groups: bool = True,
) -> DataFrame:
    """Every text's tokens by the byte-level BPE of file ``left`` and the sentencepiece model of file
    ``right``, aligned, and how well its links agree with those of all documents.

    Returns (row, n_a, n_b, n_groups, n_links, n_best, count_sum, groups): ``row`` is a struct of
    the columns named by ``carry`` (all by default). The count of a pair of ids is the number of rows
    that link it; n_best are the links whose count is the highest of their A id (ties included),
    count_sum is the sum over links. ``groups`` reads ``a1,a2|b1;a3|b2,b3`` (with
    ``keep_groups=False``: its SHA-256 in hex); without tokens it is empty and all numbers are 0.

    Texts that are null, empty, or not given back byte by byte have no tokens. Repeated rows count
    as documents each. An empty table gives an empty one. Memory of a task grows with the longest
    text; a group of very many tokens is folded to its distinct ids.
    """
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner = per_worker(
            "aligner", f"{left}|{right}", lambda: Aligner(ByteTokens(left, pattern), PieceTokens(right))
        )
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                found = aligner.align(part.column("text").to_pylist())
                packed = [[x[i].astype("<u4").tobytes() for x in found["pairs"]] for i in range(3)]
                groups = [
                    g.decode() if keep_groups else hashlib.sha256(g).hexdigest() if g else "" for g in found["groups"]
                ]
                yield pa.record_batch({
                    "row": part.column("row"), "_key": pa.array(range(key, key + part.num_rows), pa.int64()),
                    **{c: pa.array(found[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")},
                    "groups": pa.array(groups, pa.string()),
                    **{c: pa.array(x, pa.binary()) for c, x in zip(("_a", "_b", "_n"), packed)},
                })
                key += part.num_rows

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    frame = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    kind = frame.schema["row"].dataType.simpleString()
    counters = "n_a long, n_b long, n_groups long, n_links long, groups string"
    encoded = frame.mapInArrow(encode, f"row {kind}, _key long, {counters}, _a binary, _b binary, _n binary")
    path = scratch(spark, "aligned")
    encoded.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(encoded.schema).parquet(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch({
                "a": pa.array((pair >> _FIELD).astype(np.int32)), "b": pa.array((pair & ((1 << int(_FIELD)) - 1)).astype(np.int32)),
                "n": pa.array(n.astype(np.int64)),
            })

        for batch in batches:
            _, a, b, _ = _pairs_of(batch)
            held.append((a << _FIELD) + b)
            size += len(a)
            if size > _GATHER:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    # An A id has at most as many rows as B has ids: its window is bounded by the vocabulary.
    counted = stored.select("_a", "_b", "_n").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))
    path = scratch(spark, "pair-counts")
    counted.write.parquet(path)
    counts = spark.read.schema(counted.schema).parquet(path)
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sorted((r.a << int(_FIELD) | r.b, r.n, r.best) for r in counts.filter(F.col("n") > F.lit(total) / HOT).collect())
    hot_pair, hot_n, hot_best = (np.array([h[i] for h in hot], np.int64) for i in range(3))

    def is_hot(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(hot_pair):
            return np.zeros(len(a), np.int64), np.zeros(len(a), bool)
        pair = (a << _FIELD) + b
        at = np.minimum(np.searchsorted(hot_pair, pair), len(hot_pair) - 1)
        return at, hot_pair[at] == pair

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b, n = _pairs_of(batch)
            at, yes = is_hot(a, b)
            best, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(best, rows[yes], n[yes] * hot_best[at[yes]])
            np.add.at(total, rows[yes], n[yes] * hot_n[at[yes]])
            yield batch.drop_columns(["_a", "_b", "_n"]).append_column("_best", pa.array(best)).append_column("_sum", pa.array(total))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, a, b, n = _pairs_of(batch)
            no = ~is_hot(a, b)[1]
            key = batch.column("_key").to_numpy()[rows[no]]
            for lo in range(0, len(key), 1 << 16):
                cut = slice(lo, lo + (1 << 16))
                yield pa.record_batch({
                    "_key": pa.array(key[cut]), "a": pa.array(a[no][cut].astype(np.int32)), "b": pa.array(b[no][cut].astype(np.int32)),
                    "_n": pa.array(n[no][cut]),
                })

    rare = counts.filter(F.col("n") <= F.lit(total) / HOT)
    rest = stored.select("_key", "_a", "_b", "_n").mapInArrow(others, "_key long, a int, b int, _n long").join(rare, ["a", "b"]).groupBy("_key").agg(
        F.sum(F.when(F.col("best"), F.col("_n")).otherwise(0)).alias("_best_too"), F.sum(F.col("_n") * F.col("n")).alias("_sum_too")
    )
    scored = stored.mapInArrow(frequent, f"row {kind}, _key long, {counters}, _best long, _sum long")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    return scored.join(rest, "_key", "left").select(
        "row", "n_a", "n_b", "n_groups", "n_links", plus("_best", "_best_too").alias("n_best"),
        plus("_sum", "_sum_too").alias("count_sum"), "groups",
    )
