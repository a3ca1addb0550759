"""Removal of repeated byte strings with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere in the corpus.

1. Every window of that length selects the least hash among its grams of ``GRAM`` bytes (its
   anchor), so equal windows have equal anchors. The windows of one anchor form a context. Anchors
   that occur once cannot lie in a repeat; contexts that occur twice are repeats as a whole. Only
   contexts that share an anchor but differ need to be compared.
2. Those are gathered by anchor into shards of bounded size. A shard sorts all its suffixes
   (Larsson-Sadakane) and takes neighbours' common prefixes (Kasai): windows with a common prefix
   of the full length are repeats.
3. An anchor with very many contexts is spread over several shards. Each of these cuts its sorted
   windows into ranges, and a range's runs from all shards are merged by binary search.
4. A document's removed stretches are put together and cut out.

Texts travel once to meet what is known of them, and those with open contexts once more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixatio.llm.common import byte_buffer, row_key, slices, store
from fixatio.llm.suffix import common_prefixes, suffix_array
from fixatio.llm.textbytes import mix, prefix_sums, span_hash

LENGTH, GRAM = 200, 48
LONGEST = 1 << 23  # bytes that are looked at in one go; places have 24 bits
FLUSH = 500_000  # anchors that a task gathers before it sends them on
BUCKET = 250_000  # anchors of a bucket, about
HOT = 64  # contexts of an anchor within a flush that make it a hot one, dealt by context as well
SHARD_BYTES, SPLIT = 3_000_000, 8192  # text of a shard; contexts of an anchor in one shard, about
_ENTRY = np.dtype([("h", "<u8"), ("c", "<u8"), ("doc", "<u4"), ("s", "<u4"), ("n", "u1"), ("off", "u1"), ("many", "u1")])
_DOC, _MARK, _OPEN, _ANCHORS = 0, 1, 2, 3
_FOUND = "kind int, slot long, k1 long, k2 long, s int, e int, h long, c long, need boolean, data binary"


def anchors(data: np.ndarray, at: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Anchors of texts in a buffer: hash, hash of context, first and last window, anchor's place."""
    n, w = len(data), length - gram + 1
    if n > LONGEST + length:
        # Windows in turns. A context that is cut there differs from whole ones of its anchor, and
        # is compared with them.
        parts = []
        for lo in range(0, n - length + 1, LONGEST):
            piece = data[lo:lo + LONGEST + length - 1]
            h, c, *places = anchors(piece, np.clip(at - lo, 0, len(piece)), length, gram)
            parts.append((h, c, *(x + lo for x in places)))
        return tuple(np.concatenate(x) for x in zip(*parts))
    size = np.diff(at)
    starts = np.flatnonzero(np.arange(n) + length <= np.repeat(at[1:], size)) if n >= length else np.zeros(0, np.int64)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    sums = prefix_sums(data)
    m = n - gram + 1
    place = np.arange(m)
    h = span_hash(sums, place, place + gram)
    # Least hash (its upper 40 bits), first place, over w grams in a row: minima to the left and
    # right of every w-th gram.
    low = np.uint64((1 << 24) - 1)
    key = np.full(-(-m // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[:m] = h & ~low | place.astype(np.uint64)
    rows = key.reshape(-1, w)
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    left = np.minimum.accumulate(rows, axis=1).ravel()
    chosen = (np.minimum(right[starts], left[starts + w - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    p, s, e = chosen[new], starts[new], starts[np.append(new[1:] - 1, len(starts) - 1)]
    context = mix(span_hash(sums, s, e + length) ^ mix((p - s).astype(np.uint64) + np.uint64(1)))
    return h[p], context, s, e, p


def merged(spans: np.ndarray) -> np.ndarray:
    """Stretches (from, to), sorted, those that touch or overlap as one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    head = np.flatnonzero(new)
    return np.stack([spans[head, 0], reach[np.append(head[1:] - 1, len(spans) - 1)]], 1)


def _rows(kind: int, n: int, **columns) -> pa.RecordBatch:
    types = {
        "slot": pa.int64(), "k1": pa.int64(), "k2": pa.int64(), "s": pa.int32(), "e": pa.int32(), "h": pa.int64(),
        "c": pa.int64(), "need": pa.bool_(), "data": pa.binary(),
    }
    return pa.record_batch({
        "kind": pa.array(np.full(n, kind, np.int32)),
        **{c: pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in types.items()},
    })


def _marks(doc: np.ndarray, spans: np.ndarray, base: int) -> tuple[list[int], list[bytes]]:
    """Merged stretches of each document as bytes."""
    order = np.argsort(doc, kind="stable")
    doc, spans = doc[order], spans[order]
    cut = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
    return (
        [base + int(doc[i]) for i in cut],
        [merged(x).astype("<i4").tobytes() for x in np.split(spans, cut[1:])] if len(cut) else [],
    )


def _scan(buckets: int, length: int, gram: int):
    """Anchors by bucket, stretches that repeat within a task, and the documents' keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() << 36
        base, held, n_held = slot, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            found = np.concatenate(held)
            found = found[np.lexsort((found["c"], found["h"]))]
            h, c = found["h"], found["c"]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            group = np.cumsum(new) - 1
            many = np.bincount(group) > 1
            twice = found[many[group]]
            s = twice["s"].astype(np.int64)
            slots, data = _marks(twice["doc"].astype(np.int64), np.stack([s, s + twice["n"] + length], 1), base)
            yield _with_bucket(_rows(_MARK, len(slots), slot=slots, data=data), mix(np.array(slots, np.uint64)) % np.uint64(buckets))
            one = found[new].copy()
            one["many"] = many
            # Contexts of a hot anchor are dealt by context, and the anchor's own bucket is told.
            head = np.concatenate([[True], one["h"][1:] != one["h"][:-1]])
            hot = (np.bincount(np.cumsum(head) - 1) >= HOT)[np.cumsum(head) - 1]
            told = one[hot & head].copy()
            told["many"] = 2
            one["many"][hot] += 4
            where = mix(np.where(hot, one["h"] ^ mix(one["c"]), one["h"])) % np.uint64(buckets)
            one, where = np.concatenate([one, told]), np.concatenate([where, mix(told["h"]) % np.uint64(buckets)])
            order = np.argsort(where, kind="stable")
            one, where = one[order], where[order]
            cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
            parts = [x.tobytes() for x in np.split(one, cut[1:])]
            yield _with_bucket(_rows(_ANCHORS, len(parts), slot=[base] * len(parts), data=parts), where[cut])

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                data, at = byte_buffer(part.column("text"))
                h, c, s, e, p = anchors(data, at, length, gram)
                if len(h):
                    doc = np.searchsorted(at, s, side="right") - 1
                    entry = np.zeros(len(h), _ENTRY)
                    entry["h"], entry["c"], entry["doc"] = h, c, slot - base + doc
                    entry["s"], entry["n"], entry["off"] = s - at[doc], e - s, p - s
                    held.append(entry)
                    n_held += len(h)
                    docs = np.unique(doc)
                    slots = slot + docs
                    yield _with_bucket(
                        _rows(_DOC, len(docs), slot=slots, k1=part.column("_k1").to_numpy()[docs], k2=part.column("_k2").to_numpy()[docs]),
                        mix(slots.astype(np.uint64)) % np.uint64(buckets),
                    )
                slot += part.num_rows
                if n_held >= FLUSH:
                    yield from flush()
                    base, held, n_held = slot, [], 0
        if n_held:
            yield from flush()

    return run


def _with_bucket(rows: pa.RecordBatch, bucket: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*rows.columns, pa.array(np.asarray(bucket).astype(np.int32))], names=[*rows.schema.names, "bucket"]
    )


def _bucket(length: int):
    """What a bucket's anchors say: stretches that repeat, and contexts that stay open."""
    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["bucket"])
        kinds = table.column("kind").to_numpy()
        out = [table.filter(pa.array(kinds != _ANCHORS))]
        own = table.filter(pa.array(kinds == _ANCHORS))
        parts = [np.frombuffer(x, _ENTRY) for x in own.column("data").to_pylist()]
        if parts:
            e = np.concatenate(parts)
            slot = np.repeat(own.column("slot").to_numpy(), [len(x) for x in parts]) + e["doc"]
            told = np.unique(e["h"][e["many"] == 2])
            keep = e["many"] != 2
            e, slot = e[keep], slot[keep]
            order = np.lexsort((slot, e["c"], e["h"]))
            e, slot = e[order], slot[order]
        if parts and len(e):
            h, c = e["h"], e["c"]
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            twice = e["many"] & 1
            times = np.bincount(group, 1 + twice)
            # Stretches of contexts that occur elsewhere; those that occur twice in a task are marked.
            full = (times[group] > 1) & (twice == 0)
            s, stop = e["s"].astype(np.int64), e["s"].astype(np.int64) + e["n"] + length
            spans = np.stack([s[full], stop[full]], 1).astype("<i4")
            out.append(pa.Table.from_batches([_rows(_MARK, int(full.sum()), slot=slot[full], data=[x.tobytes() for x in spans])]))
            # One of each context, of anchors with several.
            anchor = h[first]
            head = np.concatenate([[True], anchor[1:] != anchor[:-1]])
            number = np.cumsum(head) - 1
            several = (np.bincount(number) > 1)[number] | (e["many"][first] >= 4) | np.isin(anchor, told)
            pick = first[several]
            out.append(pa.Table.from_batches([_rows(
                _OPEN, len(pick), slot=slot[pick], s=e["s"][pick].astype(np.int32), e=(s[pick] + e["n"][pick]).astype(np.int32),
                h=h[pick].view(np.int64), c=c[pick].view(np.int64), need=times[several] == 1,
            )]))
        return pa.concat_tables([x.cast(out[-1].schema) for x in out]).combine_chunks()

    return run


def removed(data: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Merged stretches, and the bytes outside them."""
    spans = merged(spans)
    if not len(spans):
        return spans, data.tobytes()
    keep = np.concatenate([np.stack([np.append(0, spans[:, 1]), np.append(spans[:, 0], len(data))], 1)])
    return spans, b"".join(data[a:b].tobytes() for a, b in keep)


def _pairs(parts: list[bytes] | None) -> np.ndarray:
    return np.frombuffer(b"".join(parts or []), "<i4").reshape(-1, 2).astype(np.int64)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
_CONTEXT = pa.struct([("shard", pa.int64()), ("split", pa.int32()), ("h", pa.int64()), ("s", pa.int32()), ("need", pa.bool_()), ("text", pa.binary())])


def _outcome(spans: np.ndarray, kept: bytes) -> dict:
    return {"removed": [{"start": int(a), "stop": int(b)} for a, b in spans], "sha": hashlib.sha256(kept).hexdigest()}


def _meet(length: int):
    """Documents with what is known of them: those that are settled get their outcome, others
    keep their text; open contexts are cut out of the first copy of a text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                data, at = byte_buffer(part.column("text"))
                rows = []
                for i in range(part.num_rows):
                    text = data[at[i]:at[i + 1]]
                    marks, opens = part.column("marks")[i].as_py(), part.column("opens")[i].as_py() or []
                    spans = merged(_pairs(marks))
                    row = {"text": None, "marks": None, "removed": None, "sha": None, "contexts": None}
                    if any(x["need"] for x in opens):
                        row |= {"text": text.tobytes(), "marks": spans.astype("<i4").tobytes()}
                    else:
                        row |= _outcome(*removed(text, spans))
                    if part.column("copy")[i].as_py() == 1 and opens:
                        row["contexts"] = [
                            {"shard": x["shard"], "split": x["split"], "h": x["h"], "s": x["s"], "need": x["need"],
                             "text": text[x["s"]:x["e"] + length].tobytes()} for x in opens
                        ]
                    rows.append(row)
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "_k1": part.column("_k1"), "_k2": part.column("_k2"),
                    "n_bytes": pa.array(np.diff(at)), "text": pa.array([r["text"] for r in rows], pa.binary()),
                    "marks": pa.array([r["marks"] for r in rows], pa.binary()),
                    "removed": pa.array([r["removed"] for r in rows], _SPANS),
                    "sha": pa.array([r["sha"] for r in rows], pa.string()),
                    "contexts": pa.array([r["contexts"] for r in rows], pa.list_(_CONTEXT)),
                })

    return run


def repeated_windows(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the contexts in the order of their suffixes: context, place in it, whether its
    window occurs again, and whether it is the first of its equals."""
    size = np.array([len(x) for x in contexts])
    t = np.frombuffer(b"\xff".join(contexts) + b"\xff", np.uint8)  # a byte that UTF-8 has not
    start = np.cumsum(size + 1) - size - 1
    sa = suffix_array(t)
    prefix = common_prefixes(t, sa, start, size - length + 1, length)
    context = np.repeat(np.arange(len(size)), size + 1)[sa]
    place = sa - start[context]
    is_window = place <= size[context] - length
    again = prefix[:-1] >= length  # equal to the suffix before
    repeated = again | np.append(again[1:], False)
    return context[is_window], place[is_window], repeated[is_window], ~again[is_window]


def _shard(length: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        texts = table.column("text").to_pylist()
        k1, k2, s = (table.column(c).to_numpy() for c in ("_k1", "_k2", "s"))
        need, split, h = (table.column(c).to_numpy() for c in ("need", "split", "h"))
        context, place, repeated, head = repeated_windows(texts, length)
        out = {"_k1": [], "_k2": [], "h": [], "part": [], "data": []}

        def add(a, b, hash_, part, data):
            for c, v in zip(out, (a, b, hash_, part, data)):
                out[c].append(v)

        hit = repeated & need[context]
        order = np.lexsort((place[hit], context[hit]))
        owner, at = context[hit][order], place[hit][order].astype(np.int64) + s[context[hit][order]]
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        for i, begin in zip(owner[cut] if len(owner) else [], np.split(at, cut[1:]) if len(owner) else []):
            add(k1[i], k2[i], None, None, merged(np.stack([begin, begin + length], 1)).astype("<i4").tobytes())
        if split[0] > 1:  # one anchor's shard of several: its different windows, in ranges of their hash
            windows = np.frombuffer(b"".join(texts), np.uint8)
            size = np.array([len(x) for x in texts])
            begin = (np.cumsum(size) - size)[context] + place
            digest = span_hash(prefix_sums(windows), begin, begin + length)[head]
            lone = (~repeated & need[context])[head]
            run_of = np.zeros(len(digest), [("d", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i4"), ("lone", "u1")])
            run_of["d"], run_of["lone"] = digest, lone
            who = context[head]
            run_of["k1"], run_of["k2"], run_of["s"] = k1[who], k2[who], s[who] + place[head]
            run_of.sort(order="d")
            parts = (run_of["d"] >> np.uint64(32)) * np.uint64(split[0]) >> np.uint64(32)
            cut = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
            for part, x in zip(parts[cut].tolist(), np.split(run_of, cut[1:])):
                add(None, None, int(h[0]), part, x.tobytes())
        return pa.table({
            "_k1": pa.array(out["_k1"], pa.int64()), "_k2": pa.array(out["_k2"], pa.int64()), "h": pa.array(out["h"], pa.int64()),
            "part": pa.array(out["part"], pa.int32()), "data": pa.array(out["data"], pa.binary()),
        })

    return run


def _merge_runs(length: int):
    """Windows that stand alone in their shard and are found in another, by binary search."""
    kind = np.dtype([("d", "<u8"), ("k1", "<i8"), ("k2", "<i8"), ("s", "<i4"), ("lone", "u1")])

    def run(table: pa.Table) -> pa.Table:
        runs = [np.frombuffer(x, kind) for x in table.column("data").to_pylist()]
        every = np.sort(np.concatenate([x["d"] for x in runs]))
        k1, k2, data = [], [], []
        for x in runs:
            d = x["d"][x["lone"] == 1]
            times = np.searchsorted(every, d, side="right") - np.searchsorted(every, d)
            for w in x[x["lone"] == 1][times > 1]:
                k1.append(w["k1"])
                k2.append(w["k2"])
                data.append(np.array([w["s"], w["s"] + length], "<i4").tobytes())
        return pa.table({
            "_k1": pa.array(k1, pa.int64()), "_k2": pa.array(k2, pa.int64()), "data": pa.array(data, pa.binary()),
        })

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 4 << 20):
            data, at = byte_buffer(part.column("text"))
            out = [
                _outcome(*removed(data[at[i]:at[i + 1]], _pairs([part.column("marks")[i].as_py(), *(part.column("more")[i].as_py() or [])])))
                for i in range(part.num_rows)
            ]
            yield pa.record_batch({
                "doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes"),
                "removed": pa.array([x["removed"] for x in out], _SPANS), "sha": pa.array([x["sha"] for x in out], pa.string()),
            })


def repeated_strings(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM,
) -> DataFrame:
    """(doc_id, n_bytes, removed, sha): the stretches (start, stop in bytes) of each document that
    strings of ``length`` bytes found elsewhere cover, and the SHA-256 of what is left.

    A null text is empty; texts shorter than ``length`` lose nothing. Documents of equal text are
    each other's repeats, also if whole rows repeat. Null ids are fine, and an empty table gives
    an empty one; other columns are not looked at.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), *row_key(F.coalesce(F.col(text), F.lit(""))), data.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, math.ceil(2 * total / (length - gram + 2) / BUCKET))
    long = rows.filter(F.octet_length("text") >= length).select("_k1", "_k2", "text")
    found = store(
        long.mapInArrow(_scan(buckets, length, gram), f"{_FOUND}, bucket int")
        .groupBy("bucket").applyInArrow(_bucket(length), _FOUND),
        "anchors",
    )
    slots = found.filter(F.col("kind") == _DOC).select("slot", F.col("k1").alias("_k1"), F.col("k2").alias("_k2"))
    # Of equal texts every copy's own marks are all marks: those of one are taken.
    one = slots.groupBy("_k1", "_k2").agg(F.min("slot").alias("slot"))
    marks = (
        found.filter(F.col("kind") == _MARK).select("slot", "data").join(one, "slot")
        .groupBy("_k1", "_k2").agg(F.collect_list("data").alias("marks"))
    )
    opens = found.filter(F.col("kind") == _OPEN).select("slot", "s", "e", "h", "c", "need").join(slots, "slot")
    opens = store(opens.select("_k1", "_k2", "s", "e", "h", "c", "need"), "open")
    wide = opens.agg(F.sum(F.col("e") - F.col("s") + length)).first()[0] or 0
    shards = max(1, math.ceil(wide / SHARD_BYTES))
    many = store(
        opens.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > SPLIT).select(
            "h", F.ceil(F.col("n") / SPLIT).cast("int").alias("split")
        ),
        "hot-anchors",
    )
    dealt = opens.join(many, "h", "left").withColumn("split", F.coalesce("split", F.lit(1)))
    shard = F.when(
        F.col("split") == 1, F.pmod(F.xxhash64("h"), F.lit(shards))
    ).otherwise(-F.abs(F.xxhash64("h", F.pmod(F.xxhash64("c"), F.col("split")))) - 1)
    opened = dealt.withColumn("shard", shard).groupBy("_k1", "_k2").agg(
        F.collect_list(F.struct("shard", "split", "h", "s", "e", "need")).alias("opens")
    )
    known = marks.join(opened, ["_k1", "_k2"], "full_outer")
    copy = F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy(F.lit(1)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:int,stop:int>>"
    met = store(
        rows.join(known, ["_k1", "_k2"], "left").withColumn("copy", copy)
        .select("doc_id", "_k1", "_k2", "text", "marks", "opens", "copy")
        .mapInArrow(
            _meet(length),
            f"doc_id {kind}, _k1 long, _k2 long, n_bytes long, text binary, marks binary, removed {spans}, sha string, "
            "contexts array<struct<shard:long,split:int,h:long,s:int,need:boolean,text:binary>>",
        ),
        "documents",
    )
    contexts = met.filter("contexts is not null").select("_k1", "_k2", F.inline("contexts"))
    sorted_ = store(
        contexts.groupBy("shard").applyInArrow(_shard(length), "_k1 long, _k2 long, h long, part int, data binary"), "shards"
    )
    crossed = sorted_.filter("part is not null").select("h", "part", "data").groupBy("h", "part").applyInArrow(
        _merge_runs(length), "_k1 long, _k2 long, data binary"
    )
    more = (
        sorted_.filter("part is null").select("_k1", "_k2", "data").union(crossed)
        .groupBy("_k1", "_k2").agg(F.collect_list("data").alias("more"))
    )
    waiting = met.filter("text is not null").select("doc_id", "_k1", "_k2", "n_bytes", "text", "marks").join(
        more, ["_k1", "_k2"], "left"
    ).select("doc_id", "n_bytes", "text", "marks", "more")
    settled = met.filter("text is null").select("doc_id", "n_bytes", "removed", "sha")
    return settled.unionByName(
        waiting.mapInArrow(_finish, f"doc_id {kind}, n_bytes long, removed {spans}, sha string")
    )
