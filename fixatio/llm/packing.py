"""Packing of documents into sequences of a fixed number of tokens, best fit decreasing.

Texts are tokenized where they are read; what is shuffled is a few numbers per piece. Documents
longer than a window are first cut into full windows, each a sequence of its own. The rests are
dealt into groups of bounded size, and each group is packed in one task: pieces in decreasing
length, each into the open window with the least room that still holds it. A segment tree over
the remaining capacities finds that window.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import per_worker, slices, store

WINDOW = 2048
GROUP_PIECES = 4096
DOCUMENT_END = 1
_CUT = 1 << 20  # longer texts are tokenized in parts that end at a blank
_STEM = re.compile(r"([^\W\d_]+)([^\w\s']*)")
_MARK = "\x01"  # stands for the end of a word inside the encoder


class WordEncoder:
    """Ids of a BPE with word ends, for many texts: words are encoded once and remembered.

    The vocabulary's tokens and their order are read from the tokenizer's file. No token spans
    a blank, so a text's ids are those of its words. Words of Latin-1 letters go through a
    byte-pair encoder over the same vocabulary, in which a mark byte stands for the word's end;
    all other words go through the tokenizer itself.
    """

    def __init__(self, path: str, remember: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remember = remember
        self.known: dict[str, bytes] = {"": b""}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model["end_of_word_suffix"], model["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}

        def to_bytes(token: str) -> bytes:
            if token.endswith(suffix):
                return bytes(byte_of[c] for c in token[: -len(suffix)]) + _MARK.encode()
            return bytes(byte_of[c] for c in token)

        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        ends = (t for t in vocab if len(t) == 1 + len(suffix) and t.endswith(suffix))
        order = [bytes([b]) for b in range(256)] + [to_bytes(t) for t in ends] + [to_bytes(a + b) for a, b in pairs]
        ranks = {t: i for i, t in enumerate(dict.fromkeys(order))}
        self.encoder = tiktoken.Encoding(
            "words", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}
        )
        self.id_of = np.zeros(len(ranks), "<u4")
        self.ends = np.zeros(len(ranks), bool)
        for token, i in vocab.items():
            if all(c in byte_of for c in token.removesuffix(suffix)):
                rank = ranks.get(to_bytes(token))
                if rank is not None:
                    self.id_of[rank] = i
                    self.ends[rank] = token.endswith(suffix)

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that are Latin-1 letters, in lower case."""
        if not words:
            return []
        ranks = np.array(self.encoder.encode_ordinary((_MARK + " ").join(words) + _MARK))
        ids, stops = self.id_of[ranks], np.flatnonzero(self.ends[ranks]) + 1
        data, at = ids.tobytes(), [0, *(4 * stops).tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        split: dict[str, tuple[str, str]] = {}
        odd: set[str] = set()
        for word in words:
            if "<|" in word:
                odd.add(word)
                continue
            low = word.lower()
            m = _STEM.fullmatch(low)
            try:
                word.encode("latin-1")
            except UnicodeEncodeError:
                m = None
            if m and m[1].isalpha():
                split[word] = (m[1], m[2])
                if m[2] and m[2] not in self.known:
                    odd.add(m[2])
            else:
                odd.add(word)
        stems = list({s for s, _ in split.values()} - self.known.keys())
        rest = list(odd)
        found = dict(zip(stems, self._letters(stems)))
        found.update(zip(rest, (
            np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)
        )))
        known = self.known
        for word, (stem, tail) in split.items():
            if word not in found:
                a = found[stem] if stem in found else known[stem]
                found[word] = a + (found[tail] if tail in found else known[tail]) if tail else a
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        texts = [x.replace("\n", " ") for x in texts]
        for i, x in enumerate(texts):
            if "<|" not in x:
                try:
                    x.encode("latin-1")
                    texts[i] = x.lower()
                except UnicodeEncodeError:
                    pass
        split = [x.split(" ") for x in texts]
        new = list(set().union(*split) - self.known.keys())
        found = self._words(new)
        if len(self.known) + len(found) <= self.remember:
            self.known.update(found)
            get = self.known.__getitem__
            return [b"".join(map(get, words)) for words in split]
        known = self.known
        room = self.remember - len(known)
        if room > 0:
            known.update(list(found.items())[:room])
        return [b"".join([known[w] if w in known else found[w] for w in words]) for words in split]


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > _CUT:
        cut = text.find(" ", at + _CUT)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, slot) of each document, cut into full windows
    and a rest. ``ids`` are bytes, four for each id; ``slot`` numbers the pieces."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = per_worker("words", tokenizer, lambda: WordEncoder(tokenizer))
        slot, step, end = TaskContext.get().partitionId() << 36, 4 * window, np.array([DOCUMENT_END], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                texts = [x or "" for x in part.column("text").to_pylist()]
                if len(texts) == 1:
                    ids = [b"".join(encoder.encode([x])[0] for x in _parts(texts[0]))]
                else:
                    ids = encoder.encode(texts)
                rows, starts, pieces, totals = [], [], [], []
                for i, data in enumerate(ids):
                    data += end
                    for at in range(0, len(data), step):
                        rows.append(i)
                        starts.append(at // 4)
                        pieces.append(data[at:at + step])
                        totals.append(len(data) // 4)
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id").take(pa.array(rows, pa.int32())),
                        "start": pa.array(starts, pa.int64()),
                        "length": pa.array([len(x) // 4 for x in pieces], pa.int64()),
                        "ids": pa.array(pieces, pa.binary()),
                        "doc_tokens": pa.array(totals, pa.int64()),
                        "slot": pa.array(range(slot, slot + len(rows)), pa.int64()),
                    }
                )
                slot += len(rows)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, slot long"
    )


class RoomTree:
    """Counts of open windows by remaining capacity; finds the least capacity at or above a length."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, length: int) -> int:
        """-1 if no open window has the room."""
        count, at = self.count, length + self.size
        if count[at]:
            return length
        while at > 1 and (at & 1 or not count[at + 1]):  # up, until something lies to the right
            at >>= 1
        if at <= 1:
            return -1
        at += 1
        while at < self.size:  # down, to its leftmost
            at = 2 * at + (count[2 * at] == 0)
        return at - self.size


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The window and the offset in it of each piece; pieces are taken in decreasing length."""
    tree, open_at = RoomTree(capacity), {}
    window, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        length = lengths[i]
        room = tree.tightest(length)
        if room < 0:
            window[i], room = n, capacity
            n += 1
        else:
            window[i] = open_at[room].pop()
            tree.add(room, -1)
        offset[i] = capacity - room
        if room > length:
            open_at.setdefault(room - length, []).append(window[i])
            tree.add(room - length, 1)
    return window, offset


def place(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add (sequence_id, offset) to stored pieces with columns length and slot."""
    n = pieces.filter(F.col("length") < window).count()
    groups = max(1, math.ceil(n / group_pieces))
    rest = pieces.filter(F.col("length") < window).withColumn(
        "_group", F.pmod(F.xxhash64("slot"), F.lit(groups))
    )
    fields = [f for f in pieces.schema.fields]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def pack(table: pa.Table) -> pa.Table:
        order = table.sort_by("slot")
        windows, offsets = best_fit(order.column("length").to_pylist(), window)
        first = order.column("_group")[0].as_py() << 32
        return (
            order.drop_columns(["_group"])
            .append_column("sequence_id", pa.array(np.array(windows, np.int64) + first))
            .append_column("offset", pa.array(offsets, pa.int64()))
        )

    packed = rest.groupBy("_group").applyInArrow(pack, f"{out}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") >= window).withColumns(
        {"sequence_id": F.col("slot") + F.lit(1 << 62), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(full)


def packed_documents(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, text: str = "text", id_col: str = "doc_id",
    keep_ids: bool = True,
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids themselves (four bytes each, little-endian) unless ``keep_ids`` is false.

    A null or empty text has the document end alone. Null ids and repeated rows are fine: pieces
    carry a number of their own. Very long texts are tokenized in parts. An empty table gives an
    empty one; other columns are not looked at.
    """
    pieces = token_pieces(docs, tokenizer, window, text, id_col).withColumn("ids_crc32", F.crc32("ids"))
    pieces = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "slot", *(["ids"] if keep_ids else []))
    return place(store(pieces, "pieces"), window).drop("slot")
