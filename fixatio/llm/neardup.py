"""Near-duplicate documents by improved consistent weighted sampling.

A document is a bag of shingles of five words, each with the weight count x inverse document
frequency. Samples drawn from it agree between two documents with the probability of their
weighted Jaccard similarity; runs of samples are the keys of bands. Texts that share a band key
are candidates; candidates are gathered by connected components and compared exactly, in blocks
of bounded size. What is linked at the threshold or above is one class.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fixatio.llm.common import byte_buffer, per_worker, row_key, slices, store, whole_row
from fixatio.llm.components import components
from fixatio.llm.textbytes import mix, prefix_sums, span_hash, word_spans

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
#: A word is common if it has more than this part of all (document, word) pairs: there are at most so many.
#: Rarer words weigh as much as one just as common would, in a corpus of any size.
COMMON = 1 << 17
_DOC_BITS = np.uint64(13)  # of a text's number in a slice, below the bits of a word's hash
_GATHER = 1 << 20  # (document, word) pairs that are counted at once
BLOCK, BLOCK_CHARS = 256, 16_000_000
_TABLE = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, stop, doc = word_spans(data, at)
    return (span_hash(prefix_sums(data), start, stop) if len(start) else np.zeros(0, np.uint64)), doc


def _word_key(word: np.ndarray) -> np.ndarray:
    return word >> _DOC_BITS


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many texts have a word, by its hash, in parts that are summed later."""
    held, size, texts = [], 0, 0

    def out() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"word": pa.array(word.astype(np.int64)), "n": pa.array(n)})

    for batch in batches:
        texts += batch.num_rows
        for part in slices(batch, "text", 1 << 20):
            for lo in range(0, part.num_rows, 1 << int(_DOC_BITS)):
                some = part.slice(lo, 1 << int(_DOC_BITS))
                word, doc = _words(*byte_buffer(some.column("text")))
                pairs = np.unique(_word_key(word) << _DOC_BITS | doc.astype(np.uint64))
                held.append(_word_key(pairs))
                size += len(pairs)
        if size > _GATHER:
            yield out()
            held, size = [], 0
    if size:
        yield out()
    yield pa.record_batch({"word": pa.array([None], pa.int64()), "n": pa.array([texts], pa.int64())})


class InverseFrequencies:
    """ln((1 + documents) / (1 + documents with the word)) + 1 of common words by hash; all others
    have that of the limit."""

    def __init__(self, word: np.ndarray, n: np.ndarray, texts: int, limit: float):
        order = np.argsort(word)
        self.word = word[order].astype(np.uint64)
        self.value = np.log((1 + texts) / (1 + n[order])) + 1
        self.rare = float(np.log((1 + texts) / (1 + limit)) + 1)

    def of(self, word: np.ndarray) -> np.ndarray:
        if not len(self.word):
            return np.full(len(word), self.rare)
        key = _word_key(word)
        at = np.minimum(np.searchsorted(self.word, key), len(self.word) - 1)
        return np.where(self.word[at] == key, self.value[at], self.rare)


def inverse_frequencies(texts: DataFrame) -> InverseFrequencies:
    """Of the words of all documents; every word is counted, and the common ones are returned."""
    counts = store(texts.mapInArrow(_frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n_texts, pairs = counts.agg(
        F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0)),
        F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))), F.lit(0)),
    ).first()
    limit = pairs / COMMON
    common = counts.filter(F.col("word").isNotNull() & (F.col("n") > limit)).toArrow()
    return InverseFrequencies(common.column("word").to_numpy(), common.column("n").to_numpy(), n_texts, min(limit, n_texts))


def shingles(data: np.ndarray, at: np.ndarray, idf: InverseFrequencies, words: int = WORDS):
    """(shingle, weight of one occurrence, count, text number), by text number and shingle.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    word, doc = _words(data, at)
    n = len(at) - 1
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
    per_doc = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(per_doc)[:-1]])
    index = np.arange(len(word)) - first[doc]
    size = np.minimum(per_doc, words)[doc]
    heads = np.flatnonzero(index <= per_doc[doc] - size)
    value, weight = np.zeros(len(heads), np.uint64), np.zeros(len(heads))
    own, span = idf.of(word), size[heads]
    for k in range(words):
        at_k = np.minimum(heads + k, len(word) - 1)
        inside = k < span
        value = np.where(inside, (value + word[at_k]) * _STEP, value)
        weight += np.where(inside, own[at_k], 0)
    value, weight, owner = mix(value), weight / span, doc[heads]
    # Order by text and shingle with one sort: the shingle's upper bits below the text's number.
    bits = np.uint64(max(1, int(n).bit_length()))
    tag = owner.astype(np.uint64) << (np.uint64(64) - bits) | value >> bits
    order = np.argsort(tag, kind="stable")
    tag, value, weight, owner = tag[order], value[order], weight[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], tag[1:] != tag[:-1]]))
    return value[new], weight[new], np.diff(np.append(new, len(tag))), owner[new]


class Sampler:
    """Improved consistent weighted sampling; a shingle's random numbers are looked up by its hash."""

    def __init__(self, samples: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2, 1, _TABLE)
        self.log_c = np.log(rng.gamma(2, 1, _TABLE))
        self.beta = rng.random(_TABLE)
        self.over_r, self.base = 1 / self.r, self.log_c + self.r * (self.beta - 1)
        self.factors = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def bands(self, value: np.ndarray, weight: np.ndarray, owner: np.ndarray, n: int, bands: int, rows: int) -> np.ndarray:
        """Band keys, n x bands; rows of texts without shingles are 0."""
        out = np.zeros((n, bands), np.uint64)
        if not len(value):
            return out
        head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        texts, length, log_w = owner[head], np.diff(np.append(head, len(owner))), np.log(weight)
        for band in range(bands):
            key = np.full(len(head), band + 1, np.uint64)
            for factor in self.factors[band * rows:(band + 1) * rows]:
                i = (value * factor) >> np.uint64(48)
                t = np.floor(log_w * self.over_r[i] + self.beta[i])
                log_a = self.base[i] - self.r[i] * t  # ln c - r (t - beta) - r
                best = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, head), length))
                pick = best[np.concatenate([[True], owner[best][1:] != owner[best][:-1]])]
                key = mix(key * _STEP + mix(value[pick] ^ t[pick].astype(np.int64).astype(np.uint64) * _STEP))
            out[texts, band] = key
        return out


def signatures(texts: DataFrame, idf: InverseFrequencies, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, _k1, _k2, chars, slot, bands) of each row of (doc_id, _k1, _k2, text); bands is
    null for a text without words, slot is a number of the row's own."""
    kind, key = texts.schema["doc_id"].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sampler = per_worker("sampler", key, lambda: Sampler(bands * rows))
        slot = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                data, at = byte_buffer(part.column("text"))
                n = part.num_rows
                value, weight, count, owner = shingles(data, at, idf)
                keys = sampler.bands(value, weight * count, owner, n, bands, rows)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, bands * n + 1, bands), pa.int32()), pa.array(keys.ravel().view(np.int64)),
                    mask=pa.array(np.bincount(owner, minlength=n) == 0),
                )
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "_k1": part.column("_k1"), "_k2": part.column("_k2"),
                    "chars": pa.array(np.diff(at)), "slot": pa.array(np.arange(slot, slot + n)), "bands": lists,
                })
                slot += n

    return texts.mapInArrow(run, f"doc_id {kind}, _k1 long, _k2 long, chars long, slot long, bands array<long>")


def _forest(n: int, pairs: np.ndarray) -> list[int]:
    """Indices of pairs that join two trees."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append(i)
    return out


def similar_pairs(texts: pa.Array, bands: np.ndarray, side: np.ndarray, idf: InverseFrequencies, threshold: float):
    """Pairs (i < j) of texts with weighted Jaccard similarity at the threshold or above, and it.

    ``side`` is -1 for all where every pair is compared; else pairs of a 0 and a 1 that share a
    band key are (and others in the rows and columns of such pairs).
    """
    data, at = byte_buffer(texts)
    value, weight, count, owner = shingles(data, at, idf)
    n = len(at) - 1
    whole = np.bincount(owner, weight * count, minlength=n)
    if side[0] < 0:
        left = right = np.arange(n)
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        shared = np.zeros((len(left), len(right)), bool)
        for k in range(bands.shape[1]):
            shared |= bands[left, k][:, None] == bands[right, k][None, :]
        left, right = left[shared.any(1)], right[shared.any(0)]
    if not len(left) or not len(right):
        return np.zeros((0, 2), np.int64), np.zeros(0)
    # An occurrence is a feature: the second of a shingle is another one than the first.
    turn = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    feature = mix(np.repeat(value, count) + turn.astype(np.uint64) * _STEP)
    w, doc = np.repeat(weight, count), np.repeat(owner, count)
    in_left, in_right = np.zeros(n, bool), np.zeros(n, bool)
    in_left[left], in_right[right] = True, True
    use = (in_left | in_right)[doc]
    feature, w, doc = feature[use], w[use], doc[use]
    kinds, index = np.unique(feature, return_inverse=True)
    both = np.bincount(index, minlength=len(kinds)) > 1
    number = np.cumsum(both) - 1
    keep = both[index]
    column, w, doc = number[index[keep]], w[keep], doc[keep]
    row_l, row_r = np.full(n, -1), np.full(n, -1)
    row_l[left], row_r[right] = np.arange(len(left)), np.arange(len(right))
    common = np.zeros((len(left), len(right)))
    order = np.argsort(column, kind="stable")
    column, w, doc = column[order], w[order], doc[order]
    step = 4096
    for lo in range(0, int(both.sum()), step):
        a, b = np.searchsorted(column, [lo, lo + step])
        c, d, v = column[a:b] - lo, doc[a:b], w[a:b]
        x, y = np.zeros((len(left), step)), np.zeros((len(right), step))
        l, r = row_l[d] >= 0, row_r[d] >= 0
        x[row_l[d[l]], c[l]] = v[l]
        y[row_r[d[r]], c[r]] = 1
        common += x @ y.T
    similarity = common / np.maximum(whole[left][:, None] + whole[right][None, :] - common, 1e-300)
    i, j = np.nonzero(similarity >= threshold - 1e-9)
    pairs = np.stack([left[i], right[j]], 1)
    ok = pairs[:, 0] < pairs[:, 1] if side[0] < 0 else np.ones(len(pairs), bool)
    return pairs[ok], similarity[i, j][ok]


def in_blocks(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Add ``blocks`` to (component, chars, ...): the number of blocks that the component is cut into."""
    cut = nodes.groupBy("component").agg(
        F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("chars") / BLOCK_CHARS)).cast("int").alias("blocks")
    )
    return nodes.join(cut, "component")


def links(members: DataFrame, idf: InverseFrequencies, threshold: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): verified links of (component, blocks, node, bands, text), of each block
    those that join its texts. Large components are cut into blocks, and every pair of blocks is
    compared in a task of its own."""
    own = members.withColumn("_own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Pair (i, j) with i <= j of blocks; a text goes to every pair that its block is part of.
    spread = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", "node", "bands", "text",
        F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own",
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("node").combine_chunks()
        node, own = table.column("node").to_numpy(), table.column("_own").to_numpy()
        i, j = table.column("_i")[0].as_py(), table.column("_j")[0].as_py()
        side = np.full(len(own), -1) if i == j else (own == j).astype(int)
        bands = np.array(table.column("bands").to_pylist(), np.int64)
        pairs, similarity = similar_pairs(table.column("text"), bands, side, idf, threshold)
        tree = _forest(len(node), pairs)
        return pa.table({
            "a": node[pairs[tree, 0]] if tree else np.zeros(0, np.int64),
            "b": node[pairs[tree, 1]] if tree else np.zeros(0, np.int64),
            "similarity": similarity[tree] if tree else np.zeros(0),
        })

    return spread.groupBy("component", "_i", "_j").applyInArrow(compare, "a long, b long, similarity double")


def near_duplicates(
    docs: DataFrame, text: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY, block: int = BLOCK,
) -> DataFrame:
    """(doc_id, _k1, _k2, class_id, class_size, stays) with a row per document, stored.

    ``class_id`` is the least doc_id of the class, ``stays`` marks one document of it (the one
    with that id). Documents of equal text are one class, null and empty being equal; so are texts
    linked by similarity, also over others. A text without words is linked to equal ones only.
    Null ids are fine: a class of null ids only has a null class_id. Rows with equal id and text
    share the mark. (_k1, _k2) is the key of the text. An empty table gives an empty one.
    """
    texts = docs.select(
        F.col(id_col).alias("doc_id"), *row_key(F.coalesce(F.col(text), F.lit(""))),
        F.col(text).cast("string").alias("text"),
    )
    idf = inverse_frequencies(texts.select("text"))
    rows = store(signatures(texts, idf), "signatures")
    # One node for each different text.
    nodes = store(
        rows.groupBy("_k1", "_k2").agg(
            F.min("slot").alias("node"), F.min("doc_id").alias("rep"), F.first("bands").alias("bands"),
            F.max("chars").alias("chars"), F.count("*").alias("n"),
        ),
        "nodes",
    )
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = store(
        keys.groupBy("key").agg(F.min("node").alias("center"), F.count("*").alias("_n")).filter("_n > 1"), "bands"
    )
    stars = keys.join(shared, "key").filter("node <> center").select("node", "center").distinct()
    candidates = components(stars, "node", "center")
    # Blocks are counted before texts come in, so texts are never gathered by component alone.
    wanted = in_blocks(candidates.join(nodes, "node"), block)
    found = texts.join(
        wanted.select("_k1", "_k2", F.col("rep").alias("_rep"), "node", "component", "blocks", "bands"), ["_k1", "_k2"]
    ).filter(F.col("doc_id").eqNullSafe(F.col("_rep")))
    once = Window.partitionBy("_k1", "_k2").orderBy("node")
    members = store(
        found.withColumn("_n", F.row_number().over(once)).filter("_n = 1")
        .select("component", "blocks", "node", "bands", "text"),
        "members",
    )
    linked = components(links(members, idf, threshold), "a", "b")
    classes = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = classes.groupBy("component").agg(
        F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "node")).alias("head"), F.sum("n").alias("class_size")
    )
    of_text = classes.join(heads, "component").select(
        "_k1", "_k2", F.col("head.rep").alias("class_id"), "class_size",
        (F.col("head.node") == F.col("node")).alias("_head"),
    )
    # An equi-join whose large side, with the copies of a text, Spark can split.
    return store(
        rows.join(of_text, ["_k1", "_k2"]).select(
            "doc_id", "_k1", "_k2", "class_id", "class_size",
            (F.col("_head") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("stays"),
        ),
        "classes",
    )


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """One document, with all its columns, of each class of near-duplicates."""
    found = near_duplicates(docs, threshold=threshold)
    stay = found.filter("stays").select("_k1", "_k2", F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(whole_row(docs), *row_key(F.coalesce(F.col("text"), F.lit("")))).withColumn("_doc", F.col("row.doc_id"))
    kept = rows.join(
        stay.select(F.col("_k1").alias("_s1"), F.col("_k2").alias("_s2"), "_id"),
        (F.col("_k1") == F.col("_s1")) & (F.col("_k2") == F.col("_s2")) & F.col("_doc").eqNullSafe(F.col("_id")),
    )
    # Repeated rows (equal id and text) all match: one of them.
    once = Window.partitionBy("_k1", "_k2", "_doc").orderBy(F.lit(1))
    return kept.withColumn("_once", F.row_number().over(once)).filter("_once = 1").select("row.*")
