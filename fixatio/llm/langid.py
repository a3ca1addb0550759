"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of orders 0 to 3 is counted on a bounded sample of
labelled documents. A byte that its context has not seen costs an escape and is tried one order
lower; counts stay frozen, so the code length of a text is a sum of table entries, and the
language with the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import byte_buffer, per_worker, slices

#: The most documents of a language that are learned from (expected value; drawn by hash of the id).
DOCS_PER_LANGUAGE = 2000
SYMBOLS = 256  # every byte value
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning; a null id is neither held out nor learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _contexts(symbols: np.ndarray, at: np.ndarray, blank: int, bits: int, order: int = 3) -> np.ndarray:
    """The ``order`` symbols before each one, as a number; before a text lie blanks."""
    out = np.zeros(len(symbols), np.int64)
    for back in range(order, 0, -1):
        prior = np.full(len(symbols), blank, np.int64)
        prior[back:] = symbols[:-back] if back < len(symbols) else prior[back:]
        for k in range(back):
            edge = at[:-1] + k
            edge = edge[edge < at[1:]]
            prior[edge] = blank
        out = out << bits | prior
    return out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            langs = part.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                data, at = byte_buffer(part.filter(pa.array([x == lang for x in langs])).column("text"))
                low = _LOWER[data]
                gram, n = np.unique(_contexts(low, at, 32, 8) << 8 | low, return_counts=True)
                yield pa.record_batch({
                    "lang": pa.array([lang] * len(gram), pa.string()), "gram": pa.array(gram), "n": pa.array(n),
                })


def learn(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Counts of four bytes in a row for each language: {language: (bytes as a number, count)}.

    Rows: doc_id, text, lang, without null languages and texts. What comes to the driver are the
    distinct sequences of the sample, which is bounded by ``docs_per_language``.
    """
    share = {r["lang"]: docs_per_language / r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return {}
    u = F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    limit = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    sample = docs.filter(u < limit).select("lang", "text")
    sums = sample.mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    out = {}
    langs = np.array(found.column("lang").to_pylist(), object)
    gram, n = found.column("gram").to_numpy(), found.column("n").to_numpy()
    for lang in sorted(share):
        own = langs == lang
        order = np.argsort(gram[own])
        out[lang] = (gram[own][order], n[own][order])
    return out


def _place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class ContextTrees:
    """Code lengths in bits of each byte after each context, for all languages.

    For each order the (context, byte) pairs that any language has seen are a sorted array, with
    a row of code lengths each; so are the contexts, with the length of the escape in each
    language (0 where the language has not seen the context). A pair that no language has seen
    costs the escape of its context and is looked up one order lower.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = list(counts)
        self.symbol = _LOWER.astype(np.int64)
        #: For orders 0 to 3: pairs, their code lengths, contexts, their escapes.
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for order in range(4 if counts else 0):
            own = []
            for gram, n in counts.values():
                pair, back = np.unique(gram & (SYMBOLS ** (order + 1) - 1), return_inverse=True)
                own.append((pair, np.bincount(back, n, len(pair))))
            pairs = np.unique(np.concatenate([p for p, _ in own]))
            contexts = np.unique(pairs >> 8)
            bits = np.zeros((len(pairs), len(self.langs)), np.float32)
            escapes = np.zeros((len(contexts), len(self.langs)), np.float32)
            at = np.searchsorted(contexts, pairs >> 8)
            # The lower pair of one that was seen was seen as well.
            below = np.searchsorted(self.orders[-1][0], pairs & (SYMBOLS**order - 1)) if order else None
            for k, (pair, n) in enumerate(own):
                count = np.zeros(len(pairs))
                count[np.searchsorted(pairs, pair)] = n
                lower = self.orders[-1][1][below, k] if order else np.log2(SYMBOLS)
                bits[:, k], escapes[:, k] = self._code(count, at, len(contexts), lower)
            self.orders.append((pairs.astype(np.uint32), bits, contexts.astype(np.uint32), escapes))

    @staticmethod
    def _code(count: np.ndarray, at: np.ndarray, contexts: int, lower) -> tuple[np.ndarray, np.ndarray]:
        """Code lengths where a context with n symbols of d kinds escapes with d / (n + d), and
        the lengths of the escapes."""
        n, d = np.bincount(at, count, contexts), np.bincount(at, count > 0, contexts)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(n == 0, 0, np.log2(n + d) - np.log2(d))
            own = np.log2(n + d)[at] - np.log2(count)
        return np.where(count > 0, own, escape[at] + lower), escape

    def lengths(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length of each text in each language."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        symbols = self.symbol[data]
        grams = (_contexts(symbols, at, 32, 8) << 8 | symbols).astype(np.uint32)
        full = np.flatnonzero(at[1:] > at[:-1])
        if not len(full) or not self.orders:
            return out
        cell = _place(self.orders[3][0], grams)
        rare = np.flatnonzero(cell < 0)  # no language has seen these four bytes in a row
        left, more = grams[rare], np.zeros((len(rare), len(self.langs)))
        open_ = np.arange(len(rare))
        for order in (3, 2, 1, 0):
            pairs, bits, contexts, escapes = self.orders[order]
            here = _place(pairs, left)
            more[open_[here >= 0]] += bits[here[here >= 0]]
            open_, left = open_[here < 0], left[here < 0]
            context = _place(contexts, left >> 8)
            more[open_[context >= 0]] += escapes[context[context >= 0]]
            left = left & (SYMBOLS**order - 1)
        more[open_] += np.log2(SYMBOLS)
        for k in range(len(self.langs)):
            each = self.orders[3][1][cell, k].astype(np.float64)
            each[rare] = more[:, k]
            out[full, k] = np.add.reduceat(each, at[:-1][full])
        return out


def identify(
    docs: DataFrame, counts: dict[str, tuple[np.ndarray, np.ndarray]], id_col: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the shortest code, and its share of all
    languages' probabilities.

    A text that is null, empty or without a letter is ``und`` with score 0, as is every text if no
    language was learned. Equal code lengths go to the first language by name. Null ids and
    repeated rows are fine; other columns are not looked at.
    """
    kind, key = docs.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = per_worker("trees", key, lambda: ContextTrees(counts))
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                n = part.num_rows
                known = part.column("letter").to_numpy(zero_copy_only=False).astype(bool)
                best, score = np.zeros(n, int), np.zeros(n)
                if trees.langs:
                    bits = trees.lengths(*byte_buffer(part.column("text")))
                    best = bits.argmin(1)
                    score = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                else:
                    known[:] = False
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"),
                    "lang_pred": pa.array([trees.langs[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                    "score": pa.array(np.where(known, score, 0.0)),
                })

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), letter.alias("letter"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
