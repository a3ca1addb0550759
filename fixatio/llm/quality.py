"""Quality classifier by co-training.

Two views of a document: its text content (byte trigrams, repetition of words) and the metadata
of its page (language, source, length, layout). A logistic model is fitted to each view; over
some rounds, each hands the unlabelled documents it is surest of to the other as further
examples. Both are then calibrated on labels that neither was fitted to, and all documents are
scored by the two together.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import byte_buffer, per_worker, slices
from fixatio.llm.textbytes import mix, prefix_sums, span_hash, word_spans

TRIGRAMS, LANGS, SOURCES = 512, 8, 32
#: The most labelled and unlabelled documents that are fitted to (expected values; drawn by hash of the id).
LABELLED, UNLABELLED = 8000, 6000
ROUNDS, CONFIDENT, PER_ROUND = 3, 0.98, 0.1


def text_view(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams; share of words that repeat the one
    before, share of distinct words, and both in square; one row per text."""
    n, length = len(at) - 1, np.diff(at)
    out = np.zeros((n, TRIGRAMS + 4), np.float32)
    if len(data):
        d = data.astype(np.uint32)
        code = np.zeros(len(d), np.uint32)
        code[:-2] = (d[:-2] << 16 | d[1:-1] << 8 | d[2:]) * np.uint32(0x9E3779B1) >> np.uint32(23)
        row = np.repeat(np.arange(n), length)
        inside = np.arange(len(d)) < np.repeat(at[1:] - 2, length)  # trigrams within the text
        counts = np.bincount((row * TRIGRAMS + code)[inside], minlength=n * TRIGRAMS).reshape(n, TRIGRAMS)
        out[:, :TRIGRAMS] = np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))
        start, stop, doc = word_spans(data, at)
        if len(start):
            word = span_hash(prefix_sums(data), start, stop)
            words = np.maximum(1, np.bincount(doc, minlength=n))
            again = np.zeros(len(word), bool)
            again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
            out[:, -4] = np.bincount(doc, again, minlength=n) / words
            tagged = np.sort(doc.astype(np.uint64) << np.uint64(40) | mix(word) >> np.uint64(24))
            first = np.ones(len(tagged), bool)
            first[1:] = tagged[1:] != tagged[:-1]
            kinds = np.bincount((tagged[first] >> np.uint64(40)).astype(int), minlength=n)
            # Long texts repeat words anyway: distinct words against the square root of all.
            out[:, -3] = kinds / np.sqrt(words) / 10
            out[:, -2:] = out[:, -4:-2] ** 2
    return out


def _buckets(values: pa.Array, size: int) -> np.ndarray:
    """A hashed place for each string; null has the last."""
    data, at = byte_buffer(values)
    h = span_hash(prefix_sums(data), at[:-1], at[1:]) % np.uint64(size - 1)
    null = values.is_null().to_numpy(zero_copy_only=False)
    return np.where(null, size - 1, h.astype(int))


def page_view(lang: pa.Array, source: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Language and source as hashed indicators; length, lines, and shares of kinds of bytes."""
    n, length = len(at) - 1, np.diff(at)
    out = np.zeros((n, LANGS + SOURCES + 12), np.float32)
    rows = np.arange(n)
    out[rows, _buckets(lang, LANGS)] = 1
    out[rows, LANGS + _buckets(source, SOURCES)] = 1
    sums = np.zeros((4, len(data) + 1))
    for k, of in enumerate((
        (data >= 65) & (data <= 90),
        (data >= 48) & (data <= 57),
        (data > 32) & (data < 127) & ~((data >= 65) & (data <= 90)) & ~((data >= 97) & (data <= 122))
        & ~((data >= 48) & (data <= 57)) & (data != 44) & (data != 46),  # signs other than , and .
        data == 10,
    )):
        np.cumsum(of, out=sums[k, 1:])
    totals = sums[:, at[1:]] - sums[:, at[:-1]]
    shares = totals / np.maximum(1, length)
    base = LANGS + SOURCES
    out[:, base] = np.log1p(length) / 10
    out[:, base + 1] = np.log1p(length / (1 + totals[3])) / 10
    out[:, base + 2:base + 6] = shares.T
    out[:, base + 6:base + 9] = np.sqrt(shares[:3]).T
    out[:, base + 9:base + 12] = (shares[:3] > 0.05).T
    return out


@dataclass
class Logistic:
    """Weights over standardized features, and the two numbers of the calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return np.clip(self.slope * raw + self.shift, -30, 30)


def _newton(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 8) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        v = np.maximum(p * (1 - p), 1e-4)
        step = np.linalg.solve((x * v[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray, ridge: float) -> Logistic:
    mean, scale = x.mean(0), x.std(0) + 1e-3
    return Logistic(mean, scale, _newton((x - mean) / scale, y, ridge))


@dataclass
class CoTrained:
    text: Logistic
    page: Logistic
    prior: float

    def logits(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text, of the page, and of both: views that are independent given the class add
        up, less the prior that both contain."""
        t, p = self.text.logit(a), self.page.logit(b)
        return t, p, t + p - self.prior


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, ridge: float = 30.0) -> CoTrained | None:
    """Fit both views; y is 1, 0, or -1 for unlabelled rows. None if a class has under 4 labels.

    A quarter of the labelled rows is kept for the calibration.
    """
    labelled = np.flatnonzero(y >= 0)
    if min((y == 1).sum(), (y == 0).sum()) < 4:
        return None
    hold = np.zeros(len(y), bool)
    for c in (0, 1):
        hold[np.flatnonzero(y == c)[::4]] = True
    base = labelled[~hold[labelled]]
    pool = np.flatnonzero(y < 0)
    views, gifts = (a, b), [{}, {}]  # gifts[k]: row -> pseudo-label that view k got from the other
    models: list[Logistic] = []
    for turn in range(rounds + 1):
        models = []
        for k in (0, 1):
            rows = np.concatenate([base, np.fromiter(gifts[k], int, len(gifts[k]))])
            labels = np.concatenate([y[base], np.fromiter(gifts[k].values(), int, len(gifts[k]))])
            models.append(fit(views[k][rows], labels, ridge))
        if turn == rounds or not len(pool):
            break
        share = y[base].mean()
        for k in (0, 1):
            z = models[k].logit(views[k][pool])
            edge = np.log(CONFIDENT / (1 - CONFIDENT))
            for label, sign, part in ((1, 1, share), (0, -1, 1 - share)):
                sure = np.flatnonzero(sign * z > edge)
                most = int(np.ceil(PER_ROUND * part * len(pool)))
                for i in sure[np.argsort(-sign * z[sure], kind="stable")][:most]:
                    gifts[1 - k].setdefault(int(pool[i]), label)
    for k in (0, 1):
        raw = models[k].logit(views[k][hold])[:, None]
        spread = raw.std() + 1e-3
        w = _newton(raw / spread, y[hold], 1.0, 30)
        models[k].slope, models[k].shift = float(w[0] / spread), float(w[1])
    rate = y[labelled].mean()
    return CoTrained(models[0], models[1], float(np.log(rate / (1 - rate))))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(
        *more, "doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            data, at = byte_buffer(part.column("text"))
            a, b = text_view(data, at), page_view(part.column("lang"), part.column("source"), data, at)
            yield pa.record_batch({
                "y": part.column("y"),
                "a": pa.array([x.tobytes() for x in a], pa.binary()),
                "b": pa.array([x.tobytes() for x in b], pa.binary()),
            })


def learn(
    docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED, rounds: int = ROUNDS,
) -> CoTrained | None:
    """Co-train on a sample. Labels: doc_id, quality; null ids and labels are no evidence, and of
    several labels of a document the lowest holds."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("_quality")
    )
    n_labels, n_docs = known.count(), docs.count()
    if not n_labels or not n_docs:
        return None
    near, far = labelled / n_labels, unlabelled / n_docs
    u = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    sample = (
        _rows(docs).filter("doc_id is not null").withColumn("_u", u).filter(F.col("_u") < max(near, far))
        .join(known.filter(u < max(near, far)), "doc_id", "left")
        .filter(F.when(F.col("_quality").isNull(), F.col("_u") < far).otherwise(F.col("_u") < near))
    )
    found = sample.select(
        "text", "lang", "source", F.coalesce(F.col("_quality").cast("int"), F.lit(-1)).alias("y"),
        F.col("doc_id").cast("string").alias("id"),
    ).orderBy("id").drop("id").mapInArrow(_views, "y int, a binary, b binary").toArrow()
    y = found.column("y").to_numpy()
    a, b = (
        np.frombuffer(b"".join(found.column(c).to_pylist()), np.float32).reshape(len(y), -1).astype(float)
        for c in ("a", "b")
    )
    return co_train(a, b, y, rounds)


def scored(docs: DataFrame, model: CoTrained | None, columns: list[str]) -> DataFrame:
    """A row per document: the struct ``row`` of ``columns``, quality_score, text_score, page_score
    (0 to 1, of high quality) and keep (quality_score >= 0.5).

    Null texts, languages and sources are values like others; an empty text is scored by its page.
    Without a model (no labels, or labels of one kind) all scores are null and every document stays.
    """
    key = uuid.uuid4().hex
    rows = _rows(docs.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in columns])), "_row")
    fields = docs.select(*[F.col(f"`{c}`") for c in columns]).schema.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker("quality", key, lambda: model)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                n = part.num_rows
                if own is None:
                    t = p = both = pa.nulls(n, pa.float64())
                    keep = pa.array(np.ones(n, bool))
                else:
                    data, at = byte_buffer(part.column("text"))
                    z = own.logits(text_view(data, at), page_view(part.column("lang"), part.column("source"), data, at))
                    t, p, both = (pa.array(1 / (1 + np.exp(-x))) for x in z)
                    keep = pa.array(z[2] >= 0)
                yield pa.record_batch(
                    {"row": part.column("_row"), "quality_score": both, "text_score": t, "page_score": p, "keep": keep}
                )

    return rows.mapInArrow(
        run, f"row {fields}, quality_score double, text_score double, page_score double, keep boolean"
    )


def score(docs: DataFrame, model: CoTrained | None) -> DataFrame:
    """doc_id and the columns of ``scored``."""
    return scored(docs, model, ["doc_id"]).select("row.*", "quality_score", "text_score", "page_score", "keep")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that a classifier learned from the labels keeps."""
    return scored(docs, learn(docs, labels), docs.columns).filter("keep").select("row.*")
