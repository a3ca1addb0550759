"""Periodic runs of words by online square catching on dyadic blocks.

The text grows word by word (or by any number of words at once). Whenever a block of 2**k words
[s, s + 2**k) is completed, catchers are opened for it: one for each distance p in
[2**(k+1) - 1, 2**(k+2) - 2] at which the block stood before. Every square of period p has such a
block in its second half, so none is overlooked. A catcher compares the words before its block with
those p words earlier, once, and every word appended later with the word p before it, until two
differ. When p words in a row agreed, a square is caught; squares that follow each other are one
catcher and thereby one run. Blocks that go on with the distance of the block before them share its
catcher, and a block inside a known run whose period divides p opens none: it would only find that
run again. So a text of one repeated word opens a few catchers, not one for each distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixatio.llm.common import slices
from fixatio.llm.textbytes import mix, powers

LEAST = 12  # words of the shortest run
_BY_COLUMN = 16  # blocks up to this length are compared distance by distance
_FOLD = np.uint64(0x9E3779B97F4A7C15)


def _room(held: np.ndarray, n: int) -> np.ndarray:
    """``held`` itself if it has room for n entries, else a copy of twice that size."""
    if len(held) < n:
        more = np.zeros(2 * n, held.dtype)
        more[: len(held)] = held
        held = more
    return held


class SquareCatchers:
    """Runs in a growing sequence of word ids. ``longest`` bounds the length of a repeating stretch
    that can occur (texts laid one after the other with words between them that occur once)."""

    def __init__(self, least: int = LEAST, longest: int | None = None):
        self.least, self.longest = least, longest
        self._held, self._sums = np.zeros(0, np.int64), np.zeros(1, np.uint64)
        self.words = none = np.zeros(0, np.int64)
        # Catchers that may still grow, and those that ended as runs: period, first and end of the agreeing words.
        self.open, self.closed = (none, none, none), (none, none, none)

    def _caught(self, catchers: tuple) -> np.ndarray:
        period, lo, hi = catchers
        return hi - lo + period >= np.maximum(self.least, 2 * period)

    def _agreeing(self, at: np.ndarray, back: np.ndarray, step: int) -> np.ndarray:
        """How many words from ``at`` on (leftwards with step -1) have the hash of those ``back``
        before them: never fewer than agree. Wider and wider stretches, then bisection."""
        power, c = powers(len(self.words) + 1)[0], self._sums

        def equal(i: np.ndarray, k: np.ndarray) -> np.ndarray:
            x, p = at[i] if step > 0 else at[i] - k + 1, back[i]
            return c[x + k] - c[x] == (c[x - p + k] - c[x - p]) * power[p]

        limit = len(self.words) - at if step > 0 else at - back + 1
        lo, hi, active, width = np.zeros(len(at), np.int64), limit + 1, np.flatnonzero(limit > 0), 1
        while len(active):
            k = np.minimum(lo[active] + width, limit[active])
            same = equal(active, k)
            lo[active[same]], hi[active[~same]] = k[same], k[~same]
            active, width = active[same & (k < limit[active])], 2 * width
        while len(active := np.flatnonzero(hi - lo > 1)):
            k = (lo[active] + hi[active]) // 2
            same = equal(active, k)
            lo[active[same]], hi[active[~same]] = k[same], k[~same]
        return lo

    def append(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """Add words; returns (start, end, period) of the runs that became such with them."""
        before, n = len(self.words), len(self.words) + len(words)
        self._held, self._sums = _room(self._held, n), _room(self._sums, n + 1)
        self._held[before:n], self.words = words, self._held[:n]
        self._sums[before + 1:n + 1] = mix(self.words[before:].astype(np.uint64) + _FOLD) * powers(n + 1)[0][before:n]
        self._sums[before:n + 1] = np.cumsum(self._sums[before:n + 1])
        old = self._caught(self.open)
        period, lo, hi = self.open
        self.open = period, lo, hi + self._agreeing(hi, period, 1)
        new = [self._caught(self.open) & ~old]
        blocks, levels = 1, []
        while 3 * blocks - 1 <= n and (self.longest is None or 4 * blocks - 2 <= self.longest):
            if n // blocks > before // blocks:
                levels.append(blocks)
            blocks *= 2
        if levels:
            # Hashes of all stretches of a block's length, from where the oldest candidate may lie.
            base = max(0, (before // levels[-1] - 4) * levels[-1])
            hashes, size = mix(self.words[base:].astype(np.uint64) + _FOLD), 1
            for blocks in levels:
                while size < blocks:
                    hashes = mix(hashes[:-size] * _FOLD + (hashes[size:] ^ (hashes[size:] >> np.uint64(31))))
                    size *= 2
                new.append(self._open(hashes, base, blocks, before))
        caught = np.concatenate(new)
        found = [(int(a - p), int(b), int(p)) for p, a, b in zip(*(x[caught] for x in self.open))]
        ended, runs = self.open[2] < n, self._caught(self.open)
        self.closed = tuple(np.concatenate([c, o[ended & runs]]) for c, o in zip(self.closed, self.open))
        self.open = tuple(o[~ended] for o in self.open)
        return sorted(found)

    def _candidates(self, hashes: np.ndarray, base: int, size: int, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and distance of new blocks that stood there before, where the block in front did not."""
        first, last = before // size, len(self.words) // size  # blocks completed by the words since
        first = max(first, 2 if size > 1 else 1)  # no room for an earlier occurrence
        starts = np.arange(first, last, dtype=np.int64) * size
        if not len(starts):
            return starts, starts
        least = 2 * size - 1
        own = hashes[starts - base]
        at, distance = [], []
        if size <= _BY_COLUMN:
            for p in range(least, 4 * size - 1):
                skip = int(np.searchsorted(starts, base + p))
                same = np.zeros(len(starts) + 1, bool)
                same[skip + 1:] = own[skip:] == hashes[starts[skip:] - base - p]
                rows = np.flatnonzero(same[1:] & ~same[:-1])
                at.append(starts[rows])
                distance.append(np.full(len(rows), p))
        else:
            front = np.concatenate([np.zeros(4 * size, np.uint64), hashes])
            window = np.lib.stride_tricks.sliding_window_view(front, 2 * size)[starts - base + 2]
            same = np.zeros((1, 2 * size), bool)
            held = max(1, (8 << 20) // (2 * size))
            for lo in range(0, len(starts), held):
                now = window[lo:lo + held] == own[lo:lo + held, None]
                # The column is the earlier place, from 4 * size - 2 words before the block on.
                now &= (starts[lo:lo + held, None] - 4 * size + 2 + np.arange(2 * size)) >= base
                rows, columns = np.nonzero(now & ~np.concatenate([same, now[:-1]]))
                same = now[-1:]
                at.append(starts[lo + rows])
                distance.append(4 * size - 2 - columns)
        return np.concatenate(at), np.concatenate(distance)

    def _open(self, hashes: np.ndarray, base: int, size: int, before: int) -> np.ndarray:
        """Open the catchers of the completed blocks of one size; which of them caught a square."""
        at, period = self._candidates(hashes, base, size, before)
        if len(at):
            runs = [np.concatenate([c, o[self._caught(self.open)]]) for c, o in zip(self.closed, self.open)]
            if len(runs[0]):
                q, lo, hi = runs
                order = np.lexsort((q, -hi, lo - q))
                start, end, q = (lo - q)[order], hi[order], q[order]
                # Of the runs that start early enough, the one that ends last: two runs of short
                # periods that both cover the stretch would be one.
                longer = end > np.concatenate([[-1], np.maximum.accumulate(end)[:-1]])
                owner = np.maximum.accumulate(np.where(longer, np.arange(len(end)), 0))
                i = np.searchsorted(start, at - period, side="right") - 1
                own = owner[np.maximum(i, 0)]
                known = (i >= 0) & (end[own] >= at + size) & (period % q[own] == 0)
                at, period = at[~known], period[~known]
        if len(at) and len(self.open[0]):
            # An open catcher of this distance that the block belongs to.
            key = np.sort(self.open[0] * (len(self.words) + 1) + self.open[1])
            i = np.searchsorted(key, period * (len(self.words) + 1) + at, side="right") - 1
            same = (i >= 0) & (key[np.maximum(i, 0)] // (len(self.words) + 1) == period)
            hi = dict(zip((self.open[0] * (len(self.words) + 1) + self.open[1]).tolist(), self.open[2].tolist()))
            same &= np.array([hi[k] for k in key[np.maximum(i, 0)].tolist()], np.int64) > at
            at, period = at[~same], period[~same]
        mine = period, at - self._agreeing(at - 1, period, -1), at + self._agreeing(at, period, 1)
        self.open = tuple(np.concatenate([o, m]) for o, m in zip(self.open, mine))
        return self._caught(mine)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and smallest period of every run, by start and period."""
        caught = self._caught(self.open)
        period, lo, hi = (np.concatenate([c, o[caught]]) for c, o in zip(self.closed, self.open))
        start = lo - period
        order = np.lexsort((period, hi, start))
        start, hi, period = start[order], hi[order], period[order]
        # Hashes only promise that nothing was missed: the words of each run are compared.
        true, real = [], [[], [], []]
        for i, (a, b, p) in enumerate(zip(start.tolist(), hi.tolist(), period.tolist())):
            same = self.words[a + p:b] == self.words[a:b - p]
            if same.all():
                true.append(i)
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))) + a + p
            for lo, end in edge.reshape(-1, 2).tolist():  # the stretches that do agree
                if end - lo + p >= max(self.least, 2 * p):
                    for column, x in zip(real, (lo - p, end, p)):
                        column.append(x)
        start, hi, period = (np.concatenate([x[true], np.array(y, np.int64)]) for x, y in zip((start, hi, period), real))
        order = np.lexsort((period, hi, start))
        start, hi, period = start[order], hi[order], period[order]
        first = np.ones(len(start), bool)  # multiples of the smallest period agree on the same stretch
        first[1:] = (start[1:] != start[:-1]) | (hi[1:] != hi[:-1])
        start, hi, period = start[first], hi[first], period[first]
        order = np.lexsort((period, start))
        return start[order], hi[order], period[order]


def runs_of_texts(texts: list[bytes], least: int = LEAST) -> tuple[list[list[bytes]], np.ndarray, tuple, np.ndarray]:
    """The words of each text, the number of runs of each, the runs in the order of texts (start in
    its text, length, period), and for all words one after the other whether the word is dropped."""
    split = [x.split() for x in texts]  # ASCII white space, exactly
    count = np.array([len(w) for w in split], np.int64)
    flat = [w for words in split for w in words]
    ids = np.asarray(pa.array(flat, pa.binary()).dictionary_encode().indices, np.int64)
    # Between texts stands a word that occurs once.
    gap = np.cumsum(count[:-1])
    laid = np.insert(ids, gap, -1 - np.arange(len(gap))) if len(gap) else ids
    base = np.cumsum(count + 1) - (count + 1)
    catchers = SquareCatchers(least, int(count.max(initial=0)))
    catchers.append(laid)
    start, end, period = catchers.runs()
    text = np.searchsorted(base, start, side="right") - 1
    edge = np.zeros(len(laid) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    gone = np.cumsum(edge)[:-1] > 0
    gone = np.delete(gone, gap + np.arange(len(gap))) if len(gap) else gone
    return split, np.bincount(text, minlength=len(texts)), (start - base[text], end - start, period), gone


def periodic_runs(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None, keep_text: bool = True, least: int = LEAST
) -> DataFrame:
    """Periodic runs of each text's words and the text without the repetitions, row by row.

    Returns (row, n_words, runs, collapsed): ``row`` is a struct of the columns named by ``carry``
    (all of them by default), so that no name can clash; ``runs`` are (start, length, period) in
    words, by start and period; ``collapsed`` are the words that no run contains after its first
    period, joined by one blank, as a string (with ``keep_text=False``: its SHA-256 in hex).

    Words are runs of characters other than the six ASCII white space characters. A null or empty
    text has no words, no runs and an empty collapsed text. Repeated rows are rows of their own;
    equal words tie exactly. An empty table gives an empty one. A text is held by one task, in memory
    that grows with its length (about 100 bytes a word); work grows as n log n words, also where
    one word fills the text. Nothing is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                texts = [x or b"" for x in part.column("text").to_pylist()]
                split, n_runs, (start, length, period), gone = runs_of_texts(texts, least)
                out, at = [], 0
                for words in split:
                    lost = gone[at:at + len(words)]
                    at += len(words)
                    if lost.any():
                        words = [w for w, x in zip(words, lost.tolist()) if not x]
                    data = b" ".join(words)
                    out.append(data if keep_text else hashlib.sha256(data).hexdigest())
                columns = [pa.array(x, pa.int64()) for x in (start, length, period)]
                offsets = np.concatenate([[0], np.cumsum(n_runs)])
                yield pa.record_batch({
                    "row": part.column("row"), "n_words": pa.array([len(w) for w in split], pa.int64()),
                    "runs": pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["start", "length", "period"])
                    ),
                    "collapsed": pa.array(out, pa.binary()).cast(pa.string()) if keep_text else pa.array(out, pa.string()),
                })

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if carry is None else carry)]).alias("row")
    frame = docs.select(row, F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    kind = frame.schema["row"].dataType.simpleString()
    return frame.mapInArrow(
        run, f"row {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )
