"""Periodic runs against plain loops, word by word and at once, and the registered query."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from fixatio.llm import digests, periods

SCHEMA = "doc_id long, text string, runs string, row string, n_words int, collapsed int"


def plain_runs(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        x = p
        while x < len(words):
            if words[x] != words[x - p]:
                x += 1
                continue
            a = x
            while x < len(words) and words[x] == words[x - p]:
                x += 1
            if x - a + p >= max(least, 2 * p):
                found.setdefault((a - p, x), p)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain_collapse(words, runs):
    gone = {i for a, n, p in runs for i in range(a + p, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def repeating(rng):
    words = rng.integers(0, rng.integers(1, 5), rng.integers(0, 160))
    for _ in range(rng.integers(0, 4)):
        if len(words) > 10:
            a, p = rng.integers(0, len(words)), rng.integers(1, 1 + len(words) // 3)
            for i in range(a, rng.integers(a, len(words) + 1)):
                words[i] = words[a + (i - a) % p]
    return words


def caught(words, least, pieces=None):
    catchers = periods.SquareCatchers(least)
    for piece in [words] if pieces is None else pieces:
        catchers.append(piece)
    start, end, period = catchers.runs()
    return list(zip(start.tolist(), (end - start).tolist(), period.tolist()))


def test_runs_are_the_plain_ones():
    rng = np.random.default_rng(1)
    for i in range(600):
        words, least = repeating(rng), int(rng.choice([1, 2, 12]))
        expected = plain_runs(words.tolist(), least)
        assert caught(words, least) == expected
        if i % 10 == 0:  # word by word, and in pieces
            assert caught(words, least, [words[j:j + 1] for j in range(len(words))]) == expected
            cuts = np.sort(rng.integers(0, len(words) + 1, 3))
            assert caught(words, least, np.split(words, cuts)) == expected


def test_a_square_is_reported_with_the_word_that_completes_it():
    catchers = periods.SquareCatchers(least=4)
    reported = [catchers.append(np.array([w])) for w in [5, 1, 2, 1, 2, 1, 9]]
    assert [i for i, r in enumerate(reported) if r] == [4]
    assert reported[4] == [(1, 5, 2)]
    assert [x.tolist() for x in catchers.runs()] == [[1], [6], [2]]


@pytest.mark.parametrize("words", [
    np.zeros(1 << 18, int), np.tile(np.r_[np.zeros(1000, int), 1], 200), np.arange(1 << 18) % 70_000,
    np.array([bin(i).count("1") % 2 for i in range(1 << 15)]),
])
def test_very_repetitive_words_stay_cheap(words):
    catchers = periods.SquareCatchers()
    catchers.append(words)
    assert len(catchers.open[0]) + len(catchers.closed[0]) < len(words) / 4
    assert len(catchers.runs()[0]) >= 1


def test_equal_hashes_of_unequal_words(monkeypatch):
    """With a useless hash every stretch agrees; the words themselves still decide."""
    monkeypatch.setattr(periods, "mix", lambda h: h * np.uint64(0))
    words = np.array([1, 2, 3] * 5 + [7])
    catchers = periods.SquareCatchers()
    catchers.append(words)
    for a, b, p in zip(*catchers.runs()):
        assert (words[a + p:b] == words[a:b - p]).all()


AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (None, "no id"), (None, None), (4, "x " * 40), (4, "x " * 40), (5, "A" * 5000),
    (6, "a b c " * 5000 + "d"), (7, "  é 日 本 é 日 本 " * 6), (8, " ".join(str(i) for i in range(50_000))),
    (9, "p\x0bq\x0cp\rq\tp\nq p q p q p q p q"),
]


def test_operator_on_awkward_rows(spark):
    docs = spark.createDataFrame([(*r, "clash", "clash", 3, 4) for r in AWKWARD], SCHEMA)
    out = periods.periodic_runs(docs).collect()
    assert len(out) == len(AWKWARD)
    got = sorted((str(r.row.doc_id), r.row.text or "", r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out)
    expected = []
    for doc_id, text in AWKWARD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words) if len(set(words)) < 100 and len(words) < 200 else [(0, 15_000, 3)] if doc_id == 6 else []
        expected.append((str(doc_id), text or "", len(words), runs, " ".join(plain_collapse(words, runs))))
    assert got == sorted(expected)
    assert all(r.row.n_words == 3 and r.row.collapsed == 4 for r in out)
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    rng = np.random.default_rng(3)
    table = [(i, " ".join(f"w{x}" for x in repeating(rng))) for i in range(150)] + [(150, None), (151, ""), (None, "a b " * 9), (200, "one")]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.runs_sha256): tuple(r) for r in digests.periodic_run_detection(spark, str(tmp_path)).collect()}
    assert len(got) == len(table)
    for doc_id, text in table:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if doc_id is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        expected = (doc_id, len(runs), *((*top, 1000 * top[1] // top[2]) if top else (None,) * 4), digest,
                    hashlib.sha256(" ".join(plain_collapse(words, runs)).encode()).hexdigest())
        assert got[doc_id, digest] == expected
