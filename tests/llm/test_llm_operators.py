"""Each operator against a plain version, and on the awkward inputs its docstring names."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fixatio.llm import ann, components, langid, line_dedup, mixing, neardup, packing, quality, repeats, topk, warc
from fixatio.llm.common import scratch
from fixatio.llm.digests import tokenizer_path
from fixatio.llm.suffix import common_prefixes, suffix_array

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _k1 string, row string, slot int, kept int"
WORDS = "the of rain falls softly on quiet hills while old dogs sleep near warm fires and dream about rivers".split()


def prose(seed, n=120):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{rng.integers(60)}" for i in rng.integers(0, len(WORDS), n))


AWKWARD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n ", "en", "b", 4), (None, "no id here", "en", "a", 10),
    (None, None, None, None, None), (5, "same text", "en", "a", 9), (5, "same text", "en", "a", 9), (6, "same text", "fr", "b", 9),
    (7, "é日本\u0001 ﬁ <|endoftext|> Σας İ", "fr", "c", 30), (8, prose(3, 30_000), "en", "c", 0), (9, "A" * 5000, "en", "b", 5000),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", "clash", 7, 8) for r in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# 1: packing


def test_tightest_window():
    tree = packing.RoomTree(8)
    for room in (3, 5, 5, 8):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 6, 8)] == [3, 3, 5, 8, 8]
    tree.add(8, -1)
    assert tree.tightest(6) == -1


def test_best_fit_is_the_plain_one():
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = rng.integers(1, 33, 200).tolist()
        rooms, expected = [], [0] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            fits = [r for r in rooms if r >= lengths[i]]
            if fits:
                rooms.remove(min(fits))
            rest = (min(fits) if fits else 32) - lengths[i]
            rooms += [rest] if rest else []
            expected[i] = 32 - rest - lengths[i]
        window, offset = packing.best_fit(lengths, 32)
        used = collections.defaultdict(list)
        for n, w, o in zip(lengths, window, offset):
            used[w].append((o, n))
        assert sorted(offset) == sorted(expected)
        for parts in used.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 32


def test_packed_documents(spark, awkward, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    out = packing.packed_documents(awkward, path).collect()
    expected = collections.Counter()
    for doc_id, text, *_ in AWKWARD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 2048):
            data = np.array(ids[at:at + 2048], "<u4").tobytes()
            expected[doc_id, at, len(data) // 4, zlib.crc32(data), len(ids), data] += 1
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in out) == expected
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert rows(packing.packed_documents(nothing, path)) == []


def test_encoder_equals_tokenizer_on_odd_words():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer, encoder = Tokenizer.from_file(path), packing.WordEncoder(path, remember=20)
    rng = np.random.default_rng(2)
    letters = list("abcxyzABCÉéüßñœ0 19,.!?%'\n\t-_*&|ªº²ł日") + ["'s", "<|", "́", "\xa0", "İ", "Σ"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(2000)]
    got = encoder.encode(texts[:1000]) + encoder.encode(texts[1000:])
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


# 2: repeated strings


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(3)
    for _ in range(20):
        t = rng.integers(97, 99, rng.integers(1, 300)).astype(np.uint8)
        b, sa = t.tobytes(), suffix_array(t)
        assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
        found = common_prefixes(t, sa, np.array([0]), np.array([len(b)]), 40)
        for p in range(1, len(b)):
            x, y = b[sa[p - 1]:], b[sa[p]:]
            same = next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))
            assert found[p] == min(same, 40)


def plain_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(b[j:j + length] for b in data for j in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for j in range(len(b) - length + 1):
            if count[b[j:j + length]] > 1:
                gone[j:j + length] = 1
        spans = np.flatnonzero(np.diff(np.concatenate([[0], gone]))).reshape(-1, 2).tolist()
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), tuple(map(tuple, spans)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [False, True])
def test_repeated_strings(spark, monkeypatch, split):
    if split:  # flushes, hot anchors and shards so small that every way is taken
        for name, value in {"FLUSH": 300, "BUCKET": 100, "HOT": 3, "SPLIT": 4, "SHARD_BYTES": 2000, "LONGEST": 700}.items():
            monkeypatch.setattr(repeats, name, value)
    rng = np.random.default_rng(4)
    passages = [prose(100 + i, 12) for i in range(3)]
    texts = [None, "", "short", "ab" * 300, "x" * 100, "x" * 99 + "y", prose(50, 400), prose(50, 400), "é" * 90]
    for i in range(60):
        parts = [prose(200 + i, 20), passages[i % 3], prose(300 + i, 15), passages[int(rng.integers(3))] if i % 4 else ""]
        texts.append(" ".join(parts))
    texts += [texts[12][:150] + " " + texts[13][40:], texts[14].replace("rain", "snow")]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, slot int").repartition(3)
    out = {r.doc_id: (r.n_bytes, tuple((x.start, x.stop) for x in r.removed), r.sha) for r in repeats.repeated_strings(df, length=60, gram=16).collect()}
    expected = plain_repeats(texts, 60)
    assert [out[i] for i in range(len(texts))] == expected


def test_repeated_strings_awkward(spark, awkward, nothing):
    out = collections.Counter(
        (r.doc_id, r.n_bytes, tuple((x.start, x.stop) for x in r.removed), r.sha) for r in repeats.repeated_strings(awkward).collect()
    )
    texts = [t if t is None or len(t) < 10_000 else None for _, t, *_ in AWKWARD]
    plain = plain_repeats(texts, 200)
    for (doc_id, text, *_), row in zip(AWKWARD, plain):
        if text is None or len(text) < 10_000:
            assert out[doc_id, *row] >= 1
    assert sum(out.values()) == len(AWKWARD)
    assert rows(repeats.repeated_strings(nothing)) == []


# 3: line dedup


def plain_lines(docs, min_docs, keep):
    split = [(t or "").split("\n") for _, t in docs]
    key = [[x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in ls] for ls in split]
    count = collections.Counter(k for ks in key for k in set(ks))
    gone = {k for k, n in count.items() if n >= min_docs and k}
    if keep == "none":
        return [[x for x, k in zip(ls, ks) if k not in gone] for ls, ks in zip(split, key)]
    return [sum(k in gone for k in ks) for ks in key]


@pytest.mark.parametrize("keep", ["none", "first"])
def test_lines(spark, keep):
    rng = np.random.default_rng(5)
    pool = ["Alpha", " alpha\t", "beta", "", "  ", "É", "é", "gamma delta", "ALPHA"] + [f"only {i}" for i in range(40)]
    docs = [(i, "\n".join(rng.choice(pool, rng.integers(0, 130)).tolist())) for i in range(40)] + [(None, None), (None, "Alpha")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = line_dedup.dedup_lines(df, min_docs=5, keep=keep).select("row.doc_id", "row.text", "kept").collect()
    kept = {(r.doc_id, r.text): r.kept for r in found}
    plain = plain_lines(docs, 5, keep)
    if keep == "none":
        assert [kept[d] for d in docs] == plain
    else:  # one occurrence of each frequent key stays
        split = [(t or "").split("\n") for _, t in docs]
        lost = sum(len(s) - len(kept[d]) for d, s in zip(docs, split))
        kinds = {x.strip(" \t").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for s in split for x in s}
        gone = {k for k in kinds if k and sum(k in {x.strip(" \t").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in s} for s in split) >= 5}
        assert lost == sum(plain) - len(gone)


def test_lines_awkward(awkward, nothing):
    out = line_dedup.without_frequent_lines(awkward, min_docs=3)
    assert out.columns == awkward.columns
    got = collections.Counter((r.doc_id, r.text, r._k1, r.kept) for r in out.collect())
    expected = collections.Counter((i, "" if t == "same text" else t, "clash", 8) for i, t, *_ in AWKWARD)
    assert got == expected
    assert rows(line_dedup.without_frequent_lines(nothing)) == []


# 4: WARC


def test_archives(spark):
    html = ["<p>" + prose(i, 40) + "</p>" for i in range(6)] + [prose(9, 30_000), "", None, "tiny", "tiny", "\r\n\r\nWARC/1.1\r\n0\r\n\r\n" * 20]
    pages = [(i, f"http://x/{i}\nbad", h) for i, h in enumerate(html)] + [(20, None, html[0]), (21, "u", html[0]), (0, "again", html[0]), (None, "n", html[1])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    path = scratch(spark, "warc-test")
    warc.write_archives(df, path, segment=1000)
    out = warc.read_archives(spark, path).collect()
    assert all(r.complete for r in out) and len(out) == len(pages)
    ids = {r.record_id: r for r in out}
    assert len(ids) == len(pages)
    first = {}
    for i, _, h in sorted(pages, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(h or "", i)
    for r in out:
        if r.kind == "response":
            assert hashlib.sha256(r.payload).hexdigest() == r.digest.removeprefix("sha256:")
        else:
            target = ids[r.refers_to]
            assert target.kind == "response" and target.digest == r.digest and int(target.page_id) == first[target.payload.decode()]
    kinds = collections.Counter(r.kind for r in out)
    assert kinds == {"response": len(pages) - 4, "revisit": 4}


def test_broken_segments(spark):
    row = {"key": "1", "url": "u", "payload": prose(1, 400).encode(), "digest": "d", "copy": 0, "refers_key": None}
    records = list(warc.records_of(row, 500))
    good = [b"".join(x + b"\r\n\r\n" for x in records)]
    assert len(records) > 3
    parsed = list(warc.parse(iter(good)))
    assert len(parsed) == len(records)
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabcde\r\n0\r\n\r\n") == b"abcde"
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n9\r\nabcde\r\n0\r\n\r\n") is None
    path = scratch(spark, "warc-broken")
    lines = spark.createDataFrame([(x.decode(),) for i, x in enumerate(reversed(records)) if i != 1], "value string").coalesce(1)
    lines.write.option("lineSep", "\r\n\r\n").text(path)
    (out,) = warc.read_archives(spark, path).collect()
    assert not out.complete and out.payload is None and out.page_id == "1"
    whole = scratch(spark, "warc-mixed-up")
    spark.createDataFrame([(x.decode(),) for x in reversed(records)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(whole)
    (out,) = warc.read_archives(spark, whole).collect()
    assert out.complete and out.payload == row["payload"]


# 5: near-duplicates


def plain_classes(docs, threshold=0.8):
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in docs]
    n = collections.Counter(w for ws in split for w in set(ws))
    idf = {w: math.log((1 + len(docs)) / (1 + c)) + 1 for w, c in n.items()}
    bags = []
    for ws in split:
        k = min(5, len(ws))
        bag = collections.Counter(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)) if ws else {}
        bags.append({s: c * sum(idf[w] for w in s) / k for s, c in bag.items()})
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(bags):
        for j in range(i):
            b = bags[j]
            common = sum(min(v, b[s]) for s, v in a.items() if s in b)
            if (docs[i][1] or "") == (docs[j][1] or "") or (a and b and common / (sum(a.values()) + sum(b.values()) - common) >= threshold):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(docs)):
        members[find(i)].append(docs[i][0])
    return {x: min(m) for m in members.values() for x in m}, {x: len(m) for m in members.values() for x in m}


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates(spark, block):
    rng = np.random.default_rng(6)
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "one two"), (5, "one two three")]
    for g in range(12):
        base = prose(g, 150).split()
        for _ in range(int(rng.integers(1, 20))):
            words = list(base)
            for at in rng.integers(0, len(words), int(rng.integers(0, 7))):
                words[at] = f"edit{rng.integers(10_000)}"
            docs.append((len(docs), " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    out = neardup.near_duplicates(df, block=block).collect()
    classes, sizes = plain_classes(docs)
    assert {r.doc_id: r.class_id for r in out} == classes
    assert {r.doc_id: r.class_size for r in out} == sizes
    assert {r.doc_id for r in out if r.stays} == set(classes.values())


def test_near_duplicates_awkward(awkward, nothing):
    out = neardup.keep_one(awkward)
    assert out.columns == awkward.columns
    got = sorted((str(r.doc_id), (r.text or "")[:20]) for r in out.collect())
    assert got == sorted([
        ("1", ""), ("3", " \t\n "), ("None", "no id here"), ("5", "same text"), ("7", AWKWARD[8][1][:20]),
        ("8", AWKWARD[9][1][:20]), ("9", "A" * 20),
    ])
    assert rows(neardup.near_duplicates(nothing)) == []


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(i, i + 1) for i in range(0, 50)] + [(1000, i) for i in range(100, 160)] + rng.integers(2000, 2200, (150, 2)).tolist()
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "x long, y long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    expected = {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert dict(rows(components.components(df, "x", "y"))) == expected


# 6, 8: vectors


def vectors(spark, n=300, dim=12):
    rng = np.random.default_rng(8)
    data = [(i, rng.standard_normal(dim).tolist(), 0) for i in range(n)]
    data += [(n, data[0][1], 0), (n, data[0][1], 0), (n + 1, None, 0), (n + 2, [], 0), (n + 3, [1.0, None] * (dim // 2), 0)]
    data += [(n + 4, [float("nan")] + [1.0] * (dim - 1), 0), (n + 5, [0.0] * dim, 0), (None, data[1][1], 0), (400, [1.0, 2.0], 0)]
    return data, spark.createDataFrame(data, "vec_id long, embedding array<double>, block int")


def taking_part(data, nonzero):
    return [
        (i, v) for i, v, _ in data
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero)
    ]


def test_top_k(spark):
    data, df = vectors(spark)
    use = [(i, [math.floor(256 * x) for x in v]) for i, v in taking_part(data, False)]
    expected = []
    for a, (i, q) in enumerate(use):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(use) if b != a and len(v) == len(q))
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:5])]
    assert sorted(rows(topk.top_k(df.repartition(3), F.col("vec_id") % 50 == 0))) == sorted(expected)
    assert rows(topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0)) == []


def test_top_k_of_huge_numbers(spark):
    data = [(0, [1e12, 3.0], 0), (1, [1e12, 2.0], 0), (2, [-1e200, 1.0], 0), (3, [1e5, 7.0], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, block int")
    own = [[math.floor(256 * x) for x in v] for _, v, _ in data]
    hold = lambda s: max(-(2**63 - 1), min(2**63 - 1, s))
    expected = sorted((-hold(sum(a * b for a, b in zip(own[0], own[i]))), i) for i in (1, 2, 3))
    assert rows(topk.top_k(df, F.col("vec_id") == 0).orderBy("rank")) == [(0, r + 1, i, -s) for r, (s, i) in enumerate(expected)]


def test_nearest(spark):
    data, df = vectors(spark, 1500, 16)
    use = taking_part(data, True)
    x = {i: np.array(v) for i, v in use if len(v) == 16}
    out = rows(ann.nearest(df.repartition(3), F.col("vec_id") % 50 == 0))
    hits = total = 0
    for q in [i for i in x if i % 50 == 0 and i < 1500]:
        every = [(-(v @ x[q]) / np.linalg.norm(v) / np.linalg.norm(x[q]), i) for i, v in use_rows(use) if i != q]
        best = sorted(every)[:5]
        got = sorted(r for r in out if r[0] == q)
        assert [r[1] for r in got] == [1, 2, 3, 4, 5]
        for _, _, i, score in got:
            assert abs(score - x[i] @ x[q] / np.linalg.norm(x[i]) / np.linalg.norm(x[q])) < 1e-12
        hits += sum(r[3] >= -best[-1][0] - 1e-9 for r in got)
        total += 5
    assert hits / total >= 0.9
    assert rows(ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0)) == []


@pytest.mark.parametrize("dim", [64, 128, 256, 768])
def test_nearest_of_long_vectors(dim):
    """Vectors without near neighbours: the longer they are, the farther is the nearest."""
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((4000, dim))
    ids, asked, k = np.arange(len(x)), np.arange(0, len(x), 200), 5
    found = ann.searcher()((ids[asked], ids[asked], x[asked]), (ids, ids, x, []), k)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i, a in enumerate(asked):
        s = u @ u[a]
        s[a] = -2
        got = found[1][found[0] == i]
        assert len(set(got.tolist())) == k and a not in got
        hits += len(set(got.tolist()) & set(np.argsort(-s)[:k].tolist()))
    assert hits / (k * len(asked)) >= 0.9


def test_nearest_of_few_and_of_opposite_vectors():
    x = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 2.0]])
    ids = np.arange(3)
    rows_, found, score = ann.searcher()((ids[:1], ids[:1], x[:1]), (ids, ids, x, []), 5)
    assert (rows_.tolist(), found.tolist(), score.tolist()) == ([0, 0], [2, 1], [0.0, -1.0])


def test_nearest_among_copies(spark):
    """Of many equal vectors the smallest ids are taken."""
    rng = np.random.default_rng(13)
    hot = rng.standard_normal(64).astype(np.float32).tolist()
    data = [(i, hot if i % 3 else rng.standard_normal(64).astype(np.float32).tolist(), 0) for i in range(1200)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, block int").repartition(3)
    out = rows(ann.nearest(df, F.col("vec_id").isin(50, 1000)))
    assert sorted(r[:3] for r in out) == [(q, r + 1, v) for q in (50, 1000) for r, v in enumerate((1, 2, 4, 5, 7))]
    assert len({r[3] for r in out}) == 1


def use_rows(use):
    return [(i, np.array(v)) for i, v in use if len(v) == 16]


# 7: quality


def test_quality(spark, awkward, nothing):
    rng = np.random.default_rng(9)
    docs, labels = [], []
    for i in range(400):
        text = prose(i, int(rng.integers(30, 200)))
        bad = i % 7 == 0
        if bad:
            text = [" ".join(f"{w.upper()}!!" for w in text.split()), " ".join([text.split()[0]] * 60), re.sub(" ", "### ", text)][i % 3]
        docs.append((i, text, "en", f"s{i % 3}", len(text), "x", "x", 1, 1))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    df = spark.createDataFrame(docs, SCHEMA)
    known = spark.createDataFrame([*labels, (None, 0, 0), (1, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.score(df, quality.learn(df, known)).collect()}
    held = [i for i in range(400) if i % 2 == 0]
    wrong = [i for i in held if out[i].keep != (i % 7 != 0)]
    assert len(wrong) <= 2 and all(0 <= r.quality_score <= 1 for r in out.values())
    kept = quality.keep_good(awkward, known)
    assert kept.columns == awkward.columns
    none = quality.score(awkward, None).collect()
    assert len(none) == len(AWKWARD) and all(r.keep and r.quality_score is None for r in none)
    model = quality.learn(df, known)
    assert quality.score(awkward, model).count() == len(AWKWARD)
    assert rows(quality.score(nothing, model)) == [] and quality.learn(nothing, known) is None


# 9: language


def test_language(spark, awkward, nothing):
    words = {"en": "the of and to in is that for it was".split(), "fr": "le de un être et à il avoir ne je".split(), "de": "der die und in den von zu das mit sich".split()}
    rng = np.random.default_rng(10)
    docs = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(rng.choice(list(words), 300).tolist())]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    counts = langid.learn(df.filter(~langid.held_out("doc_id")))
    out = {r.doc_id: r for r in langid.identify(df, counts).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in docs)
    for r in langid.identify(awkward, counts).collect():
        text = [t for i, t, *_ in AWKWARD if i == r.doc_id]
        if all(not t or not any(c.isalpha() for c in t) for t in text):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(awkward, {}).collect()} == {"und"}
    assert rows(langid.identify(nothing, counts)) == [] and langid.learn(nothing.filter("lang is not null")) == {}


def test_languages_of_many_scripts(spark):
    """Two small languages differ in rare lead bytes only, beside large ones that use most byte values."""
    rng = np.random.default_rng(14)
    scripts = {"en": range(97, 123), "ru": range(0x430, 0x450), "zh": range(0x4E00, 0x5200), "ko": range(0xAC00, 0xB000), "he": range(0x5D0, 0x5E0), "syc": range(0x710, 0x720)}
    docs = []
    for lang, letters in scripts.items():
        for _ in range(8 if lang in ("he", "syc") else 60):
            words = ["".join(map(chr, rng.choice(letters, 5))) for _ in range(10 if lang in ("he", "syc") else 60)]
            docs.append((len(docs), " ".join(words), lang))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    out = {r.doc_id: r.lang_pred for r in langid.identify(df, langid.learn(df.filter(~langid.held_out("doc_id")))).collect()}
    assert [(i, out[i]) for i, _, _ in docs] == [(i, lang) for i, _, lang in docs]


def test_code_lengths_of_all_bytes():
    """Each byte value has a symbol of its own, whatever else was learned."""
    train = bytes(range(32, 65)) + bytes(range(91, 244))
    padded = b"   " + train
    counts = {"a": (np.array(sorted({int.from_bytes(padded[i:i + 4], "big") for i in range(len(train))})), np.ones(len(train), np.int64))}
    trees = langid.ContextTrees(counts)
    assert len({int(trees.symbol[b]) for b in range(256)}) == 256 - 26
    kinds = len(set(train))
    # After three bytes that never came before: 186 symbols of 186 kinds at order 0; unseen ones pay the escape of 1/2 and 8 bits.
    got = trees.lengths(np.frombuffer(bytes([250, 251, 252, 200]) + bytes([250, 251, 252, 253]), np.uint8), np.array([0, 3, 4, 7, 8]))
    seen, unseen = math.log2(2 * kinds), 1 + 8
    first = math.log2(2)  # a context of blanks, or of one blank more, that was seen with another byte
    assert abs(got[1, 0] - (3 * first + seen)) < 1e-4
    assert abs(got[3, 0] - (3 * first + unseen)) < 1e-4


def test_code_lengths_are_the_plain_ones():
    rng = np.random.default_rng(11)
    train = {"a": b"abracadabra abra", "b": b"banana bandana"}
    counts = {}
    for lang, text in train.items():
        padded = b"   " + text
        grams = collections.Counter(int.from_bytes(padded[i:i + 4], "big") for i in range(len(text)))
        keys = np.array(sorted(grams))
        counts[lang] = (keys, np.array([grams[int(k)] for k in keys]))
    trees = langid.ContextTrees(counts)
    code = {b: int(trees.symbol[b]) for b in range(256)}

    def plain(text, lang):
        padded, train_padded = "   " + text, "   " + train[lang].decode()
        bits = 0.0
        for i in range(len(text)):
            symbol = code[ord(padded[i + 3])]
            for order in (3, 2, 1, 0, -1):
                if order < 0:
                    bits += math.log2(langid.SYMBOLS)
                    break
                context = [code[ord(c)] for c in padded[i + 3 - order:i + 3]]
                seen = collections.Counter(
                    code[ord(train_padded[j + 3])] for j in range(len(train[lang]))
                    if [code[ord(c)] for c in train_padded[j + 3 - order:j + 3]] == context
                )
                n, d = sum(seen.values()), len(seen)
                if n and symbol in seen:
                    bits -= math.log2(seen[symbol] / (n + d))
                    break
                if n:
                    bits -= math.log2(d / (n + d))
        return bits

    texts = ["abra", "banana", "", "zq!", "".join(rng.choice(list("abcdnr "), 30))]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.cumsum([0, *map(len, texts)])
    got = trees.lengths(data, at)
    for i, text in enumerate(texts):
        for k, lang in enumerate(trees.langs):
            assert got[i, k] == pytest.approx(plain(text, lang), abs=1e-4)


# 10: mixing


def plain_targets(sizes, weights, most=3):
    total, full = sum(sizes), set()
    while True:
        share = (total - sum(most * sizes[i] for i in full)) / max(1, sum(w for i, w in enumerate(weights) if i not in full))
        more = {i for i, w in enumerate(weights) if i not in full and most * sizes[i] <= w * share}
        if not more:
            return [most * s if i in full else w * share for i, (s, w) in enumerate(zip(sizes, weights))]
        full |= more


def test_targets(spark):
    rng = np.random.default_rng(12)
    names = [f"s{i:02}" for i in range(9)] + ["é", "Z", None]
    docs = [(i, names[int(n)], int(rng.integers(0, 50)) if n else 3000, "h") for i, n in enumerate(rng.integers(0, len(names), 400))]
    df = spark.createDataFrame(docs, "doc_id long, source string, size long, text_hash string").repartition(5)
    out = mixing.mixed(df).collect()
    order = sorted({d[1] for d in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(d[2] for d in docs if d[1] == s) for s in order]
    expected = plain_targets(sizes, [i % 3 + 1 for i in range(len(order))])
    for r in out:
        i = order.index(r.source)
        assert r.source_size == sizes[i] and r.target == pytest.approx(expected[i]) and 0 <= r.copies <= 3
        assert abs(r.copies - expected[i] / sizes[i]) < 1
    assert {r.doc_id: r.copies for r in out} == {r.doc_id: r.copies for r in mixing.mixed(df.repartition(2)).collect()}


def test_mixing_awkward(awkward, nothing):
    out = mixing.repeated_documents(awkward)
    assert out.columns == awkward.columns
    most = collections.Counter(r.doc_id for r in out.collect())
    own = collections.Counter(i for i, *_ in AWKWARD)
    assert all(n <= 3 * own[i] for i, n in most.items())
    assert rows(mixing.repeated_documents(nothing)) == []
    sizes = {(r.doc_id, r.size) for r in mixing.doc_sizes(awkward).collect()}
    assert {(1, 0), (2, 0), (3, 0), (5, 2), (8, 30_000)} <= sizes


def test_word_frequencies_are_exact_and_scale_free(spark):
    """Every word is counted by itself; only how common a word must be to count depends on the corpus."""
    docs = [" ".join(f"w{j}" for j in range(i % 40 + 1)) + f" own{i} own{i}" for i in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in docs], "text string").repartition(3)
    idf = neardup.inverse_frequencies(df)
    n = collections.Counter(w for t in docs if t for w in set(t.split()))
    words = sorted(n)
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    keys, _ = neardup._words(data, np.array([0, len(data)]))
    assert idf.of(keys).tolist() == pytest.approx([math.log(403 / (1 + n[w])) + 1 for w in words])
    assert len(idf.word) == len(n)  # words of one hash each, not places they share


def test_rare_words_weigh_as_the_limit(spark, monkeypatch):
    monkeypatch.setattr(neardup, "COMMON", 50)
    docs = ["common " + " ".join(f"x{i}y{j}" for j in range(9)) for i in range(60)]
    idf = neardup.inverse_frequencies(spark.createDataFrame([(t,) for t in docs], "text string"))
    assert len(idf.word) == 1 and idf.value[0] == pytest.approx(1.0)
    assert idf.rare == pytest.approx(math.log(61 / (1 + 600 / 50)) + 1)
