"""Token alignment against plain loops over byte offsets, and awkward texts."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from fixatio.llm import alignment, digests
from fixatio.llm.digests import tokenizer_path

SCHEMA = "doc_id long, text string, row string, n_a int, a string, b string, _key int"
A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "plain words here", "plain words here", "  two  blanks\n\n\tand tabs \r\n", "naïve café – “quotes” 日本語 текст 🙂🙂",
    "<|endoftext|> </s> <unk> <0x41>", "▁ a piece mark", "x" * 3000, " " * 500, "日" * 700, "a\u0000b", "İstanbul ß ﬁ",
    "=" * 777 + "word" * 50, "   wide blanks 　", "1234567890" * 30, "ends with blank ",
]


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_align(text, tools):
    """(groups as lists of A ids and B ids) by the byte offsets at which both end a token."""
    if not text:
        return []
    tokenizer, pieces = tools
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    as_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
    bs_bytes = [
        bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)
    ]
    whole = (" " + text).encode()
    if b"".join(as_bytes) != whole or b"".join(bs_bytes) != whole:
        return []
    ends = [np.cumsum([len(x) for x in side]).tolist() for side in (as_bytes, bs_bytes)]
    groups, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        stop = [e.index(cut) + 1 for e in ends]
        groups.append((a[at[0]:stop[0]], b[at[1]:stop[1]]))
        at = stop
    return groups


def plain(texts, tools):
    found = [plain_align(x, tools) for x in texts]
    links = [collections.Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in found]
    count = collections.Counter(pair for doc in links for pair in doc)
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, doc in zip(found, links):
        line = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(doc.values()),
            sum(n for pair, n in doc.items() if count[pair] == best[pair[0]]), sum(n * count[pair] for pair, n in doc.items()), line,
        ))
    return out


def many(n):
    rnd = random.Random(4)
    letters = list("etaoin shrdlu  .,\n\t-'éüß日語🙂▁0123456789ABC") + ["the ", "ing ", "<|endoftext|>", "    "]
    return ["".join(rnd.choices(letters, k=rnd.randrange(0, 60))) for _ in range(n)]


def test_coalescing_is_cutting_at_common_ends():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = rng.integers(1, 60)
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(0, 20)), n)) for _ in (0, 1)]
        start = np.concatenate([np.insert(e[:-1], 0, 0) for e in ends])
        side = np.repeat([0, 1], [len(e) for e in ends])
        end = np.concatenate(ends)
        order, group = alignment.coalesce(start, end, side)
        common = np.intersect1d(*ends)
        assert group.tolist() == np.searchsorted(common, end[order]).tolist()
        assert (start[order][1:] >= start[order][:-1]).all()


@pytest.mark.parametrize("hot, wide", [(1 << 16, 1 << 14), (40, 3), (1, 1 << 14)])
def test_operator_is_the_plain_one(spark, monkeypatch, tools, hot, wide):
    monkeypatch.setattr(alignment, "HOT", hot)
    monkeypatch.setattr(alignment, "_WIDE", wide)
    texts = TEXTS + many(150)
    docs = spark.createDataFrame([(i % 40 or None, x, "clash", 1, "a", "b", 2) for i, x in enumerate(texts)], SCHEMA).repartition(3)
    import public_tokenizers as P

    out = alignment.aligned(docs, A, B, P.PATTERN).collect()
    got = sorted(map(str, ((r.row.text, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in out)))
    assert got == sorted(str((x, *p)) for x, p in zip(texts, plain(texts, tools)))
    assert all(r.row.row == "clash" and r.row._key == 2 for r in out)


def test_units_are_the_whole_text(tools):
    """Remembered units, a memory that is too small, units that are not given back: the same result."""
    left, right = alignment.ByteTokens(A, public_tokenizers.PATTERN), alignment.PieceTokens(B)
    rnd = random.Random(6)
    words = ["rain", "Rain,", "it's", "«été»", "日本", "x1y22", "--", "▁", "a▁b", "<|endoftext|>", "=" * 40, "U.S.", "\u0001", "don't"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" "] * 30 + ["\n"] * 9 + ["  ", "\t", " \n"]) for _ in range(rnd.randrange(1, 25))).strip() for _ in range(300)]
    whole = alignment.Aligner(left, right)
    assert whole.by_units
    whole.by_units = False
    for remember in (200_000, 5):
        aligner = alignment.Aligner(left, right, remember)
        for lo in range(0, 300, 100):
            some = texts[lo:lo + 100]
            assert len(aligner._units_of(some)) > 20
            got, expected = aligner.align(some), whole.align(some)
            for name in ("n_a", "n_b", "n_groups", "n_links", "groups"):
                assert got[name] == expected[name]
            for x, y in zip(got["pairs"], expected["pairs"]):
                assert [v.tolist() for v in x] == [v.tolist() for v in y]
    assert not any("▁" in u for u in aligner.index)


def test_pairs_of_wide_groups():
    rng = np.random.default_rng(2)
    n_a, n_b, text = np.array([300, 1, 2]), np.array([200, 1, 3]), np.array([0, 0, 5])
    a, b = rng.integers(0, 9, 303), rng.integers(0, 9, 204)
    key, times = alignment._links(a, b, n_a, n_b, text)
    expected, i, j = collections.Counter(), 0, 0
    for x, y, t in zip(n_a, n_b, text):
        expected.update((int(t) << 40) + (int(p) << 20) + int(q) for p in a[i:i + x] for q in b[j:j + y])
        i, j = i + x, j + y
    assert dict(zip(key.tolist(), times.tolist())) == expected


def test_encoder_takes_the_ids_of_the_tokenizer(tools):
    encoder = alignment.ByteTokens(A, public_tokenizers.PATTERN)
    texts = [" " + x for x in TEXTS if x] + many(300)
    assert encoder.encode(texts) == [tools[0].encode(x, add_special_tokens=False).ids for x in texts]


def test_query_and_empty_table(spark, tmp_path, tools):
    texts = TEXTS + many(20)
    for name, rows in (("some", list(enumerate(texts))), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    got = [tuple(r) for r in digests.cross_tokenizer_alignment(spark, f"{tmp_path}/some").orderBy("doc_id").collect()]
    assert got == [
        (i, *p[:-1], hashlib.sha256(p[-1].encode()).hexdigest() if p[-1] else "") for i, p in enumerate(plain(texts, tools))
    ]
    assert digests.cross_tokenizer_alignment(spark, f"{tmp_path}/none").collect() == []
