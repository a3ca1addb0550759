"""The registered queries beside their SQL, and the pipeline stage by stage."""

import collections

import duckdb
import pytest

import corpus_pipeline
from check import TABLES, compare
from fixatio.llm import line_dedup, mixing, neardup, packing, quality
from fixatio.llm.common import store, table
from fixatio.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for t in TABLES:
        own.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return own


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - {"pipeline"}))
def test_row_per_document(spark, name):
    out = QUERIES[name](spark, SF)
    if name.startswith(("op2", "op5", "op7", "op9")):
        ids = collections.Counter(r.doc_id for r in out.select("doc_id").collect())
        assert ids == collections.Counter(r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect())
    else:
        assert out.count() > 0


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(store(stage(spark, seen[-1], SF), name))
        assert seen[-1].columns == docs.columns
    raw, good, lines, near, mix = ([tuple(r) for r in x.collect()] for x in seen)
    scores = {r.doc_id: r.keep for r in quality.score(docs, quality.learn(docs, table(spark, SF, "labels"))).collect()}
    assert sorted(map(str, good)) == sorted(str(r) for r in raw if scores[r[0]])
    assert len(lines) == len(good) and all(r[4] == len(r[1] or "") for r in lines)
    classes = neardup.near_duplicates(seen[2]).collect()
    assert len(near) == len({r.class_id for r in classes}) and {r[0] for r in near} == {r.doc_id for r in classes if r.stays}
    times = {r.doc_id: r.copies for r in mixing.mixed(mixing.doc_sizes(seen[3])).collect()}
    assert collections.Counter(r[0] for r in mix) == {i: n for i, n in times.items() if n}
    out = corpus_pipeline.packed(spark, seen[4], SF).collect()
    whole = {(r.doc_id, r.doc_tokens) for r in out}
    assert sum(r.length for r in out) == sum(n * times[i] for i, n in whole)
    assert {i for i, _ in whole} == {r[0] for r in mix}
    assert len(corpus_pipeline.run(spark, SF).collect()) == len(out)
    assert line_dedup and packing
