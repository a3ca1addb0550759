"""Every registered query with SQL gives what DuckDB gives, on the small test tables."""

import os

import pytest
from check import compare, connect

import __spark_entry__ as entry

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
#: Queries that need more rows than the small tables hold, and tables that hold them.
LARGER = dict.fromkeys(["static_correlations", "tlbs_correlations"], "/root/testdata/sf0.1")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(df.columns) > 50


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    if name in LARGER:
        found = compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
        assert found in (None, "EMPTY")
        larger = LARGER[name]
        assert compare(spark, connect(larger), larger, entry.queries()[name], entry.oracle_sql()[name]) is None
        return
    assert compare(spark, con, SF_DIR, entry.queries()[name], entry.oracle_sql()[name]) is None
