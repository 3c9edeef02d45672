"""Every registered query against its DuckDB oracle on the smallest fixture."""

import pytest

import __spark_entry__ as entry
from tools.compare import compare, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


def test_every_query_has_a_callable():
    from slotwise.catalog import QUERIES

    assert set(ORACLES) <= set(entry.queries())
    assert set(QUERIES) <= set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, small_dir, name):
    got = entry.queries()[name](spark, small_dir).toArrow()
    want = con.sql(ORACLES[name]).to_arrow_table()
    assert compare(got, want) is None


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 10
    assert "annual_sales" in df.columns
