"""Every query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import check, connect

QUERIES, STATEMENTS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(STATEMENTS))
def test_same_result(spark, sf, con, name):
    assert check(spark, con, name, QUERIES[name], STATEMENTS[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(STATEMENTS)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["region", "count"] and out.count() > 0
