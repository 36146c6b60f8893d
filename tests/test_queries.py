"""Every registered query against its SQL counterpart."""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as entry_points
from broadsheet.checks import oracles
from broadsheet.checks import queries as registered

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = registered.queries(), oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_is_an_entry_point():
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert difference(df, con, SQL[name]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_entry(spark):
    found = entry_points.entry(spark)
    assert found.count() == 20
    assert found.columns[:2] == ["collocate_term", "frequency"]
