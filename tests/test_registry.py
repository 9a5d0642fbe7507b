"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from panelmill.plans.registry import QUERIES, SQL
from tests.oracle import DATA, compare, connect

SF = str(DATA / "sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert len(SQL) >= 120


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
