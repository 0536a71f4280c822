"""Every registered activity query against its DuckDB equivalent on whole tables."""

from __future__ import annotations

import pytest
from conftest import DATA, assert_same, duck

from pulsegrid import registry


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(name, spark, con):
    assert_same(registry.QUERIES[name](spark, f"{DATA}/sf0.001"), con, registry.ORACLE_SQL[name])


def test_queries_without_sql_give_rows(spark):
    for name in sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()):
        assert registry.QUERIES[name](spark, f"{DATA}/sf0.001").count(), name


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns
    assert entry.oracle_sql().keys() <= entry.queries().keys()
