"""Every registered query with reference SQL gives the same rows as DuckDB."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_check import compare, connect

SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = connect(sf_dir)
    problem = compare(queries()[name](spark, sf_dir), con, SQL[name])
    spark.catalog.clearCache()
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0


def test_sql_keys_are_queries():
    assert set(SQL) <= set(queries())
