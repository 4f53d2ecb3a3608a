"""Every query gives what DuckDB gives on the same tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracle.compare import connect, differences
from oracle.duckdb_sql import SQL
from oracle.spark_queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(queries()) and set(SQL) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, SQL[name]) is None


def test_entry(spark):
    assert entry(spark).count() > 0
