"""Every registered query against its SQL, on the smallest tables."""

import sys

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
import check

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in check.TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, db, name):
    result = QUERIES[name](spark, SF_DIR)
    relation = db.sql(ORACLES[name])
    assert sorted(result.columns) == sorted(relation.columns)
    want = check.canonical(relation.df().astype(object))
    assert check.canonical(result.toPandas().astype(object)) == want


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_flagship(spark):
    assert entry.entry(spark).count() == 10
    assert "weft" in sys.modules
