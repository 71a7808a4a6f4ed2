"""Every query of the catalogue against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__
from tests.conftest import TEST_DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES = __spark_entry__.queries()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TEST_DATA}/{name}.parquet'")
    return connection


def in_order(rows):
    missing = lambda v: v is None or (isinstance(v, float) and math.isnan(v))
    return sorted(
        ([None if missing(v) else v for v in row] for row in rows),
        key=lambda row: [(v is None, v if v is not None else 0) for v in row],
    )


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, TEST_DATA)
    columns = sorted(df.columns)
    result = duck.execute(ORACLES[name])
    names = [entry[0] for entry in result.description]
    assert sorted(names) == columns
    expected = [[row[names.index(c)] for c in columns] for row in result.fetchall()]
    found = [[row[c] for c in columns] for row in df.collect()]
    assert in_order(found) == in_order(expected)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
