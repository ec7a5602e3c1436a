"""Every named query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(testdata):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{testdata}/{table}.parquet'")
    return connection


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, testdata, name):
    result = entry.queries()[name](spark, testdata)
    columns = sorted(result.columns)
    got = sorted((tuple(r[c] for c in columns) for r in result.collect()), key=str)
    assert got
    if name in ORACLES:
        answer = duck.execute(ORACLES[name])
        names = [d[0] for d in answer.description]
        assert sorted(names) == columns
        order = [names.index(c) for c in columns]
        expected = sorted((tuple(row[i] for i in order) for row in answer.fetchall()), key=str)
        assert got == expected
