"""Every query against its SQL in DuckDB, over the smallest tables."""

import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidewatt import queries as metering

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return str(value.normalize() + 0)
    return repr(round(value, 4)) if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(metering.QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    rows = df.collect()
    if name in metering.SQL:
        result = duck.execute(metering.SQL[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == sorted(tuple(map(plain, r)) for r in result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
