"""Registered queries against their SQL twins on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gristmill import suite

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()
ORACLE = suite.ORACLE


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if isinstance(value, float) and (math.isnan(value) or value == 0):
            return "0" if value == 0 else "nan"
        return repr(value)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(suite.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, database, name):
    frame = entry.queries()[name](spark, FOLDER)
    cursor = database.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    assert ours == canonical(columns, cursor.fetchall())
