"""Queries with SQL twins, on the smallest tables."""

import duckdb
import pytest

from gristmill.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    if ORACLE[name] is None:
        pytest.skip("no SQL form")
    base = duckdb.connect()
    for table in "documents pages labels benchmark embeddings".split():
        base.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    cursor = base.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    ours = sorted(repr(tuple(row[c] for c in columns)) for row in frame.collect())
    assert ours == sorted(map(repr, cursor.fetchall()))


def test_names():
    for n in range(1, 14):
        assert len([name for name in QUERIES if name.startswith(f"op{n}_")]) == 1
    assert "pipeline" in QUERIES
