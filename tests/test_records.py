"""CSV files with quoted line breaks, in many splits."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from gristmill.scratch import new_folder
from gristmill.sources.files import read_csv

CELLS = ["plain", "two\nlines", "a, b", 'say "x"', '"', '""\n"', "", "\n", 'x"y', "end,\n,", " spaced ", 'q"\n"r,"', "é\r\nü", "1"]


def written(folder, rows):
    path = f"{folder}.csv"
    with open(path, "w", encoding="utf-8", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows(rows)
    return path


@pytest.fixture
def small_splits(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", 1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept[0])
    spark.conf.set("spark.sql.files.openCostInBytes", kept[1])


@pytest.mark.parametrize("size", [64, 333, 100_000])
def test_random_cells(spark, small_splits, tmp_path, size):
    small_splits(size)
    rng = random.Random(size)
    rows = [[str(i), *("".join(rng.choice(CELLS) for _ in range(rng.randint(0, 4))) for _ in range(3))] for i in range(150)]
    rows[70][2] = "a long cell\n" * 60 + '"'  # over many splits
    path = written(tmp_path / "cells", [["k", "a", 'b "c"\nd', "e"], *rows])
    frame = read_csv(spark, path, typed=False)
    assert frame.columns == ["k", "a", 'b "c"\nd', "e"]
    found = {r[0]: tuple(r)[1:] for r in frame.collect()}
    assert len(found) == len(rows)
    for k, *cells in rows:
        # Blank cells are null; white space around a cell does not count where it is not quoted.
        assert [(c or "").strip() for c in found[k]] == [c.strip() for c in cells]


def test_stray_quotes_in_plain_cells(spark, small_splits, tmp_path):
    small_splits(40)
    path = tmp_path / "stray.csv"
    path.write_text('k,a\n1,5" pipe\n2,"two\nlines"\n3,6" and 7" pipes\n\n4,x\n')
    assert {r[0]: r[1] for r in read_csv(spark, str(path)).collect()} == {1: '5" pipe', 2: "two\nlines", 3: '6" and 7" pipes', 4: "x"}


def test_documents_come_back_from_many_splits(spark, small_splits):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    folder = new_folder(spark, "csv")
    docs.coalesce(1).write.option("header", True).option("escape", '"').csv(folder)
    small_splits(1 << 16)
    frame = read_csv(spark, folder)
    assert spark.read.text(folder).rdd.getNumPartitions() > 5
    digest = [F.sum(F.crc32(F.trim("text"))), F.count("doc_id"), F.sum("doc_id"), F.sum("n_chars")]
    assert frame.agg(*digest).first() == docs.agg(*digest).first()
