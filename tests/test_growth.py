"""Steps whose time, disk or memory grew faster than their input."""

import csv

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gristmill.llm import lm_score, ngram_join
from gristmill.llm.texts import CLEANUP, near, stored
from gristmill.models import training
from gristmill.sources import records
from gristmill.sources.files import read_csv


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_sketches_apart_from_exact_counts(spark, tmp_path):
    found = [(i, i % 7, f) for f in ("A", None) for i in range(40)]
    lines = spark.createDataFrame(found, "l_orderkey long, l_partkey long, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    counted = entry.queries()["count_distinct_approx_error"](spark, str(tmp_path))
    # One sketch per distinct value has grouped by the number of the distinct set.
    assert not [line for line in plan_of(counted).splitlines() if "approx_count_distinct" in line and "gid" in line]
    assert sorted(counted.collect(), key=str) == [("A", 7, 40, True, True), (None, 7, 40, True, True)]


def test_forest_levels(spark, monkeypatch):
    assert all(training._estimator(f"random_forest_{k}", 9).getCacheNodeIds() for k in ("regression", "classification"))
    monkeypatch.setattr(training, "SMALL_ROWS", 10)
    cores = spark.sparkContext.defaultParallelism
    assert training._spread(spark.range(100).coalesce(1)).rdd.getNumPartitions() == cores
    assert training._spread(spark.range(100).repartition(cores + 1)).rdd.getNumPartitions() == cores + 1


def test_csv_records_over_chunks_of_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 4)
    monkeypatch.setattr(records, "TASK", 64)
    cells = [["k", "a\nb"], *[[str(i), "x\n" * (i % 7) + 'say "y"'] for i in range(40)], ["40", "l\n" * 30 + "l"], ["41", "z"]]
    path = f"{tmp_path}/cells.csv"
    with open(path, "w", encoding="utf-8", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows(cells)
    starts = records._starts(records._steps(records._lines(spark, path))).collect()
    lines = sum(1 for _ in open(path))
    assert len(starts) >= lines // 4 and {row["begin"] for row in starts} == {0}
    frame = read_csv(spark, path, typed=False)
    assert frame.columns == cells[0]
    assert sorted(map(list, frame.collect())) == sorted(cells[1:])


def test_marks_come_without_a_shuffle_of_most_texts(spark):
    ids = [*range(-3, 60), 7, 7, None, None, 1 << 62]
    docs = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    marked = spark.createDataFrame([(i,) for i in (-3, 7, 7, 20, 1 << 62, 999, None)], "doc_id long")
    found = lm_score.marked_rows(docs, marked)
    wanted = [(i, f"t{i}", 1 if i in (-3, 7, 20, 1 << 62) else None) for i in ids]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(wanted, key=str)
    # Rows that no bitmap tells stay in the partitions they are read in.
    assert "Union" in plan_of(found)


def test_shuffles_of_stored_tables_go(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in files.mkString("\n").split("\n") if "shuffle_" in name}

    before, asked = shuffled(), spark.conf.get(CLEANUP, None)
    counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    table = stored(counted, "counted", compression="zstd")
    assert not shuffled() - before
    assert sorted(map(tuple, table.collect())) == [(k, 143 if k < 6 else 142) for k in range(7)]
    # The setting is the session's again.
    assert spark.conf.get(CLEANUP, None) == asked


def test_prefix_listings_are_sent_once(spark):
    prints = spark.createDataFrame(
        [(1, [1], [[5, 6]]), (2, [1], [[6, 7]]), (2, [1], [[6, 7]]), (3, [1], [[8]]), (4, [2], [[5, 9]])],
        "node long, classes array<int>, keys array<array<long>>",
    )
    nodes = spark.createDataFrame([(1, 1), (2, 2), (3, 1), (4, 1)], "node long, copies long")
    assert sorted(r.node for r in ngram_join._prefix_suspects(prints, nodes).collect()) == [1, 2]


def test_few_rows_are_sent_to_few_keys(spark):
    ids = [*range(500), 7, None]
    rows = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, text string")
    wanted = spark.createDataFrame([(7,), (7,), (20,), (None,), (999,)], "id long")
    marked = near(rows, F.xxhash64("id"), wanted.select(F.xxhash64("id")))
    assert marked.columns == ["id", "text", "_near"]
    found = [r.id for r in marked.where("_near").collect()]
    assert {7, 20, None} <= set(found) and found.count(7) == 2 and len(found) < 10
    assert sorted(r.text for r in marked.collect()) == sorted(f"t{i}" for i in ids)
    assert not near(rows, F.xxhash64("id"), wanted.limit(0).select(F.xxhash64("id"))).where("_near or _near is null").count()


def test_few_pairs_are_compared_and_sent(spark):
    rng = np.random.default_rng(3)
    bases = [np.unique(rng.integers(0, 1 << 63, 300, np.uint64)) for _ in range(40)]
    sets = [np.sort(np.append(b[k:], bases[-1 - i][:k])) for i, b in enumerate(bases) for k in (0, 10, 45)]
    sets += [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 9000)]
    held = [set(s.tolist()) for s in sets]
    parts = [(i, 0, s.astype(np.int64).tolist(), ngram_join._bitmap(s).tolist()) for i, s in enumerate(sets)]
    parts += [(0, *parts[0][1:]), (121, 1, [5], None)]  # a repeated row, and a set of two parts
    frame = stored(spark.createDataFrame(parts, "node long, part int, grams array<long>, bits array<long>"), "parts")
    pairs = [(a, b, len(held[a]), len(held[b])) for a in range(len(sets)) for b in range(a + 1, len(sets)) if (a + b) % 5 < 3]
    linked = {(a, b) for a, b, na, nb in pairs if 100 * len(held[a] & held[b]) >= 80 * len(held[a] | held[b])}
    rule = ngram_join.Rule(5, 80)
    asked = spark.createDataFrame(pairs, "a long, b long, na long, nb long")
    likely = stored(ngram_join._likely(asked, ngram_join._bitmaps(frame), rule), "pairs")
    told = {(r.a, r.b) for r in likely.collect()}
    assert linked and linked <= told and len(told) < len(pairs) / 20
    assert {tuple(r) for r in ngram_join._linked(likely, frame, rule).collect()} == linked
    # Parts of sets in no pair are dropped before they are shuffled.
    one = ngram_join._linked(likely.limit(1), frame, rule)
    assert plan_of(one).count("getbit") >= 2
