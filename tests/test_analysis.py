"""Cells, claims, run reports, graphs, documents, user code, streams."""

import time
from datetime import datetime, timedelta

import pandas as pd
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gristmill.functions import code
from gristmill.operators import graph, runs
from gristmill.plans import analysis as saved
from gristmill.plans.flow import run_flow
from gristmill.scratch import new_folder
from gristmill.streaming import collect


def test_cells(spark, catalog, store, sales):
    store.append("sales", sales)
    book = saved.Analysis("Sales", {"s": "dataset:sales"})
    cell = saved.run_cell(catalog, book, "SELECT region, sum(amount) AS t FROM s GROUP BY region", "by region", {"type": "bar", "x": "region", "y": "t"})
    assert cell.status == "ok" and cell.row_count == 2 and cell.chart
    broken = saved.run_cell(catalog, book, "SELECT nope FROM s")
    assert broken.status == "error" and "nope" in broken.error
    store.append("sales", spark.createDataFrame([("north", 7)], "region string, amount long"))
    assert saved.rerun_all(catalog, book) == {"ok": 1, "failed": 1}
    assert cell.row_count == 3
    assert saved.materialize_cell(catalog, book, cell, "copy") == 3
    assert "1 of 2 cells ok" in saved.report(book)
    with pytest.raises(ValueError):
        saved.run_cell(catalog, book, "DROP TABLE s")


def test_cell_preview_is_bounded(spark, catalog, store):
    store.append("many", spark.range(1000).toDF("n"))
    cell = saved.run_cell(catalog, saved.Analysis("m", {"m": "many"}), "SELECT * FROM m")
    assert len(cell.rows) == 200 and cell.row_count == 1000


def test_claims(catalog, store, sales):
    store.append("sales", sales)
    claims = [
        ("East revenue is 40", "SELECT sum(amount) FROM data WHERE region = 'east'", 40),
        ("West revenue is 99", "SELECT sum(amount) FROM data WHERE region = 'west'", 99),
        ("Bad", "SELECT broken FROM data", 1),
    ]
    found = rows(saved.verify_claims(catalog, claims, {"data": "dataset:sales"}).drop("note"))
    assert found == [("East revenue is 40", "confirmed", 40.0), ("West revenue is 99", "corrected", 5.0), ("Bad", "unverifiable", None)]


NOW = datetime(2024, 5, 20, 12)


@pytest.fixture
def log(spark):
    start = NOW - timedelta(hours=1)
    node = {"a": ("completed", "x", False, 10.0), "b": ("failed", "y", False, 30.0)}
    data = [
        (1, "w", "success", None, start, start + timedelta(seconds=2), None, node),
        (2, "w", "success", "retry:9", start, start + timedelta(seconds=4), None, node),
        (3, "w", "error", "webhook", start, start - timedelta(seconds=1), "boom", node),
        (4, "v", "running", None, NOW - timedelta(days=40), None, None, {}),
    ]
    schema = (
        "run_id long, workflow string, status string, trigger string, started_at timestamp_ntz, completed_at timestamp_ntz, error string, "
        "node_results map<string, struct<status string, output string, truncated boolean, duration_ms double>>"
    )
    return spark.createDataFrame(data, schema)


def test_run_reports(log):
    totals = runs.runs_totals(log, NOW).first()
    assert (totals["runs"], totals["succeeded"], totals["failed"], totals["other"]) == (3, 2, 1, 0)
    assert totals["success_rate"] == pytest.approx(2 / 3) and totals["median_duration_ms"] == 2000.0
    daily = rows(runs.runs_daily(log, NOW), "date")
    assert len(daily) == 14 and daily[-1][1:] == (2, 1, 0)
    assert rows(runs.runs_by_trigger(log, NOW)) == [("manual", 1), ("retry", 1), ("webhook", 1)]
    assert runs.slowest_nodes(log, NOW).first()["node_id"] == "b"
    assert rows(runs.failure_payload(log)) == [(3, "w", "boom", ["b"])]
    stale = runs.mark_stale_runs(log, NOW).filter("run_id = 4").first()
    assert stale["status"] == "interrupted" and stale["completed_at"] == NOW
    assert runs.resume_set(log).count() == 3
    assert (runs.clamp_days(500), runs.clamp_days(0)) == (90, 1)


def test_empty_log(log):
    empty = log.limit(0)
    assert runs.runs_daily(empty, NOW).count() == 14
    totals = runs.runs_totals(empty, NOW).first()
    assert totals["runs"] == 0 and totals["success_rate"] is None and totals["median_duration_ms"] is None


def test_graph_rules(spark):
    nodes = spark.createDataFrame(
        [
            (1, "t", "trigger"), (1, "a", "agent"), (1, "m", "model"), (1, "m2", "model"), (1, "x", "widget"), (1, "a", "agent"),
            (2, "p", "tool"), (2, "q", "tool"), (3, "f", "flow"), (3, "g", "agent"), (3, "h", "tool"),
        ],
        "graph_id int, node_id string, type string",
    )
    edges = spark.createDataFrame(
        [
            (1, "a", "t", None), (1, "a", "gone", None), (1, "m", "a", "model"), (1, "m2", "a", "model"), (1, "m", "x", None),
            (1, "x", "a", "tools"), (2, "p", "q", None), (2, "q", "p", None), (3, "g", "f", "agents"), (3, "g", "h", None), (3, "h", "f", "what"),
        ],
        "graph_id int, source string, target string, attach string",
    )
    found = set(rows(graph.graph_issues(nodes, edges)))
    assert found == {
        (1, "duplicate_node", "a"), (1, "unknown_type", "x"), (1, "edge_into_trigger", "t"), (1, "missing_node", "gone"),
        (1, "repeated_attachment", "a"), (1, "capability_in_flow", "m"), (1, "attachment_source", "x"), (1, "attached_in_flow", "x"),
        (2, "no_entry_point", None), (3, "unknown_attachment", "f"), (3, "attached_in_flow", "g"), (3, "attached_in_flow", "h"),
    }


def plain_depths(edges):
    """Longest paths by taking nodes away level by level; what stays is on or behind cycles."""
    depth = dict.fromkeys({end for edge in edges for end in edge})
    left, level = set(edges), 0
    nodes = set(depth)
    while ready := {n for n in nodes if not any(target == n for _, target in left)}:
        depth.update(dict.fromkeys(ready, level))
        nodes -= ready
        left = {edge for edge in left if edge[0] not in ready}
        level += 1
    return depth


def test_graph_depth(spark):
    chance = random.Random(4)
    graphs = {
        1: {(1, 2), (2, 3), (1, 3), (3, 4)},
        2: {(1, 2), (2, 3), (3, 2)},
        3: {(1, 1), (1, 2)},
        4: {(i, i + 1) for i in range(120)},
        5: {(i, (i + 1) % 7) for i in range(7)} | {(3, 20), (20, 21), (30, 21), (30, 31)},
        6: {(a, b) for a in range(4) for b in range(4)} | {(3, 9), (9, 10), (10, 11), (40, 41)},
        7: {(2 * i, 2 * i + 2) for i in range(10)} | {(2 * i, 2 * i + 3) for i in range(10)} | {(2 * i + 1, 2 * i + 2) for i in range(10)},
        8: {(i // 2, i) for i in range(2, 60)},
        9: {(0, i) for i in range(1, 200)} | {(i, 500) for i in range(1, 200)},
    }
    for key in range(10, 40):
        n = chance.randint(2, 14)
        pairs = {(chance.randrange(n), chance.randrange(n)) for _ in range(chance.randint(1, 2 * n))}
        graphs[key] = {(a, b) if key % 3 == 0 or a < b else (b, a) for a, b in pairs}
    rows_of = [(g, a, b) for g, edges in graphs.items() for a, b in edges]
    edges = spark.createDataFrame(rows_of + rows_of[:20], "graph_id int, source int, target int")
    wanted = {(g, n): depth for g, pairs in graphs.items() for n, depth in plain_depths(pairs).items()}
    found = graph.graph_depth(edges).select("graph_id", "node_id", "depth").collect()
    assert len(found) == len(wanted) and {(r[0], r[1]): r[2] for r in found} == wanted
    assert graph.graph_depth(edges.limit(0)).count() == 0


def test_iterate_until(spark):
    def halve(df):
        return df.select((F.col("v") / 2).alias("v"))

    df = spark.createDataFrame([(64.0,)], "v double")
    assert graph.iterate_until(df, halve, F.col("v") <= 10).first()["v"] == 8.0
    assert graph.iterate_until(df, halve, None, 2).first()["v"] == 16.0


def test_flow_document(spark):
    df = spark.createDataFrame([(6, ["workflow engine"])], "number int, words array<string>")
    document = {
        "nodes": [
            {"id": "in", "type": "input"},
            {"id": "square", "type": "set_fields", "config": {"fields": {"number": "{{ number }}"}, "include_input": True}},
            {"id": "up", "type": "map", "config": {"column": "words", "expr": "upper(item)"}},
            {"id": "keep", "type": "filter", "config": {"field": "number", "operator": "equals", "value": 6}},
        ],
        "edges": [{"source": "in", "target": "square"}, {"source": "square", "target": "up"}, {"source": "up", "target": "keep"}],
    }
    assert rows(run_flow(document, {"input": df})) == [(6, ["WORKFLOW ENGINE"])]
    document["edges"].append({"source": "keep", "target": "lost"})
    with pytest.raises(ValueError):
        run_flow(document, {"input": df})


def test_code_stage(spark, store):
    df = spark.createDataFrame([(1,), (2,)], "n long")
    doubled = code.code_stage_map(df, lambda f: f.assign(double=f["n"] * 2), "n long, double long")
    assert rows(doubled, "n")[0] == (1, 2)
    good = code.code_stage_outputs(df, lambda d: ({"Doubled Rows": doubled}, {"rows": d.count()}), store)
    assert good.status == "ok" and good.datasets == {"doubled_rows": 2} and good.metrics == {"rows": 2.0}
    bad = code.code_stage_outputs(df, lambda d: 1 / 0, store)
    assert bad.status == "error" and "division" in bad.error


def test_large_groups_are_refused(spark):
    df = spark.range(100).withColumn("k", F.lit("x"))
    run = lambda f: f.head(1)
    with pytest.raises(ValueError):
        code.code_stage_group(df, ["k"], run, "id long, k string", max_rows=50)
    assert code.code_stage_group(df, ["k"], run, "id long, k string", max_rows=500).count() == 1
    state = lambda f: pd.DataFrame({"k": ["x"], "n": [len(f)]})
    assert rows(code.code_stage_aggregate(df, ["k"], state, "k string, n long", {"n": "sum"})) == [("x", 100)]


def test_stream_poll_is_exactly_once(spark, store):
    folder, progress = new_folder(spark, "in"), new_folder(spark, "progress")
    spark.range(10).write.parquet(folder)
    stream = collect.read_stream(spark, folder, "id long")
    collect.poll(stream, store, "out", progress)
    collect.poll(stream, store, "out", progress)
    spark.range(10, 15).write.mode("append").parquet(folder)
    collect.poll(stream, store, "out", progress)
    assert sorted(r["id"] for r in store.read("out").collect()) == list(range(15))


def test_late_rows_are_counted(spark):
    import __spark_entry__ as entry

    found = entry.queries()["stream_late_data"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["dropped_rows"] for r in found) > 0


def test_late_rows_of_all_batches_are_totalled(spark, store):
    folder = new_folder(spark, "late")
    spark.sql("SELECT 1 AS id, timestamp'2024-01-02 00:00:00' AS ts").write.parquet(folder)
    counter = collect.LateRows()
    spark.streams.addListener(counter)
    try:
        stream = collect.read_stream(spark, folder, "id int, ts timestamp", files_per_batch=1)
        daily = collect.tumbling(stream, "ts", "1 hour", "1 minute", [F.count(F.lit(1)).alias("n")])
        progress = new_folder(spark, "progress")
        runs = [collect.poll(daily, store, "late", progress)]
        for _ in range(3):
            spark.sql("SELECT id, timestamp'2024-01-01 00:00:00' AS ts FROM range(5)").write.mode("append").parquet(folder)
            runs.append(collect.poll(daily, store, "late", progress))
        deadline = time.time() + 30
        while len(counter.ended) < 4 and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counter)
    ((rows, dropped),) = counter.totals.values()
    # Rows of one hour are merged before the state drops them.
    assert rows == 16 and dropped >= 3


def test_loop_nodes_repeat_their_body(spark):

    body = {
        "nodes": [{"id": "in", "type": "input"}, {"id": "add", "type": "set_fields", "config": {"fields": {"n": F.col("n") + 1}}}],
        "edges": [{"source": "in", "target": "add"}],
    }

    def looped(**config):
        nodes = [{"id": "in", "type": "input"}, {"id": "l", "type": "loop", "config": {"body": body, **config}}]
        document = {"nodes": nodes, "edges": [{"source": "in", "target": "l"}]}
        return run_flow(document, {"input": spark.createDataFrame([(0,)], "n int")}).first()[0]

    assert looped() == 5 and looped(max_iterations=2) == 2 and looped(condition="n >= 3") == 3


def test_stream_dedup_over_many_copies(spark, store):
    folder = new_folder(spark, "copies")
    rows_in = spark.range(200).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS event_id",
        "timestampadd(MINUTE, cast(id AS int), timestamp_ntz '2024-01-01 00:00:00') AS ts",
    )
    for _ in range(2):
        rows_in.repartition(4).write.mode("append").parquet(folder)
    stream = collect.read_stream(spark, folder, rows_in.schema, files_per_batch=3)
    unique = collect.stream_dedup(stream, ["event_id"], "ts", "1 day")
    collect.poll(unique, store, "out", new_folder(spark, "progress"))
    found = sorted(r["event_id"] for r in store.read("out").collect())
    assert found == sorted({7 if i % 3 == 0 else i for i in range(200)})


def test_collecting_at_an_interval_takes_what_comes(spark, store):
    folder = new_folder(spark, "interval")
    spark.range(5).write.parquet(folder)
    stream = collect.read_stream(spark, folder, "id long")
    running = collect.collect_into(stream, store, "polled", new_folder(spark, "progress"), every="1 second")
    try:
        deadline = time.time() + 60
        while store.read("polled").count() < 5 and time.time() < deadline:
            time.sleep(0.5)
        spark.range(5, 9).write.mode("append").parquet(folder)
        while store.read("polled").count() < 9 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        running.stop()
    assert sorted(r["id"] for r in store.read("polled").collect()) == list(range(9))
