"""Saved queries, claims, run-log reports, graphs, node documents, user code."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import code
from gristmill.operators import graph, merge, ordered, runs
from gristmill.plans import analysis as saved
from gristmill.plans.flow import run_flow
from gristmill.scratch import new_folder
from gristmill.sources.catalog import Catalog
from gristmill.sources.datasets import DatasetStore
from gristmill.suite.registry import Tables, query, r, ts_text

NOW = datetime(2024, 1, 31)

# ---- run log, derived from events

RUN_LOG = """SELECT event_id AS run_id, event_type AS workflow,
    CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'running' WHEN 3 THEN 'queued' ELSE 'success' END AS status,
    CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'retry:ab12' WHEN 2 THEN 'rerun:cd34' WHEN 3 THEN 'error:ef56' WHEN 4 THEN 'webhook' ELSE 'schedule' END AS trigger,
    ts AS started_at, CASE WHEN event_id % 10 IN (2, 3) THEN NULL ELSE ts + to_milliseconds(CAST(round(value) AS BIGINT)) END AS completed_at, value
    FROM events"""
SPAN = "started_at >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL {} DAY"
MILLIS = "CASE WHEN completed_at IS NOT NULL THEN greatest(epoch_us(completed_at) - epoch_us(started_at), 0) / 1000.0 END"
KIND = "CASE WHEN trigger IS NULL THEN 'manual' ELSE regexp_replace(trigger, '^(retry|rerun|error):.*$', '\\1') END"
OK_COUNT = "CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS succeeded"
BAD_COUNT = "CAST(count(*) FILTER (WHERE status IN ('error', 'interrupted')) AS BIGINT) AS failed"


def run_log(t: Tables) -> DataFrame:
    """Events read as a run log, with two node results per run."""
    base = t.events.selectExpr(
        "event_id AS run_id",
        "event_type AS workflow",
        "CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'running' WHEN 3 THEN 'queued' ELSE 'success' END AS status",
        "CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'retry:ab12' WHEN 2 THEN 'rerun:cd34' WHEN 3 THEN 'error:ef56' WHEN 4 THEN 'webhook' ELSE 'schedule' END AS trigger",
        "ts AS started_at",
        "CASE WHEN event_id % 10 IN (2, 3) THEN NULL ELSE timestampadd(MILLISECOND, cast(round(value) AS int), ts) END AS completed_at",
        "cast(NULL AS string) AS error",
        "value",
    )
    extract = F.struct(
        F.lit("completed").alias("status"),
        F.concat(F.lit("rows "), F.col("run_id").cast("string")).alias("output"),
        (F.col("run_id") % 9 == 0).alias("truncated"),
        (F.col("value") * 0.4).alias("duration_ms"),
    )
    load = F.struct(
        F.when(F.col("status") == "error", "failed")
        .when(F.col("status") == "success", "completed")
        .otherwise("pending")
        .alias("status"),
        F.lit("loaded").alias("output"),
        F.lit(False).alias("truncated"),
        (F.col("value") * 0.6).alias("duration_ms"),
    )
    results = F.create_map(F.lit("extract"), extract, F.lit("load"), load)
    return base.withColumn("node_results", results)


@query(
    "runs_totals",
    f"""SELECT CAST(count(*) AS BIGINT) AS runs, {OK_COUNT}, {BAD_COUNT},
        CAST(count(*) FILTER (WHERE status NOT IN ('success', 'error', 'interrupted')) AS BIGINT) AS other,
        round(count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate, round(median({MILLIS}), 4) AS median_duration_ms
    FROM ({RUN_LOG}) WHERE {SPAN.format(14)}""",
)
def _(t: Tables):
    totals = runs.runs_totals(run_log(t), NOW, 14)
    return totals.withColumns({"success_rate": r("success_rate", 6), "median_duration_ms": r("median_duration_ms")})


@query(
    "runs_daily",
    f"""WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-31' - 44, DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day),
    c AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS n, {OK_COUNT}, {BAD_COUNT} FROM ({RUN_LOG}) WHERE {SPAN.format(45)} GROUP BY 1)
    SELECT strftime(d.day, '%Y-%m-%d') AS date, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed,
        CAST(coalesce(n - succeeded - failed, 0) AS BIGINT) AS other FROM d LEFT JOIN c ON c.day = d.day""",
)
def _(t: Tables):
    return runs.runs_daily(run_log(t), NOW, 45).withColumn("date", F.col("date").cast("string"))


@query(
    "runs_by_workflow",
    f"""SELECT workflow AS name, CAST(count(*) AS BIGINT) AS runs, {OK_COUNT}, {BAD_COUNT},
        round(count(*) FILTER (WHERE status = 'success') / count(*), 6) AS success_rate, round(avg({MILLIS}), 3) AS avg_duration_ms,
        strftime(max(started_at), '%Y-%m-%d %H:%M:%S.%f') AS last_run_at
    FROM ({RUN_LOG}) WHERE {SPAN.format(14)} GROUP BY workflow""",
)
def _(t: Tables):
    grouped = runs.runs_by_workflow(run_log(t), NOW, 14)
    return grouped.withColumns(
        {
            "success_rate": r("success_rate", 6),
            "avg_duration_ms": r("avg_duration_ms", 3),
            "last_run_at": ts_text("last_run_at"),
        }
    )


@query(
    "runs_by_trigger",
    f"SELECT {KIND} AS trigger, CAST(count(*) AS BIGINT) AS runs FROM ({RUN_LOG}) WHERE {SPAN.format(500)} GROUP BY 1",
)
def _(t: Tables):
    return runs.runs_by_trigger(run_log(t), NOW, 500)


@query(
    "slowest_nodes",
    f"""SELECT workflow, node_id, round(avg(ms), 4) AS avg_duration_ms, CAST(count(*) AS BIGINT) AS runs FROM (
        SELECT workflow, 'extract' AS node_id, value * 0.4 AS ms FROM ({RUN_LOG}) WHERE {SPAN.format(90)}
        UNION ALL SELECT workflow, 'load', value * 0.6 FROM ({RUN_LOG}) WHERE {SPAN.format(90)})
    GROUP BY workflow, node_id ORDER BY avg(ms) DESC, workflow, node_id LIMIT 10""",
)
def _(t: Tables):
    slow = runs.slowest_nodes(run_log(t), NOW, 90)
    return slow.withColumn("avg_duration_ms", r("avg_duration_ms"))


@query(
    "runs_recent",
    f"""SELECT run_id, workflow, status, {KIND} AS trigger, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
        round({MILLIS}, 3) AS duration_ms FROM ({RUN_LOG}) WHERE {SPAN.format(14)} ORDER BY started_at DESC, run_id DESC LIMIT 12""",
)
def _(t: Tables):
    newest = runs.runs_recent(run_log(t), NOW)
    return newest.withColumns({"started_at": ts_text("started_at"), "duration_ms": r("duration_ms", 3)})


@query(
    "mark_stale_runs",
    f"""SELECT run_id, CASE WHEN status IN ('queued', 'running') THEN 'interrupted' ELSE status END AS status,
        CASE WHEN status IN ('queued', 'running') THEN '{runs.STALE_ERROR}' END AS error,
        strftime(CASE WHEN status IN ('queued', 'running') THEN TIMESTAMP '2024-01-31 00:00:00' ELSE completed_at END, '%Y-%m-%d %H:%M:%S.%f') AS completed_at
    FROM ({RUN_LOG})""",
)
def _(t: Tables):
    marked = runs.mark_stale_runs(run_log(t), NOW)
    return marked.select("run_id", "status", "error", ts_text("completed_at").alias("completed_at"))


@query(
    "resume_set",
    f"""SELECT run_id, 'extract' AS node_id, 'rows ' || run_id AS output FROM ({RUN_LOG}) WHERE run_id % 9 <> 0
    UNION ALL SELECT run_id, 'load', 'loaded' FROM ({RUN_LOG}) WHERE status = 'success'""",
)
def _(t: Tables):
    return runs.resume_set(run_log(t))


@query(
    "nodes_to_do",
    f"""SELECT run_id, 'extract' AS node_id FROM ({RUN_LOG}) WHERE run_id % 9 = 0
    UNION ALL SELECT run_id, 'load' FROM ({RUN_LOG}) WHERE status <> 'success'
    UNION ALL SELECT run_id, 'notify' FROM ({RUN_LOG})""",
)
def _(t: Tables):
    log = run_log(t)
    steps = F.explode(F.array(F.lit("extract"), F.lit("load"), F.lit("notify")))
    plan = log.select("workflow").distinct().select("workflow", steps.alias("node_id"))
    return runs.nodes_to_do(log, plan)


@query(
    "latest_run_context",
    f"""SELECT workflow, run_id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at, 'rows ' || run_id AS extract_output, CAST(2 AS BIGINT) AS nodes
    FROM ({RUN_LOG}) QUALIFY row_number() OVER (PARTITION BY workflow ORDER BY started_at DESC, run_id DESC) = 1""",
)
def _(t: Tables):
    newest = runs.latest_run_context(run_log(t))
    return newest.select(
        "workflow",
        "run_id",
        ts_text("started_at").alias("started_at"),
        F.col("node_results")["extract"]["output"].alias("extract_output"),
        F.size(F.map_keys("node_results")).cast("long").alias("nodes"),
    )


@query(
    "failure_payload",
    f"SELECT run_id, workflow, 'unknown error' AS error, 'load' AS failed_nodes FROM ({RUN_LOG}) WHERE status = 'error'",
)
def _(t: Tables):
    payload = runs.failure_payload(run_log(t))
    return payload.withColumn("failed_nodes", F.concat_ws(",", "failed_nodes"))


# ---- graphs, derived from part

PART_TYPES = """CASE WHEN p_partkey % 20 = 0 THEN 'trigger' WHEN p_partkey % 53 = 0 THEN 'mystery' WHEN p_partkey % 31 = 0 THEN 'model'
        WHEN p_partkey % 13 = 0 THEN 'memory' WHEN p_partkey % 11 = 0 THEN 'flow' WHEN p_partkey % 7 = 0 THEN 'agent' ELSE 'tool' END"""
GRAPH_NODES = f"SELECT p_partkey // 20 AS graph_id, p_partkey AS node_id, {PART_TYPES} AS type FROM part"
GRAPH_STEPS = """SELECT p_partkey // 20 AS graph_id, p_partkey AS source, p_partkey + 1 AS target FROM part WHERE p_partkey % 20 <> 19 AND (SELECT max(p_partkey) FROM part) > p_partkey
    UNION ALL SELECT p_partkey // 20, p_partkey, p_partkey + 3 FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 20 <= 16 AND (SELECT max(p_partkey) FROM part) >= p_partkey + 3
    UNION ALL SELECT p_partkey // 20, p_partkey, p_partkey + 100000000 FROM part WHERE p_partkey % 97 = 0
    UNION ALL SELECT p_partkey // 20, p_partkey, p_partkey - p_partkey % 20 FROM part WHERE p_partkey % 89 = 0
    UNION ALL SELECT p_partkey // 20, p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 67 = 0 AND p_partkey % 20 >= 3"""
# (which parts, source, target, kind), each an offset from the part.
ATTACHED = [
    ("p_partkey % 31 = 0", 0, 1, "model"),
    ("p_partkey % 13 = 0", 0, 1, "memory"),
    ("p_partkey % 7 = 0 AND p_partkey % 20 <> 0", -1, 0, "tools"),
    ("p_partkey % 21 = 0 AND p_partkey % 20 >= 2", -2, 0, "model"),
    ("p_partkey % 17 = 0", 0, 1, "gadget"),
    ("p_partkey % 11 = 0 AND p_partkey % 20 <> 0", -1, 0, "agents"),
    ("p_partkey % 11 = 0 AND p_partkey % 20 < 13", 7, 0, "agents"),
    ("p_partkey % 14 = 0 AND p_partkey % 20 <= 17", 1, 0, "memory"),
    ("p_partkey % 14 = 0 AND p_partkey % 20 <= 17", 2, 0, "memory"),
    # An end of the line that takes part in no step but this attachment.
    ("p_partkey % 60 = 41", 200000000, 0, "tools"),
]
GRAPH_ATTACHED = " UNION ALL ".join(
    f"SELECT p_partkey // 20 AS graph_id, p_partkey + {source} AS source, p_partkey + {target} AS target, '{kind}' AS attach FROM part WHERE {which}"
    for which, source, target, kind in ATTACHED
)


def graph_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Chains of 20 parts with shortcuts, wrong types, lost ends, duplicates, edges back to
    the start or to a part in between, and attachments, fitting and not."""
    nodes = t.part.selectExpr(
        "p_partkey div 20 AS graph_id",
        "p_partkey AS node_id",
        f"{PART_TYPES} AS type",
        "explode(CASE WHEN p_partkey % 101 = 0 THEN array(1, 2) ELSE array(1) END) AS copy",
    ).drop("copy")
    parts = t.part.select("p_partkey", t.part.agg(F.max("p_partkey")).scalar().alias("last"))
    key, last = F.col("p_partkey"), F.col("last")
    place = key % 20

    def end(test: Column, target: Column, source: Column = key, attach: str | None = None) -> Column:
        return F.when(test, F.struct(source.alias("source"), target.alias("target"), F.lit(attach).cast("string").alias("attach")))

    ends = F.array(
        end((place != 19) & (key < last), key + 1),
        end((key % 4 == 0) & (place <= 16) & (key + 3 <= last), key + 3),
        end(key % 97 == 0, key + 100_000_000),
        end(key % 89 == 0, key - place),
        end((key % 67 == 0) & (place >= 3), key - 3),
        *[end(F.expr(which), key + target, key + source, kind) for which, source, target, kind in ATTACHED],
    )
    listed = parts.select(F.floor(key / 20).alias("graph_id"), F.explode(ends).alias("e"))
    return nodes, listed.where("e IS NOT NULL").select("graph_id", "e.*")


@query(
    "graph_issues",
    f"""WITH once AS ({GRAPH_NODES}), dup AS (SELECT * FROM once WHERE node_id % 101 = 0), n AS (SELECT * FROM once UNION ALL SELECT * FROM dup),
    e AS (SELECT *, NULL AS attach FROM ({GRAPH_STEPS}) UNION ALL {GRAPH_ATTACHED}),
    typed AS (SELECT e.*, s.type AS st, d.type AS dt, coalesce(attach IN ('model', 'memory', 'tools', 'agents'), false) AS known,
        CASE WHEN attach = 'agents' THEN 'flow' ELSE 'agent' END AS wanted,
        coalesce((attach = 'model' AND s.type = 'model') OR (attach = 'memory' AND s.type = 'memory')
            OR (attach = 'tools' AND s.type IN ('tool', 'mcp')) OR (attach = 'agents' AND s.type = 'agent'), false) AS fits
        FROM e LEFT JOIN once s ON s.graph_id = e.graph_id AND s.node_id = e.source
        LEFT JOIN once d ON d.graph_id = e.graph_id AND d.node_id = e.target),
    flow AS (SELECT * FROM once o WHERE type NOT IN ('model', 'memory')
        AND NOT EXISTS (SELECT 1 FROM e WHERE attach IS NOT NULL AND e.graph_id = o.graph_id AND e.source = o.node_id))
    SELECT graph_id, 'duplicate_node' AS issue, CAST(node_id AS VARCHAR) AS node_id FROM dup
    UNION ALL SELECT graph_id, 'unknown_type', CAST(node_id AS VARCHAR) FROM n WHERE type = 'mystery'
    UNION ALL SELECT graph_id, 'missing_node', CAST(source AS VARCHAR) FROM typed WHERE st IS NULL
    UNION ALL SELECT graph_id, 'missing_node', CAST(target AS VARCHAR) FROM typed WHERE dt IS NULL
    UNION ALL SELECT graph_id, 'edge_into_trigger', CAST(target AS VARCHAR) FROM typed WHERE attach IS NULL AND dt = 'trigger'
    UNION ALL SELECT graph_id, 'unknown_attachment', CAST(target AS VARCHAR) FROM typed WHERE attach IS NOT NULL AND NOT known
    UNION ALL SELECT graph_id, 'attachment_target', CAST(target AS VARCHAR) FROM typed WHERE known AND coalesce(dt, '') <> wanted
    UNION ALL SELECT graph_id, 'attachment_source', CAST(source AS VARCHAR) FROM typed WHERE known AND NOT fits
    UNION ALL SELECT graph_id, 'capability_in_flow', CAST(source AS VARCHAR) FROM typed WHERE attach IS NULL AND st IN ('model', 'memory')
    UNION ALL SELECT graph_id, 'capability_in_flow', CAST(target AS VARCHAR) FROM typed WHERE attach IS NULL AND dt IN ('model', 'memory')
    UNION ALL SELECT graph_id, 'repeated_attachment', CAST(target AS VARCHAR) FROM e WHERE attach IN ('model', 'memory')
        GROUP BY graph_id, target, attach HAVING count(*) > 1
    UNION ALL SELECT graph_id, 'attached_in_flow', CAST(node_id AS VARCHAR) FROM once o WHERE type NOT IN ('model', 'memory')
        AND EXISTS (SELECT 1 FROM e WHERE attach IS NOT NULL AND e.graph_id = o.graph_id AND e.source = o.node_id)
        AND EXISTS (SELECT 1 FROM e WHERE attach IS NULL AND e.graph_id = o.graph_id AND (e.source = o.node_id OR e.target = o.node_id))
    UNION ALL SELECT graph_id, 'no_entry_point', NULL FROM flow GROUP BY graph_id
        HAVING NOT bool_or(NOT EXISTS (SELECT 1 FROM e WHERE attach IS NULL AND e.graph_id = flow.graph_id AND e.target = flow.node_id))""",
)
def _(t: Tables):
    nodes, edges = graph_tables(t)
    return graph.graph_issues(nodes, edges)


@query(
    "graph_depth",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT * FROM ({GRAPH_STEPS})),
    names AS (SELECT graph_id, source AS node_id FROM e UNION SELECT graph_id, target FROM e),
    reach(graph_id, node_id, later) AS (
        SELECT graph_id, source, target FROM e
        UNION SELECT reach.graph_id, reach.node_id, e.target FROM reach JOIN e ON e.graph_id = reach.graph_id AND e.source = reach.later),
    circle AS (SELECT graph_id, node_id FROM reach WHERE node_id = later),
    never AS (SELECT graph_id, node_id FROM circle UNION SELECT graph_id, later FROM reach JOIN circle USING (graph_id, node_id)),
    walk(graph_id, node_id, depth) AS (
        SELECT graph_id, node_id, 0 FROM names WHERE (graph_id, node_id) NOT IN (SELECT (graph_id, target) FROM e)
        UNION SELECT e.graph_id, e.target, depth + 1 FROM walk JOIN e ON e.graph_id = walk.graph_id AND e.source = walk.node_id
        WHERE (e.graph_id, e.target) NOT IN (SELECT (graph_id, node_id) FROM never))
    SELECT graph_id, node_id, CAST(max(depth) AS INTEGER) AS depth FROM names LEFT JOIN walk USING (graph_id, node_id) GROUP BY graph_id, node_id""",
)
def _(t: Tables):
    # Attachments are no steps.
    _, edges = graph_tables(t)
    return graph.graph_depth(edges.where("attach IS NULL"))


@query(
    "iterate_until",
    """SELECT o_orderkey, round(o_totalprice / power(2, n), 6) AS price, CAST(n AS INTEGER) AS rounds FROM (
        SELECT o_orderkey, o_totalprice, least(CASE WHEN o_totalprice <= 20000 THEN 0 ELSE ceil(log2(o_totalprice / 20000)) END, 6) AS n FROM orders)""",
)
def _(t: Tables):
    start = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"), F.lit(0).alias("rounds"))
    high = F.col("price") > 20000

    def halve(df: DataFrame) -> DataFrame:
        return df.select(
            "o_orderkey",
            F.when(high, F.col("price") / 2).otherwise(F.col("price")).alias("price"),
            F.when(high, F.col("rounds") + 1).otherwise(F.col("rounds")).alias("rounds"),
        )

    return graph.iterate_until(start, halve, ~high, 6).withColumn("price", r("price", 6))


@query(
    "flow_loop",
    """SELECT o_orderkey, round(o_totalprice / power(2, n), 6) AS price FROM (
        SELECT o_orderkey, o_totalprice, least(CASE WHEN o_totalprice <= 20000 THEN 0 ELSE ceil(log2(o_totalprice / 20000)) END, 6) AS n FROM orders)""",
)
def _(t: Tables):
    body = {
        "nodes": [
            {"id": "in", "type": "input"},
            {
                "id": "halve",
                "type": "set_fields",
                "config": {
                    "fields": {
                        "o_orderkey": F.col("o_orderkey"),
                        "price": F.when(F.col("price") > 20000, F.col("price") / 2).otherwise(F.col("price")),
                    }
                },
            },
        ],
        "edges": [{"source": "in", "target": "halve"}],
    }
    loop = {"body": body, "condition": "price <= 20000", "max_iterations": 6}
    document = {
        "nodes": [{"id": "in", "type": "input"}, {"id": "again", "type": "loop", "config": loop}],
        "edges": [{"source": "in", "target": "again"}],
    }
    orders = t.orders.select("o_orderkey", F.col("o_totalprice").alias("price"))
    return run_flow(document, {"input": orders}).withColumn("price", r("price", 6))


@query(
    "restore_version",
    """WITH h AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version,
                         o_totalprice AS price FROM orders)
    SELECT o_custkey, CAST(version AS BIGINT) AS version, price FROM h
    UNION ALL SELECT o_custkey, CAST((SELECT max(version) FROM h m WHERE m.o_custkey = h.o_custkey) + 1 AS BIGINT), price
    FROM h WHERE version = 1 AND o_custkey % 10 = 0""",
)
def _(t: Tables):
    numbered = ordered.sequence(
        t.orders, ["o_custkey"], [("o_orderdate", "asc"), ("o_orderkey", "asc")], {"version": ("row_number",)}
    )
    history = numbered.select("o_custkey", F.col("version").cast("long").alias("version"), F.col("o_totalprice").alias("price"))
    wanted = history.filter("version = 1 AND o_custkey % 10 = 0").select("o_custkey", "version")
    return merge.restore_version(history, ["o_custkey"], "version", wanted)


# ---- saved queries and claims


def _catalog(t: Tables) -> Catalog:
    catalog = Catalog(t.spark, DatasetStore(t.spark, new_folder(t.spark, "analysis")))
    for name in ("orders", "customer", "nation"):
        catalog.register(name, "file", {"path": t.path(name)})
    return catalog


CELL = """SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue FROM o
    JOIN c ON o.o_custkey = c.c_custkey JOIN n ON c.c_nationkey = n.n_nationkey GROUP BY n_name"""
CELL_SQL = """SELECT n_name, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS revenue FROM orders
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"""


@query("run_cell", f"SELECT *, CAST(25 AS BIGINT) AS row_count, 'ok' AS status FROM ({CELL_SQL})")
def _(t: Tables):
    book = saved.Analysis("Revenue", {"o": "orders", "c": "customer", "n": "nation"})
    cell = saved.run_cell(_catalog(t), book, CELL)
    shown = t.spark.createDataFrame(
        [(row["n_name"], row["orders"], row["revenue"]) for row in cell.rows],
        "n_name string, orders long, revenue double",
    )
    return shown.withColumns({"row_count": F.lit(cell.row_count).cast("long"), "status": F.lit(cell.status)})


@query(
    "rerun_cell",
    """SELECT 1 AS run, CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 2, CAST(count(*) AS BIGINT), round(sum(o_totalprice), 2) FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def _(t: Tables):
    catalog = _catalog(t)
    columns = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    catalog.store.append("sales", columns.filter(F.col("o_orderstatus") == "F"))
    book = saved.Analysis("Sales", {"s": "dataset:sales"})
    cell = saved.run_cell(catalog, book, "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM s")
    first = cell.rows[0]
    catalog.store.append("sales", columns.filter(F.col("o_orderstatus") == "O"))
    saved.rerun_all(catalog, book)
    second = cell.rows[0]
    found = [(1, first["n"], first["total"]), (2, second["n"], second["total"])]
    return t.spark.createDataFrame(found, "run int, rows long, total double")


@query(
    "rerun_all",
    """SELECT 'totals' AS title, 'ok' AS status, CAST(1 AS BIGINT) AS row_count UNION ALL SELECT 'broken', 'error', 0
    UNION ALL SELECT 'priorities', 'ok', CAST(count(DISTINCT o_orderpriority) AS BIGINT) FROM orders""",
)
def _(t: Tables):
    book = saved.Analysis("All", {"o": "orders"})
    book.cells = [
        saved.Cell("SELECT count(*) AS n, sum(o_totalprice) AS total FROM o", "totals"),
        saved.Cell("SELECT nothing FROM o", "broken"),
        saved.Cell("SELECT DISTINCT o_orderpriority FROM o", "priorities"),
    ]
    saved.rerun_all(_catalog(t), book)
    found = [(c.title, c.status, c.row_count) for c in book.cells]
    return t.spark.createDataFrame(found, "title string, status string, row_count long")


@query(
    "materialize_cell",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY o_custkey",
)
def _(t: Tables):
    catalog = _catalog(t)
    book = saved.Analysis("Customers", {"o": "orders"})
    cell = saved.Cell("SELECT o_custkey, round(sum(o_totalprice), 2) AS revenue FROM o GROUP BY o_custkey")
    saved.materialize_cell(catalog, book, cell, "revenue")
    return catalog.load("dataset:revenue").select("o_custkey", "revenue")


@query(
    "verify_claims",
    """SELECT 'orders' AS claim, 'confirmed' AS verdict, CAST(count(*) AS DOUBLE) AS actual FROM orders
    UNION ALL SELECT 'largest', 'corrected', CAST(max(o_totalprice) AS DOUBLE) FROM orders
    UNION ALL SELECT 'broken', 'unverifiable', NULL""",
)
def _(t: Tables):
    rows = t.orders.count()
    claims = [
        ("orders", "SELECT count(*) FROM data", float(rows)),
        ("largest", "SELECT max(o_totalprice) FROM data", -1.0),
        ("broken", "SELECT sum(missing_column) FROM data", 1.0),
    ]
    checked = saved.verify_claims(_catalog(t), claims, {"data": "orders"})
    return checked.drop("note")


CLAIMED = """SELECT c_custkey AS o_custkey, CASE WHEN c_custkey % 2 = 0 THEN 0.0 ELSE coalesce(s, 1.0) END AS expected
    FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1) ON o_custkey = c_custkey"""


@query(
    "verify_metrics",
    f"""SELECT o_custkey, CASE WHEN actual IS NULL THEN 'unverifiable' WHEN abs(actual - expected) <= greatest(1e-6, abs(expected) * 1e-6) THEN 'confirmed' ELSE 'corrected' END AS verdict,
        round(actual, 2) AS actual FROM ({CLAIMED}) LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS actual FROM orders GROUP BY 1) USING (o_custkey)""",
)
def _(t: Tables):
    sums = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    people = t.customer.select(F.col("c_custkey").alias("o_custkey")).join(sums, ["o_custkey"], "left")
    wrong = F.col("o_custkey") % 2 == 0
    claims = people.select(
        "o_custkey", F.when(wrong, 0.0).otherwise(F.coalesce("s", F.lit(1.0))).alias("expected")
    )
    checked = saved.verify_metrics(t.orders, claims, "o_custkey", "o_totalprice", "expected")
    return checked.select("o_custkey", "verdict", r("actual", 2).alias("actual"))


# ---- node documents

DOCUMENT = {
    "nodes": [
        {"id": "in", "type": "input", "config": {"name": "orders"}},
        {"id": "people", "type": "input", "config": {"name": "customers"}},
        {"id": "large", "type": "filter", "config": {"field": "price", "operator": "greater_than", "value": "100000"}},
        {"id": "split", "type": "route", "config": {"branches": {"urgent": "priority = '1-URGENT'"}}},
        {"id": "fast", "type": "set_fields", "config": {"fields": {"lane": "fast"}, "include_input": True}},
        {"id": "slow", "type": "set_fields", "config": {"fields": {"lane": "slow"}, "include_input": True}},
        {"id": "all", "type": "union"},
        {"id": "when", "type": "datetime", "config": {"operation": "format", "value": "placed", "format": "us", "output": "day"}},
        {"id": "who", "type": "join", "config": {"on": ["customer"]}},
        {"id": "label", "type": "subworkflow", "config": {"workflow_id": "label"}},
        {"id": "out", "type": "output"},
    ],
    "edges": [
        {"source": "in", "target": "large"},
        {"source": "large", "target": "split"},
        {"source": "split", "target": "fast", "branch": "urgent"},
        {"source": "split", "target": "slow", "branch": "else"},
        {"source": "fast", "target": "all"},
        {"source": "slow", "target": "all"},
        {"source": "all", "target": "when"},
        {"source": "when", "target": "who"},
        {"source": "people", "target": "who"},
        {"source": "who", "target": "label"},
        {"source": "label", "target": "out"},
    ],
}
LABEL = {
    "nodes": [
        {"id": "in", "type": "input"},
        {
            "id": "text",
            "type": "set_fields",
            "config": {"fields": {"id": "{{ id }}", "lane": "{{ lane }}", "title": "{{ name }} on {{ day }}"}},
        },
    ],
    "edges": [{"source": "in", "target": "text"}],
}


@query(
    "node_flow",
    """SELECT o_orderkey AS id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'fast' ELSE 'slow' END AS lane,
        c_name || ' on ' || strftime(o_orderdate, '%m/%d/%Y') AS title
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000""",
)
def _(t: Tables):
    orders = t.orders.selectExpr(
        "o_orderkey AS id", "o_custkey AS customer", "o_totalprice AS price", "o_orderpriority AS priority", "o_orderdate AS placed"
    )
    people = t.customer.selectExpr("c_custkey AS customer", "c_name AS name")
    return run_flow(DOCUMENT, {"orders": orders, "customers": people}, {"label": LABEL})


# ---- user code


@query("udf_scalar", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def _(t: Tables):
    @F.pandas_udf("double")
    def twice(value: pd.Series) -> pd.Series:
        return value * 2

    return t.orders.select("o_orderkey", twice("o_totalprice").alias("doubled"))


@query(
    "code_stage_map",
    "SELECT l_orderkey, l_linenumber, l_extendedprice * 2 AS double FROM lineitem WHERE l_quantity >= 25",
)
def _(t: Tables):
    def stage(frame: pd.DataFrame) -> pd.DataFrame:
        kept = frame[frame["l_quantity"] >= 25]
        return kept[["l_orderkey", "l_linenumber"]].assign(double=kept["l_extendedprice"] * 2)

    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return code.code_stage_map(lines, stage, "l_orderkey long, l_linenumber int, double double")


@query(
    "code_stage_group",
    """WITH h AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2),
    p AS (SELECT l_returnflag, n, n / sum(n) OVER (PARTITION BY l_returnflag) AS p FROM h)
    SELECT l_returnflag, round(-sum(p * ln(p)), 6) AS entropy, CAST(sum(n) AS BIGINT) AS rows FROM p GROUP BY l_returnflag""",
)
def _(t: Tables):
    def stage(frame: pd.DataFrame) -> pd.DataFrame:
        share = frame["n"] / frame["n"].sum()
        entropy = round(float(-(share * np.log(share)).sum()), 6)
        return pd.DataFrame(
            {"l_returnflag": [frame["l_returnflag"].iloc[0]], "entropy": [entropy], "rows": [int(frame["n"].sum())]}
        )

    def histogram(df: DataFrame) -> DataFrame:
        return df.groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))

    schema = "l_returnflag string, entropy double, rows long"
    return code.code_stage_group(t.lineitem, ["l_returnflag"], stage, schema, histogram)


@query(
    "udaf_grouped",
    "SELECT event_type, round(exp(avg(ln(value + 1))) - 1, 6) AS geometric, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type",
)
def _(t: Tables):
    def partial(frame: pd.DataFrame) -> pd.DataFrame:
        logs = frame.assign(logs=np.log(frame["value"] + 1), n=1)
        return logs.groupby("event_type", as_index=False)[["logs", "n"]].sum()

    schema = "event_type string, logs double, n long"
    events = t.events.select("event_type", "value")
    merged = code.code_stage_aggregate(events, ["event_type"], partial, schema, {"logs": "sum", "n": "sum"})
    mean = F.exp(F.col("logs") / F.col("n")) - 1
    return merged.select("event_type", r(mean, 6).alias("geometric"), "n")


@query(
    "udtf_explode",
    r"""SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(length(line) AS INTEGER) AS chars FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)""",
)
def _(t: Tables):
    @F.udtf(returnType="position: int, chars: int", useArrow=True)
    class Lines:
        def eval(self, text: str):
            for position, line in enumerate(text.split("\n")):
                yield position, len(line)

    documents = t.documents.select("doc_id", "text")
    return documents.lateralJoin(Lines(F.col("text").outer())).drop("text")


@query("code_stage_outputs")
def _(t: Tables):
    store = DatasetStore(t.spark, new_folder(t.spark, "stage"))

    def stage(df: DataFrame):
        doubled = df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("double"))
        totals = df.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("total"))
        return {"Doubled Orders": doubled, "Totals!": totals}, {"rows": df.count()}

    good = code.code_stage_outputs(t.orders, stage, store)
    bad = code.code_stage_outputs(t.orders, lambda df: ({"x": df.select("nowhere")}, {}), store)
    return code.result_frame(t.orders, good).unionByName(code.result_frame(t.orders, bad))
