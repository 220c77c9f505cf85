"""Rollups over a run log.

A run has run_id, workflow, status, trigger, started_at, completed_at and
``node_results`` (map of node id to a struct with status, output, duration_ms).
``now`` is always a parameter, so a report can be repeated.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ordered import exact_percentiles
from gristmill.operators.skew import skew_join

# Statuses, the window limits, the sizes of the feeds.
SUCCESS = "success"
FAILURES = ("error", "interrupted")
UNFINISHED = ("queued", "running")
MIN_DAYS, MAX_DAYS, DEFAULT_DAYS = 1, 90, 14
RECENT, SLOWEST = 12, 10
STALE_ERROR = "run was unfinished when the service started"


def clamp_days(days: int) -> int:
    """For callers that take a window from a user; the operators take any from one day."""
    return max(MIN_DAYS, min(int(days), MAX_DAYS))


def duration_ms(started: str = "started_at", completed: str = "completed_at") -> Column:
    """Milliseconds between start and end, never negative; null while unfinished."""
    micros = F.unix_micros(F.col(completed).cast("timestamp")) - F.unix_micros(
        F.col(started).cast("timestamp")
    )
    return F.when(micros.isNotNull(), F.greatest(micros / 1000.0, F.lit(0.0)))


def trigger_kind(trigger: str = "trigger") -> Column:
    """``retry:``, ``rerun:`` and ``error:`` lose their id; no trigger is manual."""
    raw = F.coalesce(F.nullif(F.col(trigger), F.lit("")), F.lit("manual"))
    return F.regexp_replace(raw, "^(retry|rerun|error):.*$", "$1")


def in_window(runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """Runs of the last ``days`` days; a run without a start time counts as new."""
    cutoff = F.lit(now - timedelta(days=max(MIN_DAYS, int(days)))).cast("timestamp_ntz")
    started = F.col("started_at").cast("timestamp_ntz")
    return runs.filter(started.isNull() | (started >= cutoff))


def _outcomes() -> list[Column]:
    status = F.col("status")
    succeeded, failed = status == SUCCESS, status.isin(*FAILURES)
    return [
        F.count_if(succeeded).alias("succeeded"),
        F.count_if(failed).alias("failed"),
    ]


def _rate() -> Column:
    return F.try_divide(F.col("succeeded").cast("double"), F.col("runs")).alias("success_rate")


def runs_totals(runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    recent = in_window(runs, now, days)
    counts = recent.agg(F.count(F.lit(1)).alias("runs"), *_outcomes())
    timed = recent.select(duration_ms().alias("ms"))
    median = exact_percentiles(timed, [], "ms", {"median": 0.5}).scalar()
    other = (F.col("runs") - F.col("succeeded") - F.col("failed")).alias("other")
    return counts.select(
        "runs", "succeeded", "failed", other, _rate(), median.alias("median_duration_ms")
    )


def runs_daily(runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    """One row per calendar day of the window, days without runs included."""
    days = max(MIN_DAYS, int(days))
    counted = (
        in_window(runs, now, days)
        .groupBy(F.to_date("started_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("runs"), *_outcomes())
    )
    today = F.lit(now.date())
    calendar = runs.sparkSession.range(days).select(
        F.date_sub(today, F.col("id").cast("int")).alias("date")
    )
    zero = F.lit(0)
    return calendar.join(counted, ["date"], "left").select(
        "date",
        F.coalesce("succeeded", zero).alias("succeeded"),
        F.coalesce("failed", zero).alias("failed"),
        F.coalesce(F.col("runs") - F.col("succeeded") - F.col("failed"), zero).alias("other"),
    )


def runs_by_workflow(runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    grouped = (
        in_window(runs, now, days)
        .withColumn("_ms", duration_ms())
        .groupBy(F.col("workflow").alias("name"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            *_outcomes(),
            F.avg("_ms").alias("avg_duration_ms"),
            F.max("started_at").alias("last_run_at"),
        )
    )
    return grouped.withColumn("success_rate", _rate()).orderBy(F.desc("runs"), "name")


def runs_by_trigger(runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS) -> DataFrame:
    counted = (
        in_window(runs, now, days)
        .groupBy(trigger_kind().alias("trigger"))
        .agg(F.count(F.lit(1)).alias("runs"))
    )
    return counted.orderBy(F.desc("runs"), "trigger")


def node_rows(runs: DataFrame, *columns: str) -> DataFrame:
    """One row per node result: columns of the run plus node_id and the result."""
    return runs.select(*columns, F.explode("node_results").alias("node_id", "node"))


def slowest_nodes(
    runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS, limit: int = SLOWEST
) -> DataFrame:
    nodes = node_rows(in_window(runs, now, days), "workflow")
    timed = nodes.filter(F.col("node.duration_ms").isNotNull())
    averaged = timed.groupBy("workflow", "node_id").agg(
        F.avg("node.duration_ms").alias("avg_duration_ms"), F.count(F.lit(1)).alias("runs")
    )
    return averaged.orderBy(F.desc("avg_duration_ms"), "workflow", "node_id").limit(limit)


def runs_recent(
    runs: DataFrame, now: datetime, days: int = DEFAULT_DAYS, limit: int = RECENT
) -> DataFrame:
    newest = (
        in_window(runs, now, days)
        .orderBy(F.desc_nulls_last("started_at"), F.desc("run_id"))
        .limit(limit)
    )
    return newest.select(
        "run_id",
        "workflow",
        "status",
        trigger_kind().alias("trigger"),
        "started_at",
        duration_ms().alias("duration_ms"),
    )


def mark_stale_runs(runs: DataFrame, now: datetime) -> DataFrame:
    """Unfinished runs become interrupted, with a reason and an end time."""
    stale = F.col("status").isin(*UNFINISHED)
    end = F.lit(now).cast(runs.schema["completed_at"].dataType)
    return runs.withColumns(
        {
            "status": F.when(stale, "interrupted").otherwise(F.col("status")),
            "error": F.when(stale, STALE_ERROR).otherwise(F.col("error")),
            "completed_at": F.when(stale, end).otherwise(F.col("completed_at")),
        }
    )


def resume_set(runs: DataFrame) -> DataFrame:
    """Node outputs that a resumed run may reuse: completed and kept whole."""
    nodes = node_rows(runs, "run_id")
    usable = (F.col("node.status") == "completed") & ~F.coalesce(
        F.col("node.truncated"), F.lit(False)
    )
    return nodes.filter(usable).select("run_id", "node_id", F.col("node.output").alias("output"))


def nodes_to_do(runs: DataFrame, graph: DataFrame) -> DataFrame:
    """Nodes of each run's workflow without a reusable output.

    ``graph`` lists (workflow, node_id). A run brings its reusable nodes along as an
    array, so one join by workflow is enough.
    """
    usable = F.map_keys(
        F.map_filter(
            "node_results",
            lambda _, n: (n["status"] == "completed") & ~F.coalesce(n["truncated"], F.lit(False)),
        )
    )
    have = F.coalesce(usable, F.array().cast("array<string>"))
    planned = skew_join(
        runs.select("run_id", "workflow", have.alias("_have")),
        graph.select("workflow", "node_id").distinct(),
        ["workflow"],
    )
    return planned.filter(~F.array_contains("_have", F.col("node_id"))).select("run_id", "node_id")


def latest_run_context(runs: DataFrame) -> DataFrame:
    """Per workflow the newest run that has node results, with those results."""
    usable = runs.filter(F.size(F.map_keys("node_results")) > 0)
    newest = F.max_by(
        F.struct("run_id", "started_at", "node_results"), F.struct("started_at", "run_id")
    )
    return usable.groupBy("workflow").agg(newest.alias("r")).select("workflow", "r.*")


def failure_payload(runs: DataFrame) -> DataFrame:
    """Per failed run its error and the ids of its failed nodes, sorted."""
    failed = F.map_keys(F.map_filter("node_results", lambda _, n: n["status"] == "failed"))
    return runs.filter(F.col("status") == "error").select(
        "run_id",
        "workflow",
        F.coalesce("error", F.lit("unknown error")).alias("error"),
        F.array_sort(failed).alias("failed_nodes"),
    )
