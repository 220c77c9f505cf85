"""Streaming queries: events arrive as files in time order, results are datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.scratch import new_folder
from gristmill.sources.datasets import DatasetStore
from gristmill.streaming import collect
from gristmill.suite.operations import RUN_LOG, run_log
from gristmill.suite.registry import Tables, query, r

# Records arrive in two deliveries, split at this time, with a poll after each.
CUT = "2024-01-16"
# Windows close when later data arrives; this last record lets all real ones close.
CLOSING = "2024-06-01 00:00:00"


def arrive(df: DataFrame, folder: str) -> None:
    df.write.mode("append").parquet(folder)


def deliveries(df: DataFrame, time: str = "ts") -> list[DataFrame]:
    cut = F.lit(CUT).cast(df.schema[time].dataType)
    return [df.filter(F.col(time) < cut), df.filter(F.col(time) >= cut)]


def closing_record(df: DataFrame, time: str = "ts") -> DataFrame:
    values = {time: F.lit(CLOSING).cast(df.schema[time].dataType)}
    return df.sparkSession.range(1).select(
        *[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in df.schema]
    )


class Polled:
    """A dataset fed by a stream over one or more folders that receive deliveries."""

    def __init__(self, t: Tables, build, each=None) -> None:
        self.spark, self.build, self.each = t.spark, build, each
        self.store = DatasetStore(t.spark, new_folder(t.spark, "streams"))
        self.progress = new_folder(t.spark, "progress")
        self.folders: list[str] = []

    def deliver(self, *parts: DataFrame) -> StreamingQuery:
        if not self.folders:
            self.folders = [new_folder(self.spark, "arrivals") for _ in parts]
        for part, folder in zip(parts, self.folders):
            arrive(part, folder)
        schemas = [part.schema for part in parts]
        streams = [
            collect.read_stream(self.spark, f, s) for f, s in zip(self.folders, schemas)
        ]
        return collect.poll(
            self.build(*streams), self.store, "out", self.progress, each=self.each
        )

    def rows(self) -> DataFrame:
        return self.store.read("out")


def _collected(t: Tables, df: DataFrame, build, closing: bool = False, each=None) -> DataFrame:
    polled = Polled(t, build, each)
    for part in deliveries(df):
        polled.deliver(part)
    if closing:
        polled.deliver(closing_record(df))
    return polled.rows()


def _time(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


EVENT_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value"]


@query("stream_collect", "SELECT event_id, user_id, event_type, value FROM events")
def _(t: Tables):
    events = t.events.select(*EVENT_COLUMNS)
    polled = Polled(t, lambda stream: stream)
    for part in deliveries(events):
        polled.deliver(part)
    polled.deliver(events.limit(0))  # a poll that finds nothing new
    return polled.rows().select("event_id", "user_id", "event_type", "value")


@query("stream_dedup", "SELECT event_id, event_type, value FROM events")
def _(t: Tables):
    copies = F.explode(F.expr("CASE WHEN event_id % 20 = 0 THEN array(1, 2) ELSE array(1) END"))
    events = t.events.select(*EVENT_COLUMNS, copies.alias("copy")).drop("copy")
    found = _collected(
        t, events, lambda stream: collect.stream_dedup(stream, ["event_id"], "ts", "1 day")
    )
    return found.select("event_id", "event_type", "value")


@query(
    "stream_filter_events",
    "SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'error')",
)
def _(t: Tables):
    events = t.events.select("event_id", "ts", "event_type")
    found = _collected(
        t, events, lambda stream: collect.stream_filter(stream, ["signup", "error"], "event_type")
    )
    return found.select("event_id", "event_type")


OUTCOMES = """CAST(count(*) FILTER (WHERE status = 'success') AS BIGINT) AS succeeded,
    CAST(count(*) FILTER (WHERE status IN ('error', 'interrupted')) AS BIGINT) AS failed,
    CAST(count(*) FILTER (WHERE status IN ('running', 'queued')) AS BIGINT) AS other"""


def _runs(t: Tables) -> DataFrame:
    return run_log(t).select("run_id", "status", F.col("started_at").alias("ts"))


def _measures():
    return collect.status_counts("status", "success", ["error", "interrupted"])


@query(
    "stream_tumbling_rollup",
    f"""SELECT strftime(date_trunc('day', started_at), '%Y-%m-%d %H:%M:%S') AS start, {OUTCOMES} FROM ({RUN_LOG}) GROUP BY 1""",
)
def _(t: Tables):
    found = _collected(
        t,
        _runs(t),
        lambda stream: collect.tumbling(stream, "ts", "1 day", "1 hour", _measures()),
        closing=True,
    )
    return found.select(_time("start"), "succeeded", "failed", "other")


@query(
    "stream_sliding_rollup",
    f"""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS runs,
        round(count(*) FILTER (WHERE status IN ('error', 'interrupted')) / count(*), 6) AS failure_rate
    FROM (SELECT status, unnest([time_bucket(INTERVAL 15 MINUTE, started_at) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, started_at) - INTERVAL 30 MINUTE,
        time_bucket(INTERVAL 15 MINUTE, started_at) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, started_at)]) AS s FROM ({RUN_LOG})) GROUP BY s""",
)
def _(t: Tables):
    measures = [F.count(F.lit(1)).alias("runs"), *_measures()]
    found = _collected(
        t,
        _runs(t),
        lambda stream: collect.sliding(stream, "ts", "1 hour", "15 minutes", "1 hour", measures),
        closing=True,
    )
    rate = r(F.col("failed") / F.col("runs"), 6).alias("failure_rate")
    return found.select(_time("start"), "runs", rate)


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS events, round(sum(value), 2) AS total
    FROM s GROUP BY user_id, session""",
)
def _(t: Tables):
    events = t.events.select("ts", "user_id", "value")
    measures = [F.count(F.lit(1)).alias("events"), F.sum("value").alias("total")]
    found = _collected(
        t,
        events,
        lambda stream: collect.sessions(
            stream, ["user_id"], "ts", "30 minutes", "1 hour", measures
        ),
        closing=True,
    )
    return found.select("user_id", _time("start"), "events", r("total", 2).alias("total"))


@query("stream_late_data")
def _(t: Tables):
    events = t.events.select("event_id", "ts", "event_type")
    late = F.col("event_id") % 50 == 0
    counts = [F.count(F.lit(1)).alias("events")]
    polled = Polled(t, lambda stream: collect.tumbling(stream, "ts", "1 day", "1 hour", counts))
    # Late rows keep their old time but are delivered last.
    polls = [polled.deliver(part) for part in deliveries(events.filter(~late))]
    polls.append(polled.deliver(events.filter(late)))
    found = [row for poll in polls for row in collect.late_rows(poll)]
    return t.spark.createDataFrame(found, "batch long, input_rows long, dropped_rows long")


@query("stream_latest_status", f"SELECT run_id, status FROM ({RUN_LOG})")
def _(t: Tables):
    log = run_log(t).select("run_id", "status", "started_at", "completed_at")
    # Each run reports up to three states: queued, running, and how it ended.
    reached = F.expr("CASE status WHEN 'queued' THEN array('queued') WHEN 'running' THEN array('queued', 'running') ELSE array('queued', 'running', status) END")
    states = log.select("run_id", "started_at", F.posexplode(reached).alias("step", "status"))
    reports = states.select(
        "run_id",
        "status",
        "step",
        F.expr("timestampadd(DAY, step, started_at)").alias("ts"),
    )
    store = DatasetStore(t.spark, new_folder(t.spark, "streams"))
    folder, progress = new_folder(t.spark, "arrivals"), new_folder(t.spark, "progress")
    for part in deliveries(reports):
        arrive(part, folder)
        stream = collect.read_stream(t.spark, folder, reports.schema)
        collect.collect_latest(stream, store, "status", progress, ["run_id"], ["ts", "step"])
    return collect.latest(store, "status", ["run_id"], ["ts", "step"]).select("run_id", "status")


@query(
    "stream_static_join",
    "SELECT event_id, c_name, c_mktsegment, value FROM events JOIN customer ON user_id = c_custkey",
)
def _(t: Tables):
    events = t.events.select("event_id", "ts", F.col("user_id").alias("c_custkey"), "value")
    people = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    found = _collected(
        t, events, lambda stream: stream, each=collect.joined_with(people, ["c_custkey"])
    )
    return found.select("event_id", "c_name", "c_mktsegment", "value")


@query(
    "stream_stream_join",
    f"SELECT run_id, status FROM ({RUN_LOG}) WHERE completed_at IS NOT NULL AND completed_at <= started_at + INTERVAL 50 MILLISECOND",
)
def _(t: Tables):
    log = run_log(t)
    started = log.select("run_id", F.col("started_at").alias("ts"))
    ended = log.filter(F.col("completed_at").isNotNull()).select(
        "run_id", "status", F.col("completed_at").alias("ended")
    )
    polled = Polled(
        t,
        lambda left, right: collect.stream_interval_join(
            left, right, "run_id", "ts", "ended", "50 MILLISECONDS", "1 day"
        ),
    )
    for left, right in zip(deliveries(started), deliveries(ended, "ended")):
        polled.deliver(left, right)
    return polled.rows().select("run_id", "status")
