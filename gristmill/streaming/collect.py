"""Streams over files: collection, deduplication, rollups, joins.

Every sink is a dataset of the ``DatasetStore``. A batch is published together with
its (stream, batch id), so a batch repeated after a failure adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from gristmill.operators.merge import last_per_key
from gristmill.operators.rows import event_filter
from gristmill.operators.skew import skew_join
from gristmill.sources.datasets import DatasetStore


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def with_event_time(stream: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark needs an instant, so a zone-less time is read in the session zone."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def collect_into(
    stream: DataFrame,
    store: DatasetStore,
    dataset: str,
    checkpoint: str,
    every: str | None = None,
    name: str | None = None,
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append every new record. Without an interval: take what is there, then stop.

    ``each`` turns a batch into the rows to append.
    """
    identity = name or dataset
    store.register(dataset)

    def publish(batch: DataFrame, batch_id: int) -> None:
        rows = each(batch) if each else batch
        store.append(dataset, rows, batch=(identity, batch_id))

    writer = stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.outputMode("append").trigger(**trigger).start()


def poll(
    stream: DataFrame,
    store: DatasetStore,
    dataset: str,
    checkpoint: str,
    timeout: int = 600,
    each: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """One poll: run until the source has nothing new, and wait for it."""
    running = collect_into(stream, store, dataset, checkpoint, each=each)
    if not running.awaitTermination(timeout):
        running.stop()
        raise TimeoutError(f"stream into '{dataset}' did not finish in {timeout} s")
    return running


def stream_dedup(
    stream: DataFrame, keys: list[str], time: str, horizon: str, salts: int = 16
) -> DataFrame:
    """Drop repeats of a key that arrive within the horizon.

    The copies of one key are first thinned out in several tasks, by the partition they
    were read in; at most one row per salt reaches the task that decides.
    """
    timed = with_event_time(stream, time, horizon)
    salted = timed.withColumn("_salt", F.spark_partition_id() % salts)
    thinned = salted.dropDuplicatesWithinWatermark([*keys, "_salt"]).drop("_salt")
    return thinned.dropDuplicatesWithinWatermark(keys)


def stream_filter(
    stream: DataFrame, accepted: list[str], event: str, action: str | None = None
) -> DataFrame:
    return event_filter(stream, accepted, event, action)


def tumbling(stream: DataFrame, time: str, width: str, delay: str, measures: list[Column], keys: list[str] = ()) -> DataFrame:
    """One row per closed window (and key)."""
    timed = with_event_time(stream, time, delay)
    grouped = timed.groupBy(F.window(time, width), *keys).agg(*measures)
    return _flat(grouped, "window")


def sliding(
    stream: DataFrame, time: str, width: str, step: str, delay: str, measures: list[Column]
) -> DataFrame:
    timed = with_event_time(stream, time, delay)
    return _flat(timed.groupBy(F.window(time, width, step)).agg(*measures), "window")


def sessions(
    stream: DataFrame, keys: list[str], time: str, gap: str, delay: str, measures: list[Column]
) -> DataFrame:
    """One row per key and run of events with no pause longer than the gap."""
    timed = with_event_time(stream, time, delay)
    grouped = timed.groupBy(F.session_window(time, gap), *keys).agg(*measures)
    return _flat(grouped, "session_window")


def _flat(grouped: DataFrame, window: str) -> DataFrame:
    others = [c for c in grouped.columns if c != window]
    return grouped.select(
        F.col(f"{window}.start").alias("start"), F.col(f"{window}.end").alias("end"), *others
    )


def status_counts(status: str, succeeded: str, failed: list[str]) -> list[Column]:
    """succeeded / failed / other, as used by the daily report."""
    value = F.col(status)
    good, bad = value == succeeded, value.isin(*failed)
    return [
        F.count_if(good).alias("succeeded"),
        F.count_if(bad).alias("failed"),
        F.count_if(~good & ~bad).alias("other"),
    ]


def collect_latest(
    stream: DataFrame,
    store: DatasetStore,
    dataset: str,
    checkpoint: str,
    keys: list[str],
    order: list[str],
    timeout: int = 600,
) -> StreamingQuery:
    """Keep a log from which ``latest`` reads the newest state per key.

    A batch is reduced to one row per key before it is appended, and nothing written
    earlier is rewritten.
    """
    store.register(dataset)

    def publish(batch: DataFrame, batch_id: int) -> None:
        store.append(dataset, last_per_key(batch, keys, order), batch=(dataset, batch_id))

    running = (
        stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if not running.awaitTermination(timeout):
        running.stop()
        raise TimeoutError(f"stream into '{dataset}' did not finish in {timeout} s")
    return running


def latest(store: DatasetStore, dataset: str, keys: list[str], order: list[str]) -> DataFrame:
    rows = store.read(dataset)
    return last_per_key(rows.select(*[c for c in rows.columns if not c.startswith("_")]), keys, order)


def joined_with(table: DataFrame, on: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For ``each``: events with their row of a table, heavy keys of the batch salted.

    The table is read anew for every batch.
    """
    return lambda batch: skew_join(batch, table, on)


def stream_interval_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    left_time: str,
    right_time: str,
    within: str,
    delay: str,
) -> DataFrame:
    """Pairs of one key whose right time is at most ``within`` after the left time.

    Both watermarks and the bound let Spark forget rows that can no longer match.
    """
    lefts = with_event_time(left, left_time, delay)
    rights = with_event_time(right, right_time, delay).withColumnRenamed(key, "_right_key")
    bound = F.expr(f"INTERVAL {within}")
    matches = (
        (F.col(key) == F.col("_right_key"))
        & (F.col(right_time) >= F.col(left_time))
        & (F.col(right_time) <= F.col(left_time) + bound)
    )
    return lefts.join(rights, matches).drop("_right_key")


def late_rows(query: StreamingQuery) -> list[tuple[int, int, int]]:
    """(batch, input rows, rows dropped behind the watermark) of the newest reports.

    A query keeps a bounded number of reports; ``LateRows`` counts all of them.
    """
    return [_dropped(progress) for progress in query.recentProgress]


def _dropped(progress) -> tuple[int, int, int]:
    dropped = sum(op["numRowsDroppedByWatermark"] for op in progress["stateOperators"])
    return progress["batchId"], progress["numInputRows"], dropped


class LateRows(StreamingQueryListener):
    """Totals of input and dropped rows per stream since it was added to the session.

    ``spark.streams.addListener(LateRows())`` before the streams start.
    """

    def __init__(self) -> None:
        self.totals: dict[str, tuple[int, int]] = {}
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.totals.setdefault(str(event.id), (0, 0))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        rows, dropped = self.totals.get(str(progress.id), (0, 0))
        late = sum(state.numRowsDroppedByWatermark for state in progress.stateOperators)
        self.totals[str(progress.id)] = rows + progress.numInputRows, dropped + late

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.add(str(event.runId))
