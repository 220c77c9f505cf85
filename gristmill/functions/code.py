"""User Python over tables: scalar, batch, grouped, aggregate, and row-to-rows forms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.sources.datasets import DatasetStore

MAX_GROUP_ROWS = 1_000_000


def code_stage_map(
    df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a function to Arrow batches; a batch is a slice, never the whole table."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield run(frame)

    return df.mapInPandas(batches, schema)


def code_stage_group(
    df: DataFrame,
    keys: list[str],
    run: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    combine: Callable[[DataFrame], DataFrame] | None = None,
    max_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Apply a function to whole groups.

    A group must fit one task, so a group beyond ``max_rows`` is refused unless
    ``combine`` first reduces the table (for instance to counts per key and value).
    """
    prepared = combine(df) if combine else df
    sizes = prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    if not sizes.filter(F.col("_rows") > max_rows).isEmpty():
        raise ValueError(f"a group has more than {max_rows} rows; pass combine= to reduce it first")
    return prepared.groupBy(*keys).applyInPandas(run, schema)


def dataset_name(title: str) -> str:
    """A dataset name from free text."""
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")[:60] or "output"


@dataclass
class StageResult:
    status: str
    datasets: dict[str, int] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    error: str | None = None


def code_stage_outputs(
    df: DataFrame,
    run: Callable[[DataFrame], tuple[dict[str, DataFrame], dict[str, float]]],
    store: DatasetStore,
) -> StageResult:
    """Run a stage that names its output tables; a failing stage is a result."""
    try:
        tables, metrics = run(df)
        written = {}
        for title, table in tables.items():
            written[dataset_name(title)] = store.replace(dataset_name(title), table)
        return StageResult("ok", written, {k: float(v) for k, v in metrics.items()})
    except Exception as problem:
        return StageResult("error", error=str(problem).splitlines()[0])


def result_frame(df: DataFrame, result: StageResult) -> DataFrame:
    """The outcome as rows: one per dataset and metric, or one for the error."""
    rows = [("dataset", n, float(v)) for n, v in result.datasets.items()]
    rows += [("metric", n, v) for n, v in result.metrics.items()]
    if result.error is not None:
        rows.append(("error", result.error, None))
    return df.sparkSession.createDataFrame(rows, "kind string, name string, value double")




def code_stage_aggregate(
    df: DataFrame,
    keys: list[str],
    partial: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str,
    merge: dict[str, str],
) -> DataFrame:
    """A user aggregate in two steps: per-batch states in Python, merged by Spark.

    ``partial`` returns the keys and state columns of one batch; ``merge`` names the
    Spark aggregate (sum, min, max) for each state column. No group meets in one task.
    """
    states = code_stage_map(df, partial, schema)
    return states.groupBy(*keys).agg(*[getattr(F, how)(c).alias(c) for c, how in merge.items()])
