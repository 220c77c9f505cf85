"""Small result tables behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.aggregate import METRICS, aggregate, metric_column
from gristmill.operators.joins import small_product
from gristmill.operators.ordered import exact_percentiles
from gristmill.operators.prep import equal_width
from gristmill.operators.rows import sample_rows
from gristmill.scratch import cut_lineage

# The drawable kinds.
KINDS = ("bar", "line")


def check_chart(spec: dict | None, columns: list[str]) -> dict | None:
    """The spec when it can be drawn from these columns, else None."""
    if not spec or spec.get("type") not in KINDS:
        return None
    return spec if spec.get("x") in columns and spec.get("y") in columns else None


def chart_line(
    df: DataFrame, x: Column, metric: str, field: str | None, points: int | None = None
) -> DataFrame:
    grouped = df.groupBy(x.alias("x")).agg(metric_column(metric, field).alias("y"))
    ordered = grouped.orderBy("x")
    return ordered if points is None else ordered.limit(points)


def chart_bar(
    df: DataFrame, category: str, metric: str, field: str | None, limit: int | None = None
) -> DataFrame:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    finite = df
    if field is not None:
        value = F.col(field).cast("double")
        finite = df.filter(value.isNull() | (~F.isnan(value) & (F.abs(value) < float("inf"))))
    return aggregate(finite, metric, field, category, limit).select(
        F.col("group").alias("x"), F.col("value").alias("y")
    )


def chart_hist(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts of equal-width bins; empty bins are kept."""
    counts = df.groupBy(equal_width(df, column, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count")
    )
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, ["bin"], "left").select(
        "bin", F.coalesce("count", F.lit(0)).alias("count")
    )


def chart_box(df: DataFrame, group: str, column: str) -> DataFrame:
    points = {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}
    return exact_percentiles(df, [group], column, points)


def chart_heatmap(df: DataFrame, row: str, column: str, metric: str, field: str | None) -> DataFrame:
    """A value for every (row, column) pair of two small key sets; missing cells are 0."""
    # The cells are few and read several times: computed once.
    cells = cut_lineage(df.groupBy(row, column).agg(metric_column(metric, field).alias("value")))
    grid = small_product(cells.select(row).distinct(), cells.select(column).distinct())
    return grid.join(cells, [row, column], "left").withColumn(
        "value", F.coalesce("value", F.lit(0.0))
    )


def chart_scatter(df: DataFrame, key: str, x: str, y: str, n: int, seed: str = "0") -> DataFrame:
    present = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return sample_rows(present.select(key, x, y), key, n, seed)
