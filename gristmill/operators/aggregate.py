"""Catalog aggregates and voting-style rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed metrics and the label of a null group.
METRICS = ("count", "sum", "avg", "min", "max")
NULL_LABEL = "—"


def metric_column(metric: str, field: str | None) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    if metric == "count":
        return F.count(F.lit(1)).cast("double")
    if not field:
        raise ValueError(f"{metric} of which field?")
    return F.coalesce(getattr(F, metric)(F.col(field)).cast("double"), F.lit(0.0))


def label(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_LABEL))


def aggregate(
    df: DataFrame,
    metric: str,
    field: str | None = None,
    group_by: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """(group, value, rows), largest value first, ties by group; one row without a key.

    Every group is returned unless the caller asks for the first ``limit``.
    """
    value = metric_column(metric, field)
    counted = F.count(F.lit(1)).alias("rows")
    if group_by is None:
        return df.agg(value.alias("value"), counted).select(
            F.lit("all").alias("group"), "value", "rows"
        )
    grouped = df.groupBy(label(group_by).alias("group")).agg(value.alias("value"), counted)
    ranked = grouped.orderBy(F.desc("value"), F.asc("group"))
    return ranked if limit is None else ranked.limit(limit)


def mode_vote(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """The most frequent answer per key, ties to the smallest answer."""
    votes = df.groupBy(*keys, answer).agg(F.count(F.lit(1)).alias("votes"))
    most = votes.groupBy(*keys).agg(
        F.max("votes").alias("votes"),
        F.min_by(answer, F.struct(-F.col("votes"), F.col(answer))).alias(answer),
    )
    return most.select(*keys, answer, "votes")


def argmax_bid(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score per key, ties to the smallest ``tie``."""
    others = [c for c in df.columns if c not in keys]
    best = F.min_by(
        F.struct(*[F.col(c) for c in others]), F.struct(-F.col(score), F.col(tie))
    )
    return df.groupBy(*keys).agg(best.alias("_best")).select(*keys, "_best.*")


def duplicate_groups(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Digest groups with more than one row: how many copies, and the id kept."""
    grouped = df.groupBy(digest.alias("digest")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("kept")
    )
    return grouped.filter(F.col("copies") > 1)
