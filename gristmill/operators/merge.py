"""Keyed merges, idempotent loads, version retention, run-state updates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.ordered import Order, sort_columns
from gristmill.operators.skew import skew_join


def last_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key (combined before the shuffle)."""
    others = [c for c in df.columns if c not in keys]
    place = F.struct(*[F.col(c) for c in order])
    picked = df.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in others]), place).alias("_row")
    )
    return picked.select(*keys, "_row.*").select(*df.columns)


def upsert_by_key(
    target: DataFrame, updates: DataFrame, keys: list[str], order: list[str]
) -> DataFrame:
    """Rows with a matching key are replaced, the others are added."""
    newest = last_per_key(updates, keys, order)
    kept = skew_join(target, newest.select(*keys), keys, "left_anti")
    return kept.unionByName(newest.select(*target.columns))


def insert_if_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Add the source rows whose key the target does not have yet."""
    known = target.select(*keys).distinct()
    new = skew_join(source, known, keys, "left_anti")
    return target.unionByName(new.select(*target.columns))


def load_counts(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """How many source rows are new and how many are already present."""
    known = target.select(*keys).distinct().withColumn("_known", F.lit(True))
    marked = skew_join(source.select(*keys), known, keys, "left")
    return marked.agg(
        F.count_if(F.col("_known").isNull()).alias("migrated"),
        F.count_if(F.col("_known").isNotNull()).alias("already_present"),
    )


def retain_last_n(df: DataFrame, keys: list[str], newest_first: Order, n: int = 25) -> DataFrame:
    """The newest n rows per key; Spark cuts to n per key before the shuffle too."""
    window = Window.partitionBy(*keys).orderBy(*sort_columns(newest_first))
    ranked = df.withColumn("_place", F.row_number().over(window))
    return ranked.filter(F.col("_place") <= n).drop("_place")


def topk_per_group(df: DataFrame, keys: list[str], order: Order, k: int) -> DataFrame:
    return retain_last_n(df, keys, order, k)


def restore_version(history: DataFrame, keys: list[str], version: str, wanted: DataFrame) -> DataFrame:
    """Append, per key, a copy of the wanted version as the newest one."""
    newest = history.groupBy(*keys).agg(F.max(version).alias("_newest"))
    # At most one row per key and version: the keys' newest versions join few rows.
    chosen = history.join(wanted.select(*keys, version), [*keys, version], "left_semi")
    copies = skew_join(chosen, newest, keys).withColumn(version, F.col("_newest") + 1).drop("_newest")
    return history.unionByName(copies)
