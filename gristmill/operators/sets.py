"""Set operations that stay balanced when many rows are copies of each other.

Copies are counted before anything is joined, and a row that has to appear many
times in the result is written out by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COPIES_PER_PIECE = 100_000


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().intersect(b.distinct())


def except_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().subtract(b.distinct())


def _counted(a: DataFrame, b: DataFrame, copies: Column) -> DataFrame:
    """Distinct rows with how often they belong into the result."""
    both = a.withColumns({"_a": F.lit(1), "_b": F.lit(0)}).unionByName(
        b.withColumns({"_a": F.lit(0), "_b": F.lit(1)})
    )
    counts = both.groupBy(*a.columns).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    return counts.withColumn("_copies", copies).filter("_copies > 0").drop("_a", "_b")


def _repeat(counted: DataFrame, columns: list[str], piece: int = COPIES_PER_PIECE) -> DataFrame:
    starts = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(piece).cast("long"))
    pieces = counted.select(*columns, "_copies", F.explode(starts).alias("_start"))
    size = F.least(F.col("_copies") - F.col("_start"), F.lit(piece)).cast("int")
    # One small row per piece is moved; its copies are made where it lands.
    spread = pieces.select(*columns, size.alias("_size"), "_start").repartition("_start", *columns)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("_size"))).alias("_copy")
    return spread.select(*columns, copies).drop("_copy")


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row as often as in the side that has it less often."""
    return _repeat(_counted(a, b, F.least("_a", "_b")), a.columns)


def except_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row as often as ``a`` has it more often than ``b``."""
    return _repeat(_counted(a, b, F.greatest(F.col("_a") - F.col("_b"), F.lit(0))), a.columns)
