"""Text measures and extraction, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_measures(text: Column) -> dict[str, Column]:
    return {
        "chars": F.length(text),
        "words": F.regexp_count(text, F.lit(r"\S+")),
        "sentences": F.regexp_count(text, F.lit(r"[.!?]+")),
        "lines": F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
    }


def text_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Documents and summed measures per group."""
    measured = df.select(*by, *[c.alias(n) for n, c in text_measures(F.col(column)).items()])
    sums = [F.sum(n).cast("long").alias(n) for n in ("chars", "words", "sentences", "lines")]
    return measured.groupBy(*by).agg(F.count(F.lit(1)).alias("documents"), *sums)


def frequent_words(df: DataFrame, column: str, limit: int = 10) -> DataFrame:
    """Most frequent lower-cased words of the whole table, ties by word."""
    words = df.select(F.explode(F.split(F.lower(F.col(column)), r"\s+")).alias("word"))
    counted = words.filter(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.orderBy(F.desc("occurrences"), F.asc("word")).limit(limit)


def regex_counts(
    df: DataFrame, column: str, patterns: dict[str, str], by: list[str]
) -> DataFrame:
    """Per pattern and group: rows that match, matches, and different matches."""
    found = F.map_from_arrays(
        F.array(*[F.lit(n) for n in patterns]),
        F.array(
            *[F.regexp_extract_all(F.col(column), F.lit(p), F.lit(0)) for p in patterns.values()]
        ),
    )
    per_row = df.select(*by, F.explode(found).alias("pattern", "hits"))
    keys = [*by, "pattern"]
    # Each row adds one null entry that carries whether it matched, so rows, matches and
    # different matches come out of the same pass and the same shuffle.
    entries = per_row.select(
        *keys,
        (F.size("hits") > 0).cast("int").alias("matched"),
        F.explode(F.array_append("hits", F.lit(None).cast("string"))).alias("hit"),
    )
    per_hit = entries.groupBy(*keys, "hit").agg(
        F.count(F.lit(1)).alias("n"), F.sum("matched").alias("matched")
    )
    row_entry = F.col("hit").isNull()
    zero = F.lit(0).cast("long")
    return per_hit.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(row_entry, F.col("matched"))), zero).alias("rows_matched"),
        F.coalesce(F.sum(F.when(~row_entry, F.col("n"))), zero).alias("matches"),
        F.count("hit").alias("distinct_matches"),
    )


def regex_replace(df: DataFrame, column: str, pattern: str, replacement: str) -> DataFrame:
    return df.withColumn(column, F.regexp_replace(F.col(column), pattern, replacement))
