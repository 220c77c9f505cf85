"""Expressions on whole texts that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.scratch import new_folder

# A word is a run of characters other than the six ASCII white spaces.
SPACES = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BITS = 1 << 25  # buckets of hashes, by which most rows are told apart from the wanted ones


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    none = F.array().cast("array<string>")
    return F.when(bare == "", none).otherwise(F.split(bare, f"[{SPACES}]+"))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased; every other character stays."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write to a new table in the shared folder and read it back.

    The table survives lost executors, and its size is known to the planner. What was shuffled for
    it goes as soon as it is written, not when the driver next collects its garbage.
    options: of the Parquet writer.
    """
    spark = df.sparkSession
    folder = new_folder(spark, f"llm-{purpose}-{uuid.uuid4().hex[:6]}")
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(folder)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def near(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """``rows`` with ``_near``: true where a wanted row may have the key, false where none has.

    key: a 64-bit hash; wanted: one column of such hashes. Bitmaps of ``BITS`` buckets, some kilobytes a
    row and 4 MB in all, tell most rows, so that only the others need to be shuffled to the wanted ones.
    """

    def bucket(found: Column) -> Column:
        return found.bitwiseAND(F.lit(BITS - 1)) + 1

    spots = wanted.toDF("_key").select(bucket(F.col("_key")).alias("_at"))
    bits = F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits")
    maps = stored(spots.groupBy(F.bitmap_bucket_number("_at").alias("_map")).agg(bits), "near")
    at = F.bitmap_bit_position(bucket(key))
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte, (at % 8).cast("int")), F.lit(0).cast("byte")) == 1
    mapped = rows.withColumn("_map", F.bitmap_bucket_number(bucket(key))).join(F.broadcast(maps), "_map", "left")
    return mapped.select(*rows.columns, held.alias("_near"))


def nullable(name: str) -> Column:
    """A grouping value that keeps null apart from every text."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.lit("="), value), F.lit(""))


def portions(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in portions of at most ``most`` list elements of a
    column, or of one row."""
    for batch in batches:
        ends = batch.column(column).offsets.to_numpy()
        first = 0
        while first < batch.num_rows:
            last = int(ends.searchsorted(ends[first] + most, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
