"""File and object-store readers; a path may be a glob or an ``s3a://`` URL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.values import number_kind, number_of
from gristmill.sources.records import quoted_records, split_records

WIDE = "decimal(38,0)"
_PACKED = re.compile(r"\.(gz|bz2|zst|lz4|snappy|deflate)$", re.I)
_EXTENSION = re.compile(r"\.(csv|json|jsonl|parquet|orc|xml)(\.(gz|bz2|zst))?$", re.I)


def read_csv(
    spark: SparkSession, path: str, typed: bool = True, quoted_breaks: bool = True
) -> DataFrame:
    """Header CSV: cells trimmed, blanks null, whole columns typed as numbers.

    A column is BIGINT, DECIMAL(38,0) or DOUBLE when every value is such a number, else
    text. The check reads the whole column, not a sample. Quoted cells may hold line
    breaks and doubled quotes; large files are read in splits all the same (see
    ``records``). ``quoted_breaks=False`` spares the look for such cells. Records end with a
    line feed, a carriage return before it does not count.
    """
    options = {
        "escape": '"',
        "ignoreLeadingWhiteSpace": "true",
        "ignoreTrailingWhiteSpace": "true",
        "nullValue": "",
        "emptyValue": "",
        "mode": "PERMISSIVE",
    }
    records = quoted_records(spark, path) if quoted_breaks and not _PACKED.search(path) else None
    if records is not None:
        raw = split_records(records, options)
    else:
        # A compressed file has no splits.
        whole = quoted_breaks and bool(_PACKED.search(path))
        raw = spark.read.options(**options).options(header=True, multiLine=whole, encoding="UTF-8").csv(path)
    raw = raw.toDF(*[c.removeprefix("\ufeff") for c in raw.columns])
    return type_columns(raw) if typed else raw


def type_columns(raw: DataFrame) -> DataFrame:
    """Give all-number text columns the narrowest type that loses nothing.

    Integers too long for DECIMAL(38,0) stay text.
    """
    names = [f.name for f in raw.schema if isinstance(f.dataType, T.StringType)]
    tests = []
    for name in names:
        kind = number_kind(F.col(f"`{name}`"))
        tests += [
            F.bool_and(F.when(kind != "blank", F.trim(F.col(f"`{name}`")).try_cast("long").isNotNull() & (kind == "int"))),
            F.bool_and(F.when(kind != "blank", F.trim(F.col(f"`{name}`")).try_cast(WIDE).isNotNull() & (kind == "int"))),
            F.bool_and(F.when(kind != "blank", kind == "int")),
            F.bool_and(F.when(kind != "blank", kind != "text")),
        ]
    if not tests:
        return raw
    verdicts = raw.agg(*tests).first()
    typed = {}
    for index, name in enumerate(names):
        fits, wide, whole, number = verdicts[4 * index : 4 * index + 4]
        column = F.col(f"`{name}`")
        if fits or wide:
            typed[name] = F.trim(column).try_cast("long" if fits else WIDE)
        elif number and not whole:
            typed[name] = number_of(column)
    return raw.withColumns(typed) if typed else raw


def read_json_records(
    spark: SparkSession, path: str, schema: str
) -> tuple[DataFrame, DataFrame]:
    """(good, bad) records of JSON lines; a bad record keeps its text."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.col("value"), f"{schema}, _corrupt STRING", options)
    lines = spark.read.text(path).filter(F.trim("value") != "")
    records = lines.select("value", parsed.alias("_record"))
    corrupt = F.col("_record").isNull() | F.col("_record._corrupt").isNotNull()
    good = records.filter(~corrupt).select("_record.*").drop("_corrupt")
    return good, records.filter(corrupt).select(F.col("value").alias("record"))


def read_feed_items(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row per ``item`` element of feed documents."""
    reader = spark.read.format("xml").option("rowTag", "item")
    return (reader.schema(schema) if schema else reader).load(path)


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Read many files at once; the extension picks the format."""
    found = _EXTENSION.search(path)
    kind = found.group(1).lower() if found else "parquet"
    if kind == "csv":
        return read_csv(spark, path)
    if kind in ("json", "jsonl"):
        return spark.read.json(path)
    if kind == "xml":
        return read_feed_items(spark, path)
    return getattr(spark.read, kind)(path)


def grid_to_table(grid: DataFrame, row: str, cells: str) -> DataFrame:
    """Header promotion: the first row names the columns of an array column.

    Blank headers and cells beyond the header become ``col_<n>``; missing cells null.
    """
    width = grid.agg(F.max(F.size(cells))).first()[0] or 0
    first = grid.agg(F.min_by(cells, row).alias("header"), F.min(row).alias("at")).first()
    header = list(first["header"] or [])
    names = [
        header[i] if i < len(header) and header[i] not in (None, "") else f"col_{i + 1}"
        for i in range(width)
    ]
    body = grid.filter(F.col(row) > F.lit(first["at"]))
    return body.select(*[F.get(F.col(cells), i).alias(n) for i, n in enumerate(names)])
