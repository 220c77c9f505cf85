"""Relational sources through Spark's JDBC reader and writer."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gristmill.operators.aggregate import METRICS

# Fixed value: what an identifier may look like.
IDENTIFIER = re.compile(r"^[A-Za-z_][A-Za-z0-9_]{0,62}$")


def checked_identifier(value: str, what: str) -> str:
    if not IDENTIFIER.match(value or ""):
        raise ValueError(f"invalid {what} name: {value!r}")
    return value


def _reader(spark: SparkSession, url: str, options: dict | None):
    return spark.read.format("jdbc").option("url", url).options(**(options or {}))


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str | None = None,
    partitions: int = 8,
    options: dict | None = None,
) -> DataFrame:
    """A table scan, split by ranges of a numeric column when one is named."""
    checked_identifier(table, "table")
    if partition_column is None:
        return _reader(spark, url, options).option("dbtable", table).load()
    column = checked_identifier(partition_column, "column")
    bounds = f"SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}"
    low, high = _reader(spark, url, options).option("query", bounds).load().first()
    if low is None:
        return _reader(spark, url, options).option("dbtable", table).load()
    return (
        _reader(spark, url, options)
        .option("dbtable", table)
        .option("partitionColumn", column)
        .option("lowerBound", str(low))
        .option("upperBound", str(int(high) + 1))
        .option("numPartitions", str(partitions))
        .load()
    )


def read_query(
    spark: SparkSession, url: str, sql: str, options: dict | None = None
) -> DataFrame:
    """A read-only query that runs inside the database."""
    from gristmill.plans.sqlgate import readonly_sql

    return _reader(spark, url, options).option("query", readonly_sql(spark, sql)).load()


def read_aggregate(
    spark: SparkSession,
    url: str,
    relation: str,
    metric: str,
    field: str | None = None,
    group_by: str | None = None,
    options: dict | None = None,
    limit: int | None = None,
) -> DataFrame:
    """The catalog aggregate computed by the database; only the groups travel."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")
    if metric != "count" and not field:
        raise ValueError(f"{metric} of which field?")
    value = "COUNT(*)" if metric == "count" else f"{metric.upper()}({checked_identifier(field, 'column')})"
    if " " not in relation.strip():
        source = checked_identifier(relation, "table")
    else:
        from gristmill.plans.sqlgate import readonly_sql

        source = f"({readonly_sql(spark, relation)}) q"
    if group_by is None:
        sql = f"SELECT {value} AS agg_value, COUNT(*) AS agg_rows FROM {source}"
        found = _reader(spark, url, options).option("query", sql).load()
        return found.selectExpr(
            "'all' AS `group`",
            "coalesce(cast(agg_value AS double), 0D) AS value",
            "cast(agg_rows AS bigint) AS rows",
        )
    key = checked_identifier(group_by, "column")
    sql = (
        f"SELECT {key} AS agg_key, {value} AS agg_value, COUNT(*) AS agg_rows "
        f"FROM {source} GROUP BY {key}"
    )
    found = _reader(spark, url, options).option("query", sql).load()
    ranked = found.selectExpr(
        "coalesce(cast(agg_key AS string), '—') AS `group`",
        "coalesce(cast(agg_value AS double), 0D) AS value",
        "cast(agg_rows AS bigint) AS rows",
    ).orderBy("value", "group", ascending=[False, True])
    return ranked if limit is None else ranked.limit(limit)


def write_rows(
    df: DataFrame, url: str, table: str, batch_size: int = 10_000, options: dict | None = None
) -> int:
    """Bulk insert; returns how many rows were written, counted while they pass."""
    checked_identifier(table, "table")
    written = Observation()
    (
        df.observe(written, F.count(F.lit(1)).alias("rows"))
        .write.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("batchsize", str(batch_size))
        .options(**(options or {}))
        .mode("append")
        .save()
    )
    return written.get["rows"]


def list_tables(spark: SparkSession, url: str) -> list[str]:
    """Sorted table names behind a connection, from the driver's metadata."""
    manager = spark.sparkContext._jvm.java.sql.DriverManager
    connection = manager.getConnection(url)
    try:
        found = connection.getMetaData().getTables(None, None, "%", None)
        names = []
        while found.next():
            if found.getString("TABLE_TYPE") in ("TABLE", "BASE TABLE"):
                names.append(found.getString("TABLE_NAME"))
        return sorted(names)
    finally:
        connection.close()
