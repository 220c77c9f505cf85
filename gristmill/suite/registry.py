"""Registered queries: a Spark callable and, where SQL can say it, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import prepare

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The given tables as attributes, read lazily."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = prepare(spark), folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def register(name: str, run: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
    if sql is not None:
        ORACLE[name] = sql


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        register(name, run, sql)
        return run

    return add


def r(column: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def ts_text(column: str) -> Column:
    """A timestamp as text with microseconds."""
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss.SSSSSS")


def day_text(column: Column | str) -> Column:
    return F.date_format(F.col(column) if isinstance(column, str) else column, "yyyy-MM-dd")
