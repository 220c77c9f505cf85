"""SQL over several sources at once."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans.sqlgate import readonly_sql
from gristmill.session import isolated
from gristmill.sources.jdbc import checked_identifier

if TYPE_CHECKING:
    from gristmill.sources.catalog import Catalog


def federate(catalog: Catalog, sql: str, sources: dict[str, str]) -> DataFrame:
    """Run a read-only query whose table names are aliases of catalog sources.

    Sources become lazy views of an isolated session, so filters and column pruning
    reach every scan and the query sees nothing but its aliases.
    """
    session = isolated(catalog.spark)
    for alias, source_id in sources.items():
        checked_identifier(alias, "alias")
        source = catalog.resolve(source_id)
        if source.kind == "federated":
            raise ValueError("federated sources cannot reference each other")
        frame = catalog.load(source, session)
        frame.select(*[f"`{c}`" for c in frame.columns if not c.startswith("_")]).createOrReplaceTempView(alias)
    return session.sql(readonly_sql(session, sql, set(sources)))


def federate_views(spark: SparkSession, sql: str, paths: dict[str, str]) -> DataFrame:
    """The same over Parquet paths, without a catalog."""
    session = isolated(spark)
    for alias, path in paths.items():
        session.read.parquet(path).createOrReplaceTempView(checked_identifier(alias, "alias"))
    return session.sql(readonly_sql(session, sql, set(paths)))
