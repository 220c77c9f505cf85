"""What a user does with one catalog source: schema, rows, sample, profile, aggregate, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.values import NESTED, public_columns
from gristmill.operators import aggregate as aggregates
from gristmill.operators import profile as profiles
from gristmill.operators import rows as row_ops
from gristmill.sources import jdbc, sinks
from gristmill.sources.catalog import Catalog


def _public(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in public_columns(df)])


def _order(df: DataFrame) -> list[tuple[str, str]]:
    """Newest first for datasets, else by every sortable column: always a stable page."""
    if "_id" in df.columns:
        return [("_id", "desc")]
    return [(f.name, "asc") for f in df.schema if not isinstance(f.dataType, NESTED)]


def schema(catalog: Catalog, source: str) -> DataFrame:
    return profiles.infer_schema(catalog.load(source))


def rows(catalog: Catalog, source: str, limit: int = 50, offset: int = 0) -> dict:
    df = catalog.load(source)
    page = _public(row_ops.page_rows(df, _order(df), limit, offset))
    return {"rows": [r.asDict(recursive=True) for r in page.collect()], "total": df.count()}


def sample(catalog: Catalog, source: str, n: int, seed: str = "0") -> dict:
    df = catalog.load(source)
    key = F.col("_id") if "_id" in df.columns else F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    picked = row_ops.sample_rows(df.withColumn("_key", key), "_key", n, seed)
    total = df.count()
    found = [r.asDict(recursive=True) for r in _public(picked).collect()]
    return {"rows": found, "sampled_from": total, "total": total}


def profile(catalog: Catalog, source: str) -> dict[str, DataFrame]:
    """``number`` and ``string`` profiles of the columns that have one."""
    df = _public(catalog.load(source))
    numeric = profiles.numeric_columns(df)
    text = [f.name for f in df.schema if f.name not in numeric and not isinstance(f.dataType, NESTED)]
    found = {}
    if numeric:
        found["number"] = profiles.profile_numeric(df, numeric)
    if text:
        found["string"] = profiles.profile_categorical(df, text)
    return found


def aggregate(
    catalog: Catalog,
    source: str,
    metric: str,
    field: str | None = None,
    group_by: str | None = None,
) -> DataFrame:
    """Relational sources aggregate in the database, all others in Spark."""
    known = catalog.resolve(source)
    if known.kind == "sql":
        relation = known.config.get("table") or known.config["sql"]
        options = known.config.get("options")
        return jdbc.read_aggregate(
            catalog.spark, known.config["url"], relation, metric, field, group_by, options
        )
    return aggregates.aggregate(catalog.load(known), metric, field, group_by)


def export(catalog: Catalog, source: str, folder: str, fmt: str) -> str:
    known = catalog.resolve(source)
    return sinks.export(catalog.load(known), folder, known.name, fmt)


def materialize(catalog: Catalog, source: str, dataset: str, mode: str = "replace") -> int:
    return sinks.materialize(_public(catalog.load(source)), catalog.store, dataset, mode)
