"""Schema reading, type inference and column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.values import INTEGER_TEXT, NESTED, number_of, public_columns
from gristmill.operators.merge import topk_per_group


def catalog_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    return "object" if isinstance(kind, NESTED) else "string"


def infer_schema(df: DataFrame) -> DataFrame:
    """(name, type) of the public columns, with the four catalog types."""
    fields = [(f.name, catalog_type(f.dataType)) for f in df.schema if not f.name.startswith("_")]
    return df.sparkSession.createDataFrame(fields, "name string, type string")


def numeric_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema
        if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")
    ]


def infer_load_types(df: DataFrame, columns: list[str]) -> DataFrame:
    """The narrowest load type that holds every value of each text column.

    Any other text makes VARCHAR, else a fraction makes DOUBLE, else BIGINT (or
    DECIMAL(38,0) where that is too narrow), else BOOLEAN; a column without values is
    VARCHAR.
    """
    found = df.select(
        *[F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)).alias(c) for c in columns]
    )
    checks = []
    for name in columns:
        text = F.trim(F.col(name).cast("string"))
        checks += [
            F.bool_and(F.when(text.isNotNull(), text.rlike(INTEGER_TEXT) & text.try_cast("long").isNotNull())).alias(f"{name}:whole"),
            F.bool_and(
                F.when(text.isNotNull(), text.rlike(INTEGER_TEXT) & text.try_cast("decimal(38,0)").isNotNull())
            ).alias(f"{name}:wide"),
            F.bool_and(F.when(text.isNotNull(), number_of(text).isNotNull())).alias(f"{name}:number"),
            F.bool_and(F.when(text.isNotNull(), F.lower(text).isin("true", "false"))).alias(f"{name}:flag"),
        ]
    tested = found.agg(*checks)
    rows = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.when(F.col(f"`{name}:whole`"), "BIGINT")
                .when(F.col(f"`{name}:wide`"), "DECIMAL(38,0)")
                .when(F.col(f"`{name}:number`"), "DOUBLE")
                .when(F.col(f"`{name}:flag`"), "BOOLEAN")
                .otherwise("VARCHAR")
                .alias("load_type"),
            )
            for name in columns
        ]
    )
    return tested.select(F.explode(rows).alias("r")).select("r.*")


def _values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value) rows with every value as text; blanks count as null."""
    pairs = [
        F.struct(F.lit(c).alias("name"), F.nullif(F.col(c).cast("string"), F.lit("")).alias("value"))
        for c in columns
    ]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.name", "p.value")


def _counted(df: DataFrame, columns: list[str]) -> DataFrame:
    return _values(df, columns).groupBy("name", "value").agg(F.count(F.lit(1)).alias("count"))


def _presence(counted: DataFrame) -> DataFrame:
    return counted.groupBy("name").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """nulls, distinct, min, max, mean and sample deviation per numeric column."""
    columns = columns or numeric_columns(df)
    measures = []
    for name in columns:
        value = F.col(name).cast("double")
        measures += [
            F.min(value).alias(f"{name}:min"),
            F.max(value).alias(f"{name}:max"),
            F.avg(value).alias(f"{name}:mean"),
            F.when(F.count(value) > 1, F.stddev_samp(value)).alias(f"{name}:std"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("name"),
                *[F.col(f"`{c}:{m}`").alias(m) for m in ("min", "max", "mean", "std")],
            )
            for c in columns
        ]
    )
    stats = df.agg(*measures).select(F.explode(rows).alias("r")).select("r.*")
    # One row per column on both sides.
    return _presence(_counted(df, columns)).join(stats, "name")


def profile_categorical(df: DataFrame, columns: list[str] | None = None, top: int = 5) -> DataFrame:
    """nulls, distinct and the most frequent values per column, ties by value."""
    if columns is None:
        numeric = set(numeric_columns(df))
        columns = [c for c in public_columns(df) if c not in numeric]
    counted = _counted(df, columns)
    # Blanks sort last instead of being filtered out, so that both uses of the counts
    # are the same plan and Spark computes them once.
    best = topk_per_group(
        counted.withColumn("_blank", F.col("value").isNull()),
        ["name"],
        [("_blank", "asc"), ("count", "desc"), ("value", "asc")],
        top,
    )
    return _presence(counted).join(best.filter(~F.col("_blank")).drop("_blank"), "name")


def profile_approx(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-pass sketch profile: approximate distinct count, quartiles, frequent values."""
    kinds = {f.name: f.dataType for f in df.schema}
    rows = []
    measures = []
    for name in columns:
        value = F.col(name)
        numeric = isinstance(kinds[name], T.NumericType)
        measures += [
            F.approx_count_distinct(value).alias(f"{name}:distinct"),
            F.expr(f"approx_top_k(`{name}`, 5)").alias(f"{name}:top"),
        ]
        quartiles = F.lit(None).cast("array<double>")
        if numeric:
            measures.append(
                F.percentile_approx(value.cast("double"), [0.25, 0.5, 0.75], 10_000).alias(
                    f"{name}:quartiles"
                )
            )
            quartiles = F.col(f"`{name}:quartiles`")
        rows.append(
            F.struct(
                F.lit(name).alias("name"),
                F.col(f"`{name}:distinct`").alias("approx_distinct"),
                quartiles[0].alias("q1"),
                quartiles[1].alias("median"),
                quartiles[2].alias("q3"),
                F.transform(F.col(f"`{name}:top`"), lambda t: t["item"].cast("string")).alias("top"),
            )
        )
    return (
        df.agg(*measures)
        .select(F.explode(F.array(*rows)).alias("r"))
        .select("r.name", "r.approx_distinct", "r.q1", "r.median", "r.q3", F.concat_ws(",", "r.top").alias("top"))
    )


def looks_numeric(df: DataFrame, column: str) -> bool:
    """Whether at least half of the present values of a column are numbers."""
    text = F.nullif(F.col(column).cast("string"), F.lit(""))
    present, numbers = df.agg(F.count(text), F.count(number_of(text))).first()
    return numbers >= max(1, present // 2) and numbers > 0


def infer_record_types(df: DataFrame, column: str, order: str) -> DataFrame:
    """Catalog types of the keys of a JSON column, over all records.

    A key is a string until a later record shows another type; the first type other
    than string stays.
    """
    parsed = df.select(F.col(order).alias("at"), F.try_parse_json(F.col(column)).alias("_json"))
    entries = parsed.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_json").outer()))
    fields = entries.select(
        "at", F.col("key").alias("name"), F.schema_of_variant("value").alias("kind")
    )
    kind = (
        F.when(F.col("kind") == "BOOLEAN", "boolean")
        .when(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "number")
        .when(F.col("kind").rlike("^(OBJECT|ARRAY)"), "object")
        .otherwise("string")
    )
    typed = fields.select("name", "at", kind.alias("kind"))
    other = F.when(F.col("kind") != "string", F.col("at"))
    return typed.groupBy("name").agg(
        F.coalesce(F.min_by("kind", other), F.lit("string")).alias("type")
    )
