"""Cell-level helpers: blanks, numbers, nested values, capping, hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
INTEGER_TEXT = r"^[+-]?[0-9]+$"


def public_columns(df: DataFrame) -> list[str]:
    """Columns a user sees: internal ones start with an underscore."""
    return [c for c in df.columns if not c.startswith("_")]


def number_of(text: Column) -> Column:
    """Trimmed text as a double, or null when it is not a number."""
    cleaned = F.trim(text)
    plain = cleaned.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, cleaned.try_cast("double"))


def number_kind(text: Column) -> Column:
    """blank, int, float or text: what a CSV cell holds."""
    cleaned = F.trim(text)
    return (
        F.when(text.isNull() | (cleaned == ""), "blank")
        .when(cleaned.rlike(INTEGER_TEXT), "int")
        .when(number_of(text).isNotNull(), "float")
        .otherwise("text")
    )


def stringify_nested(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Nested columns as JSON text; other listed columns as plain text."""
    kinds = {field.name: field.dataType for field in df.schema}
    wanted = columns if columns is not None else list(kinds)
    changed = {}
    for name in wanted:
        if isinstance(kinds[name], NESTED):
            changed[name] = F.to_json(F.col(name))
        elif columns is not None:
            changed[name] = F.col(name).cast("string")
    return df.withColumns(changed) if changed else df


def capped(value: Column, limit: int = 20_000) -> Column:
    """A struct that says whether a text was cut, with its preview and full size."""
    size = F.length(value)
    return F.struct(
        (size > limit).alias("truncated"),
        F.substring(value, 1, limit).alias("preview"),
        size.alias("full_size_chars"),
    )


def digest(columns: list[Column], algorithm: str = "sha256") -> Column:
    """md5, sha1 or sha256 of the columns' text, separated by a unit separator."""
    text = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    if algorithm == "md5":
        return F.md5(text)
    if algorithm == "sha1":
        return F.sha1(text)
    if algorithm == "sha256":
        return F.sha2(text, 256)
    raise ValueError("algorithm must be md5, sha1 or sha256")


def stable_bucket(key: Column, buckets: int = 100, seed: str = "") -> Column:
    """A repeatable bucket in 0..buckets-1 from a row key."""
    text = F.concat(F.lit(seed), key.cast("string")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % F.lit(buckets)
