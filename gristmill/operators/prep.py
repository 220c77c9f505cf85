"""Cleaning and feature building."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.operators.merge import topk_per_group
from gristmill.operators.ordered import Order, exact_percentiles, sequence
from gristmill.operators.skew import DEFAULT, Skew, skew_join

MAX_CATEGORIES = 1_000


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("cleaning left no rows")
    return df


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and nulls per column, in one pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    )
    return counted.unpivot(["_rows"], columns, "name", "nulls").withColumnRenamed("_rows", "rows")


def target_distribution(df: DataFrame, target: str, limit: int | None = None) -> DataFrame:
    value = F.coalesce(F.col(target).cast("string"), F.lit("—")).alias("value")
    counted = df.groupBy(value).agg(F.count(F.lit(1)).alias("rows"))
    ranked = counted.orderBy(F.desc("rows"), "value")
    return ranked if limit is None else ranked.limit(limit)


def clean_dedupe(df: DataFrame, keys: list[str], order: Order) -> DataFrame:
    """One row per key: the first in the given order."""
    return topk_per_group(df, keys, order, 1)


def _fill_value(df: DataFrame, column: str, rule: str) -> Column:
    if rule == "median":
        return exact_percentiles(df, [], column, {"median": 0.5}).scalar()
    if rule == "mode":
        counted = df.filter(F.col(column).isNotNull()).groupBy(column).count()
        return counted.agg(F.min_by(column, F.struct(-F.col("count"), F.col(column)))).scalar()
    raise ValueError(f"unknown fill rule: {rule}")


def clean_nulls(df: DataFrame, rules: dict[str, object]) -> DataFrame:
    """Per column: ``drop``, ``mean``, ``median``, ``mode`` or ("constant", value)."""
    dropped = [c for c, rule in rules.items() if rule == "drop"]
    kept = df.na.drop(subset=dropped) if dropped else df
    averaged = [c for c, rule in rules.items() if rule == "mean"]
    if averaged:
        means = kept.agg(F.struct(*[F.avg(c).alias(c) for c in averaged])).scalar()
    filled = {}
    for column, rule in rules.items():
        if rule == "drop":
            continue
        if rule == "mean":
            value = means.getField(column)
        elif isinstance(rule, tuple) and rule[0] == "constant":
            value = F.lit(rule[1])
        else:
            value = _fill_value(kept, column, rule)
        filled[column] = F.coalesce(F.col(column), value)
    return kept.withColumns(filled) if filled else kept


def clean_types(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cast columns; a value that does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})


def type_failures(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    counts = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c)
        for c, kind in kinds.items()
    ]
    counted = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    return counted.unpivot(["_rows"], list(kinds), "name", "failures").withColumnRenamed(
        "_rows", "rows"
    )


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", reach: float | None = None) -> DataFrame:
    """One row (low, high): the IQR fence, or mean ± z sample deviations."""
    if method == "iqr":
        reach = 1.5 if reach is None else reach
        quartiles = exact_percentiles(df, [], column, {"q1": 0.25, "q3": 0.75})
        spread = (F.col("q3") - F.col("q1")) * reach
        return quartiles.select((F.col("q1") - spread).alias("low"), (F.col("q3") + spread).alias("high"))
    if method == "zscore":
        reach = 3.0 if reach is None else reach
        moments = df.agg(F.avg(column).alias("m"), F.stddev_samp(column).alias("s"))
        spread = F.col("s") * reach
        return moments.select((F.col("m") - spread).alias("low"), (F.col("m") + spread).alias("high"))
    raise ValueError("method must be iqr or zscore")


def clean_outliers(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    action: str = "drop",
    reach: float | None = None,
) -> DataFrame:
    """Drop or clip values outside the bounds; nulls are kept."""
    found = outlier_bounds(df, column, method, reach)
    bounds = found.select(F.struct("low", "high")).scalar()
    low, high, value = bounds.getField("low"), bounds.getField("high"), F.col(column)
    if action == "drop":
        return df.filter(value.isNull() | value.between(low, high))
    if action == "clip":
        clipped = F.when(value.isNotNull(), F.greatest(F.least(value, high), low))
        return df.withColumn(column, clipped)
    raise ValueError("action must be drop or clip")


# ---- features


def feat_ratio(a: str, b: str) -> Column:
    return F.try_divide(F.col(a), F.col(b))


def equal_width(df: DataFrame, column: str, buckets: int) -> Column:
    """Bucket 1..n of equal width between the column's smallest and largest value."""
    low, high = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    if low is None or low == high:
        return F.when(F.col(column).isNotNull(), F.lit(1))
    bucket = F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(buckets))
    return F.least(bucket, F.lit(buckets))


def quantile_bucket(
    df: DataFrame, order: Order, buckets: int, name: str, skew: Skew = DEFAULT
) -> DataFrame:
    """Buckets with equally many rows, by position in a total order."""
    return sequence(df, [], order, {name: ("ntile", buckets)}, skew)


def feat_dateparts(column: str, since: str) -> dict[str, Column]:
    return {
        f"{column}_month": F.month(column),
        f"{column}_weekday": F.dayofweek(column),
        f"{column}_days": F.datediff(F.to_date(F.lit(since)), F.col(column)),
    }


def ordinal_encode(df: DataFrame, column: str, name: str, skew: Skew = DEFAULT) -> DataFrame:
    """Codes 0, 1, … by sorted value; null stays null."""
    values = df.select(column).filter(F.col(column).isNotNull()).distinct()
    codes = sequence(values, [], [(column, "asc")], {"_place": ("row_number",)}, skew)
    coded = skew_join(df, codes, [column], "left", skew)
    return coded.withColumn(name, F.col("_place") - 1).drop("_place").select(*df.columns, name)


def one_hot(df: DataFrame, column: str) -> DataFrame:
    """A 0/1 column per category; refuses more than 1000 categories."""
    found = df.select(column).filter(F.col(column).isNotNull()).distinct()
    values = sorted(row[0] for row in found.limit(MAX_CATEGORIES + 1).collect())
    if len(values) > MAX_CATEGORIES:
        raise ValueError(f"{column} has more than {MAX_CATEGORIES} categories")
    flags = {
        f"{column}_{v}": F.when(F.col(column) == F.lit(v), 1).otherwise(0) for v in values
    }
    return df.withColumns(flags)


def feature_table(
    df: DataFrame, features: dict[str, Column], target: str, keep: list[str]
) -> DataFrame:
    """Kept columns, features and the target, which must come through unchanged."""
    if target in features:
        raise ValueError(f"features may not overwrite the target '{target}'")
    return df.select(*keep, *[c.alias(n) for n, c in features.items()], target)


def check_target(before: DataFrame, after: DataFrame, target: str) -> None:
    """Raise unless the target has the same values in both tables (as a multiset)."""
    if target not in after.columns:
        raise ValueError(f"target '{target}' is missing from the feature table")

    def mark(df: DataFrame):
        hashed = F.xxhash64(F.col(target).cast("string")).cast(T.DecimalType(38, 0))
        return tuple(df.agg(F.count(F.lit(1)), F.sum(hashed)).first())

    if mark(before) != mark(after):
        raise ValueError(f"target '{target}' was changed by the feature step")
