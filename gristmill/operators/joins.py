"""Joins Spark has no keyword for, and size-checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.ordered import sequence, trailing
from gristmill.operators.skew import DEFAULT, Skew, skew_join

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 << 20
MAX_PAIRS = 1_000_000
MAX_PACKED = 10_000


def is_bounded(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most ``rows`` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    fact: DataFrame,
    dimension: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    skew: Skew = DEFAULT,
) -> DataFrame:
    """Broadcast the dimension when its rows and bytes are counted and small, else a salted
    shuffle join. Rows are measured as JSON text, which is larger than they are."""
    row = F.octet_length(F.to_json(F.struct(*[F.col(c) for c in dimension.columns])))
    size = dimension.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).alias("bytes")).first()
    if size["rows"] <= max_rows and (size["bytes"] or 0) <= max_bytes:
        return fact.join(F.broadcast(dimension), on, how)
    return skew_join(fact, dimension, on, how, skew)


def small_product(left: DataFrame, right: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """All pairs of two small tables; refuses inputs whose product is not small.

    The right rows travel as one array value beside each left row.
    """
    rights = right.limit(MAX_PACKED + 1).count()
    if rights > MAX_PACKED or not is_bounded(left, max_pairs // max(rights, 1)):
        raise ValueError(f"the product may exceed {max_pairs} pairs or {MAX_PACKED} right rows")
    packed = right.agg(F.collect_list(F.struct(*[F.col(c) for c in right.columns])))
    return left.withColumn("_right", F.explode(packed.scalar())).select(
        *left.columns, "_right.*"
    )


def join_asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_time: str,
    right_time: str,
    take: list[str],
    skew: Skew = DEFAULT,
) -> DataFrame:
    """For each left row, ``take`` of the latest right row at or before its time.

    Both sides are stacked and the last right row is carried forward: one shuffle by
    key and no pairs. Left rows without an earlier right row get nulls.
    """
    payload = F.struct(*[F.col(c) for c in take])
    lefts = left.select(
        *keys,
        F.col(left_time).alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    rights = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), payload.alias("_right")
    )
    stacked = rights.unionByName(lefts, allowMissingColumns=True)
    filled = sequence(
        stacked,
        keys,
        [("_at", "asc"), ("_side", "asc")],
        {"_found": ("fill_last", "_right")},
        skew,
    )
    matched = filled.filter(F.col("_side") == 1)
    return matched.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in take])


def interval_counts(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    time: str,
    seconds: int,
    value: str,
    skew: Skew = DEFAULT,
) -> DataFrame:
    """For each left row, how many right rows of its key lie in the ``seconds`` up to
    its time, and the sum of their ``value``. No pair is ever formed."""
    marked = left.withColumn("_from_left", F.lit(True)).unionByName(
        right.withColumn("_from_left", F.lit(False)), allowMissingColumns=True
    )
    from_right = ~F.col("_from_left")
    counted = trailing(
        marked,
        keys,
        time,
        seconds,
        {
            "matches": lambda w: F.count(F.when(from_right, F.lit(1))).over(w),
            "match_value": lambda w: F.sum(F.when(from_right, F.col(value))).over(w),
        },
        skew,
    )
    return counted.filter("_from_left").drop("_from_left")


def range_join(
    facts: DataFrame, bands: DataFrame, value: str, low: str, high: str
) -> DataFrame:
    """Facts with the bands that hold their value (low <= value < high).

    Bands are sorted by the power of two above their width. Each power has a grid of its
    own, on which a band covers at most two cells and a fact lies in one; powers without
    bands have none. The join is an equi join on the cell, salted where many facts share
    one, as they do below a very wide band.
    """
    held = bands.filter(F.col(high) > F.col(low))
    power = F.ceil(F.log2((F.col(high) - F.col(low)).cast("double"))).cast("int")
    powers = sorted(row[0] for row in held.select(power).distinct().collect())
    powers = powers or [0]  # without a band of any width nothing is joined

    def cell(column: str):
        return F.floor(F.col(column).cast("double") / F.pow(F.lit(2.0), F.col("_power")))

    cells = held.withColumn("_power", power).withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    placed = facts.withColumn("_power", F.explode(F.array(*map(F.lit, powers)))).withColumn("_cell", cell(value))
    joined = skew_join(placed, cells, ["_power", "_cell"])
    return joined.filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(high))).drop("_power", "_cell")


def theta_counts(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_value: str,
    right_value: str,
    name: str,
    skew: Skew = DEFAULT,
) -> DataFrame:
    """For each left row, how many right rows have a smaller value (and the same keys).

    An inequality join followed by a count, answered by one running sum over both
    sides in value order.
    """
    lefts = left.select(
        *keys,
        F.col(left_value).cast("double").alias("_value"),
        F.lit(0).alias("_side"),
        F.lit(0).cast("long").alias("_one"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    # Equal right values are combined first: the running sum sees one row per value.
    rights = (
        right.filter(F.col(right_value).isNotNull())
        .groupBy(*keys, F.col(right_value).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_one"))
        .withColumn("_side", F.lit(1))
    )
    stacked = lefts.unionByName(rights, allowMissingColumns=True)
    summed = sequence(
        stacked,
        keys,
        [("_value", "asc"), ("_side", "asc")],
        {name: ("running_sum", "_one")},
        skew,
        derived=True,
    )
    return summed.filter(F.col("_side") == 0).select("_left.*", name)


def join_right(left: DataFrame, right: DataFrame, on: list[str], skew: Skew = DEFAULT) -> DataFrame:
    """Keep every right row: a left join with the sides swapped."""
    joined = skew_join(right, left, on, "left", skew)
    others = [c for c in left.columns if c not in on] + [c for c in right.columns if c not in on]
    return joined.select(*on, *others)


def join_full(left: DataFrame, right: DataFrame, on: list[str], skew: Skew = DEFAULT) -> DataFrame:
    """Keep both sides; heavy left keys are salted, so the join is built from two parts."""
    kept = skew_join(left, right, on, "left", skew)
    missing = skew_join(right, left.select(*on).distinct(), on, "left_anti", skew)
    return kept.unionByName(missing, allowMissingColumns=True)


