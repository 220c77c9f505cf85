"""Finding heavy keys and splitting the work they cause.

Heavy keys are found in a sample of the key columns. The sample only steers the
physical plan: every operator returns the same rows whatever it reports.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH = "_key_hash"
SAMPLE_ROWS = 20_000_000


@dataclass(frozen=True)
class Skew:
    """When a key is heavy, and into how many pieces its rows are cut.

    A key is heavy from ``share`` of the rows on, but not below ``min_rows`` rows; its
    rows are cut into pieces of about that size.
    """

    share: float = 0.0001
    min_rows: int = 1_000_000
    slices: int = 10_000
    block_rows: int = 100_000


DEFAULT = Skew()


def key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys]) if keys else F.lit(0).cast("long")


def heavy_keys(
    df: DataFrame, keys: list[str], skew: Skew = DEFAULT, rows: int | None = None
) -> dict[int, int]:
    """Hash of each heavy key and the number of pieces for it (at most 1/share keys).

    A small table is answered by its row count alone, which the caller may know.
    """
    rows = df.count() if rows is None else rows
    if rows < skew.min_rows:
        return {}
    size = max(skew.min_rows, skew.share * rows)

    def pieces(of: float) -> int:
        return min(skew.slices, max(2, ceil(of / size)))

    if not keys:
        return {0: pieces(rows)}
    fraction = min(1.0, SAMPLE_ROWS / rows)
    hashed = df.select(key_hash(keys).alias(HASH))
    if fraction < 1:
        hashed = hashed.sample(fraction=fraction, seed=11)
    counted = hashed.groupBy(HASH).count().filter(F.col("count") >= size * fraction)
    return {row[HASH]: pieces(row["count"] / fraction) for row in counted.collect()}


def with_pieces(df: DataFrame, keys: list[str], heavy: dict[int, int]) -> DataFrame:
    """Add ``_pieces``: how many pieces a row's key is cut into, 1 for ordinary keys."""
    table = df.sparkSession.createDataFrame(list(heavy.items()), f"{HASH} long, _pieces long")
    hashed = df.withColumn(HASH, key_hash(keys))
    # At most 1/share rows.
    joined = hashed.join(F.broadcast(table), [HASH], "left").drop(HASH)
    return joined.withColumn("_pieces", F.coalesce("_pieces", F.lit(1).cast("long")))


def split_heavy(
    df: DataFrame, keys: list[str], heavy: dict[int, int]
) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of ordinary keys, rows of heavy keys); None where a part is empty."""
    if not heavy:
        return df, None
    if not keys:
        return None, df
    is_heavy = key_hash(keys).isin(list(heavy))
    return df.filter(~is_heavy), df.filter(is_heavy)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "inner",
    skew: Skew = DEFAULT,
    heavy: dict[int, int] | None = None,
) -> DataFrame:
    """Equi join whose heavy left keys are spread over several tasks.

    Every heavy left row gets a salt, and the matching right rows are repeated once per
    salt, for the heavy keys only. ``right`` must not be the preserved side, so ``how``
    is inner, left, left_semi or left_anti. ``heavy`` passes keys found earlier and
    saves the look at ``left``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join does not preserve the right side: {how}")
    heavy = heavy_keys(left, on, skew) if heavy is None else heavy
    if not heavy:
        return left.join(right, on, how)
    # The partition number spreads equal rows too, and does not change on a retry.
    content = F.xxhash64(F.spark_partition_id(), *[F.col(c) for c in left.columns])
    salted_left = with_pieces(left.withColumn("_content", content), on, heavy)
    salted_left = salted_left.withColumn("_salt", F.pmod("_content", "_pieces"))
    copies = F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)
    salted_right = with_pieces(right, on, heavy).withColumn("_salt", F.explode(copies))
    joined = salted_left.drop("_content", "_pieces").join(
        salted_right.drop("_pieces"), [*on, "_salt"], how
    )
    return joined.drop("_salt")


def split_points(df: DataFrame, columns: list[str], pieces: int, rows: int | None = None) -> list:
    """Tuples that cut the table, sorted by ``columns``, into roughly equal pieces.

    They come from a bounded sample; a bad sample makes uneven pieces, never a
    different result.
    """
    rows = df.count() if rows is None else rows
    wanted = pieces * 50
    sample = df.select(*columns).na.drop()
    if rows > wanted:
        sample = sample.sample(fraction=min(1.0, wanted / rows), seed=7)
    values = sorted(tuple(row) for row in sample.limit(2 * wanted).collect())
    step = max(1, len(values) // pieces)
    return sorted(set(values[step::step]))


def slice_of(df: DataFrame, columns: list[str], points: list, descending: bool = False) -> Column:
    """Index of the piece a row falls into, increasing in sort order.

    The points are searched in two steps, first among every n-th, then between two of
    those, so 10 000 points cost about 200 comparisons.
    """
    if not points:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in df.select(*columns).schema}
    here = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])

    def literal(point: tuple) -> Column:
        parts = [F.lit(v).cast(kinds[c]).alias(f"c{i}") for i, (c, v) in enumerate(zip(columns, point))]
        return F.struct(*parts)

    def below(bounds: Column) -> Column:
        return F.size(F.filter(bounds, lambda point: point < here))

    step = max(1, ceil(len(points) ** 0.5))
    groups = [points[i : i + step] for i in range(0, len(points), step)]
    # A group's first point decides whether the row lies in that group or a later one.
    first = below(F.array(*[literal(g[0]) for g in groups]))
    group = F.greatest(first, F.lit(1))
    within = below(F.element_at(F.array(*[F.array(*map(literal, g)) for g in groups]), group))
    passed = (group - 1) * step + within
    return -passed if descending else passed
