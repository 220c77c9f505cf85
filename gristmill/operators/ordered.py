"""Window computations that stay parallel when one key holds most of the rows.

Ordinary keys use a plain ``Window``: one shuffle by key. Rows of heavy keys are
cut into slices along the sort order; each slice is computed on its own and then
shifted by what the earlier slices of the key contribute. That carry table has one
row per slice, and the number of slices is bounded by construction.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.skew import (
    DEFAULT,
    Skew,
    heavy_keys,
    skew_join,
    slice_of,
    split_heavy,
    split_points,
    with_pieces,
)
from gristmill.scratch import cut_lineage

Order = list[tuple[str, str]]
Spec = tuple

_NEEDS_TOTAL = {"ntile", "percent_rank", "cume_dist", "last", "total_count"}
_BY_VALUE = {"rank", "dense_rank", "percent_rank", "cume_dist", "total_count"}
_NEEDS_POSITION = {"row_number", "ntile", "first", "last", "nth"}


def sort_columns(order: Order) -> list[Column]:
    """Ascending puts nulls first, descending puts them last."""
    return [F.col(c).desc() if d == "desc" else F.col(c).asc() for c, d in order]


def cut_columns(order: Order) -> tuple[list[str], bool]:
    """The leading sort columns of one direction: what a table can be cut along."""
    direction = order[0][1]
    cut = []
    for column, d in order:
        if d != direction:
            break
        cut.append(column)
    return cut, direction == "desc"


def _ntile(position: Column, total: Column, buckets: int) -> Column:
    size = F.floor(total / buckets)
    larger = total % buckets
    edge = larger * (size + 1)
    return F.when(position <= edge, F.floor((position - 1) / (size + 1)) + 1).otherwise(
        larger + F.floor((position - 1 - edge) / F.nullif(size, F.lit(0))) + 1
    )


def _plain(df: DataFrame, keys: list[str], order: Order, wanted: dict[str, Spec]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    whole = window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    group = Window.partitionBy(*keys)
    built = {}
    for name, (kind, *args) in wanted.items():
        if kind in ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist"):
            built[name] = getattr(F, kind)().over(window)
        elif kind == "ntile":
            built[name] = F.ntile(args[0]).over(window)
        elif kind == "running_sum":
            built[name] = F.sum(args[0]).over(upto)
        elif kind == "fill_last":
            built[name] = F.last(args[0], ignorenulls=True).over(upto)
        elif kind == "total_sum":
            built[name] = F.sum(args[0]).over(group)
        elif kind == "total_count":
            built[name] = F.count(F.lit(1)).over(group)
        elif kind == "first":
            built[name] = F.first(args[0]).over(whole)
        elif kind == "last":
            built[name] = F.last(args[0]).over(whole)
        elif kind == "nth":
            built[name] = F.nth_value(args[0], args[1]).over(whole)
        else:
            raise ValueError(f"unknown window computation: {kind}")
    return df.withColumns(built)


def _sliced(
    df: DataFrame,
    keys: list[str],
    order: Order,
    wanted: dict[str, Spec],
    found: dict[int, int],
) -> DataFrame:
    cut, descending = cut_columns(order)
    most = max(found.values())
    points = split_points(df, cut, most)
    # A key gets as many slices as its size asks for, so all keys together have at most
    # 1/share slices plus one per key.
    fine = slice_of(df, cut, points, descending)
    sliced = with_pieces(df, keys, found).withColumn(
        "_slice", F.floor(fine * F.col("_pieces") / F.lit(len(points) + 1))
    ).drop("_pieces")
    parts = keys + ["_slice"]
    kinds = {spec[0] for spec in wanted.values()}

    summary = {"_rows": F.count(F.lit(1))}
    if "dense_rank" in kinds:
        summary["_steps"] = F.count_distinct(F.struct(*[F.col(c) for c, _ in order]))
    for name, (kind, *args) in wanted.items():
        if kind in ("running_sum", "total_sum"):
            summary[f"_sum_{name}"] = F.sum(args[0])
        elif kind == "fill_last":
            if any(d == "desc" for _, d in order):
                raise ValueError("fill_last needs an ascending order")
            place = F.when(F.col(args[0]).isNotNull(), F.struct(*[F.col(c) for c, _ in order]))
            summary[f"_tail_{name}"] = F.max_by(F.col(args[0]), place)
    totals = sliced.groupBy(*parts).agg(*[c.alias(n) for n, c in summary.items()])

    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_rows_before": F.coalesce(F.sum("_rows").over(earlier), F.lit(0))}
    if kinds & _NEEDS_TOTAL:
        carried["_rows_all"] = F.sum("_rows").over(group)
    if "dense_rank" in kinds:
        carried["_steps_before"] = F.coalesce(F.sum("_steps").over(earlier), F.lit(0))
    for name, (kind, *args) in wanted.items():
        if kind == "running_sum":
            carried[f"_before_{name}"] = F.sum(f"_sum_{name}").over(earlier)
        elif kind == "total_sum":
            carried[f"_all_{name}"] = F.sum(f"_sum_{name}").over(group)
        elif kind == "fill_last":
            carried[f"_before_{name}"] = F.last(f"_tail_{name}", ignorenulls=True).over(earlier)
    carry = totals.withColumns(carried).select(*parts, *carried)
    carry = carry.select(*[F.col(c).alias(f"_c{c}") if c in parts else F.col(c) for c in carry.columns])
    matches = F.lit(True)
    for part in parts:
        matches = matches & F.col(part).eqNullSafe(F.col(f"_c{part}"))
    # One row per slice, at most 2/share rows whatever the size of the input.
    joined = sliced.join(F.broadcast(carry), matches).drop(*[f"_c{p}" for p in parts])

    window = Window.partitionBy(*parts).orderBy(*sort_columns(order))
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    peers = window.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("_rows_before")
    total = F.col("_rows_all")
    if kinds & _NEEDS_POSITION:
        joined = joined.withColumn("_position", F.row_number().over(window) + before)
    built = {}
    for name, (kind, *args) in wanted.items():
        if kind == "row_number":
            built[name] = F.col("_position").cast("int")
        elif kind == "rank":
            built[name] = (F.rank().over(window) + before).cast("int")
        elif kind == "dense_rank":
            built[name] = (F.dense_rank().over(window) + F.col("_steps_before")).cast("int")
        elif kind == "percent_rank":
            built[name] = F.when(total == 1, F.lit(0.0)).otherwise(
                (F.rank().over(window) + before - 1) / F.nullif(total - 1, F.lit(0))
            )
        elif kind == "cume_dist":
            built[name] = (F.count(F.lit(1)).over(peers) + before) / total
        elif kind == "ntile":
            built[name] = _ntile(F.col("_position"), total, args[0]).cast("int")
        elif kind == "running_sum":
            here, past = F.sum(args[0]).over(upto), F.col(f"_before_{name}")
            built[name] = F.when(past.isNull(), here).otherwise(
                past + F.coalesce(here, F.lit(0))
            )
        elif kind == "fill_last":
            here = F.last(args[0], ignorenulls=True).over(upto)
            built[name] = F.coalesce(here, F.col(f"_before_{name}"))
        elif kind == "total_sum":
            built[name] = F.col(f"_all_{name}")
        elif kind == "total_count":
            built[name] = total
        elif kind in ("first", "last", "nth"):
            continue
        else:
            raise ValueError(f"unknown window computation: {kind}")
    result = joined.withColumns(built)
    for name, (kind, *args) in wanted.items():
        if kind not in ("first", "last", "nth"):
            continue
        at = F.col("_rows_all") if kind == "last" else F.lit(args[1] if kind == "nth" else 1)
        picked = joined.filter(F.col("_position") == at).select(
            *[F.col(k).alias(f"_p{k}") for k in keys], F.col(args[0]).alias(name)
        )
        matches = F.lit(True)
        for key in keys:
            matches = matches & F.col(key).eqNullSafe(F.col(f"_p{key}"))
        # One row per heavy key.
        result = result.join(F.broadcast(picked), matches, "left").drop(*[f"_p{k}" for k in keys])
    return result.select(*df.columns, *wanted)


def _by_value(
    df: DataFrame, keys: list[str], order: Order, wanted: dict[str, Spec], skew: Skew
) -> DataFrame:
    """Ranks of heavy keys: they depend on the sort value only, so equal values are
    counted first, the counts are accumulated, and the ranks are looked up again."""
    values = [c for c, _ in order]
    match = F.struct(*[F.col(c) for c in [*keys, *values]])
    counts = df.groupBy(*keys, *values).agg(F.count(F.lit(1)).alias("_n"))
    placed = sequence(
        counts,
        keys,
        order,
        {
            "_upto": ("running_sum", "_n"),
            "_place": ("row_number",),
            "_all": ("total_sum", "_n"),
        },
        skew,
        derived=True,
    )
    first = F.col("_upto") - F.col("_n") + 1
    total = F.col("_all")
    built = {
        "rank": first.cast("int"),
        "dense_rank": F.col("_place").cast("int"),
        "percent_rank": F.coalesce(F.try_divide(first - 1, total - 1), F.lit(0.0)),
        "cume_dist": F.col("_upto") / total,
        "total_count": total,
    }
    ranks = placed.select(
        match.alias("_match"), *[built[spec[0]].alias(name) for name, spec in wanted.items()]
    )
    joined = skew_join(df.withColumn("_match", match), ranks, ["_match"], "inner", skew)
    return joined.select(*df.columns, *wanted)


def sequence(
    df: DataFrame,
    keys: list[str],
    order: Order,
    wanted: dict[str, Spec],
    skew: Skew = DEFAULT,
    derived: bool = False,
) -> DataFrame:
    """Add ordered-window columns; ``wanted`` maps a name to (kind, arguments).

    Kinds: row_number, rank, dense_rank, percent_rank, cume_dist, ntile(k),
    running_sum(col), fill_last(col), total_sum(col), total_count, first(col),
    last(col), nth(col, k). No keys means one sequence over the whole table.

    ``derived`` says that ``df`` is costly to compute: if it is large it is first kept in
    the shared folder, because several passes follow.
    """
    rows = df.count() if derived else None
    if rows is not None and rows >= skew.min_rows:
        df = cut_lineage(df)
    found = heavy_keys(df, keys, skew, rows)
    ordinary, heavy = split_heavy(df, keys, found)
    pieces = []
    if ordinary is not None:
        pieces.append(_plain(ordinary, keys, order, wanted))
    if heavy is not None:
        by_value = {spec[0] for spec in wanted.values()} <= _BY_VALUE
        if by_value:
            pieces.append(_by_value(heavy, keys, order, wanted, skew))
        else:
            pieces.append(_sliced(heavy, keys, order, wanted, found))
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: Order,
    before: int,
    after: int,
    wanted: dict[str, Callable],
    skew: Skew = DEFAULT,
) -> DataFrame:
    """Row-offset windows (lag, lead, moving frames) reaching at most ``before`` rows
    back and ``after`` rows ahead. ``wanted`` maps a name to a function of the window.

    Heavy keys are cut into blocks of consecutive rows; the rows a neighbouring block
    needs are copied into it and dropped again afterwards.
    """
    ordinary, heavy = split_heavy(df, keys, heavy_keys(df, keys, skew))
    pieces = []
    if ordinary is not None:
        window = Window.partitionBy(*keys).orderBy(*sort_columns(order))
        pieces.append(ordinary.withColumns({n: f(window) for n, f in wanted.items()}))
    if heavy is not None:
        block = max(skew.block_rows, before + after + 1)
        placed = sequence(heavy, keys, order, {"_position": ("row_number",)}, skew)
        index = F.col("_position").cast("long") - 1
        home, offset = F.floor(index / block), index % block
        copies = F.array(
            home,
            F.when(offset >= block - before, home + 1),
            F.when((offset < after) & (home > 0), home - 1),
        )
        spread = placed.withColumn("_home", home).withColumn(
            "_block", F.explode(F.filter(copies, lambda b: b.isNotNull()))
        )
        window = Window.partitionBy(*keys, "_block").orderBy("_position")
        computed = spread.withColumns({n: f(window) for n, f in wanted.items()})
        pieces.append(
            computed.filter(F.col("_block") == F.col("_home")).select(*df.columns, *wanted)
        )
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def trailing(
    df: DataFrame,
    keys: list[str],
    time: str,
    seconds: int,
    wanted: dict[str, Callable],
    skew: Skew = DEFAULT,
) -> DataFrame:
    """Range windows over the last ``seconds`` up to and including each row's time.

    Heavy keys are cut into time slices as long as the range; each row is copied
    into the next slice where it can still be in range. Rows without a time are in range
    of each other only and have a slice of their own.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    reach = int(seconds) * 1_000_000
    ordinary, heavy = split_heavy(df, keys, heavy_keys(df, keys, skew))
    pieces = []
    if ordinary is not None:
        timed = ordinary.withColumn("_micros", micros)
        window = Window.partitionBy(*keys).orderBy("_micros").rangeBetween(-reach, 0)
        pieces.append(
            timed.withColumns({n: f(window) for n, f in wanted.items()}).drop("_micros")
        )
    if heavy is not None:
        timed = heavy.withColumn("_micros", micros)
        home = F.coalesce(F.floor(F.col("_micros") / reach), F.lit(-(1 << 62)))
        spread = timed.withColumn("_home", home).withColumn(
            "_slice", F.explode(F.array(home, home + 1))
        )
        window = Window.partitionBy(*keys, "_slice").orderBy("_micros").rangeBetween(-reach, 0)
        computed = spread.withColumns({n: f(window) for n, f in wanted.items()})
        pieces.append(
            computed.filter(F.col("_slice") == F.col("_home")).select(*df.columns, *wanted)
        )
    return pieces[0] if len(pieces) == 1 else pieces[0].unionByName(pieces[1])


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    column: str,
    wanted: dict[str, float],
    skew: Skew = DEFAULT,
) -> DataFrame:
    """Exact interpolated percentiles per key without gathering a group in one task.

    Values are counted first, the counts are accumulated in value order, and only the
    two values around each percentile's position survive.
    """
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(*keys, F.col(column).cast("double").alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    ranked = sequence(
        counts,
        keys,
        [("_value", "asc")],
        {"_upto": ("running_sum", "_count"), "_all": ("total_sum", "_count")},
        skew,
        derived=True,
    )
    start = F.col("_upto") - F.col("_count")
    picks = [F.max("_all").alias("_all")]
    for index, fraction in enumerate(wanted.values()):
        spot = F.lit(float(fraction)) * (F.col("_all") - 1)
        for side, place in (("low", F.floor(spot)), ("high", F.ceil(spot))):
            here = (start <= place) & (place < F.col("_upto"))
            picks.append(F.max(F.when(here, F.col("_value"))).alias(f"_{side}{index}"))
    found = ranked.groupBy(*keys).agg(*picks)
    result = []
    for index, (name, fraction) in enumerate(wanted.items()):
        spot = F.lit(float(fraction)) * (F.col("_all") - 1)
        low, high = F.col(f"_low{index}"), F.col(f"_high{index}")
        result.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return found.select(*keys, *result)
