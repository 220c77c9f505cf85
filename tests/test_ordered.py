"""The skew-safe paths must give what plain windows and brute force give."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gristmill.operators import joins
from gristmill.operators.ordered import exact_percentiles, neighbours, sequence, trailing
from gristmill.operators.rows import page_rows
from gristmill.operators.skew import Skew, heavy_keys, skew_join, slice_of, split_points

SPLIT = Skew(share=0.1, min_rows=50, slices=7, block_rows=11)
NEVER = Skew(min_rows=10**12)


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows; key 'hot' holds two thirds of them, values repeat, some are null."""
    chance = random.Random(3)
    start = datetime(2024, 1, 1)
    data = []
    for i in range(900):
        key = "hot" if i % 3 else f"k{i % 17}"
        value = None if i % 29 == 0 else float(chance.randint(0, 40))
        data.append((i, key, value, start + timedelta(minutes=chance.randint(0, 20_000))))
    return spark.createDataFrame(data, "id long, k string, v double, ts timestamp_ntz").repartition(4).cache()


def same(left, right):
    def key(row):
        return tuple((x is None, x) for x in row)

    a = sorted((tuple(r) for r in left.collect()), key=key)
    b = sorted((tuple(r) for r in right.select(left.columns).collect()), key=key)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for m, n in zip(x, y):
            assert m == pytest.approx(n, nan_ok=True) if isinstance(m, float) else m == n


def test_heavy_keys_are_found(skewed, monkeypatch):
    from gristmill.operators import skew

    (pieces,) = heavy_keys(skewed, ["k"], SPLIT).values()
    assert pieces == 7
    assert heavy_keys(skewed, ["k"], NEVER) == {}
    monkeypatch.setattr(skew, "SAMPLE_ROWS", 300)
    assert len(heavy_keys(skewed, ["k"], SPLIT)) == 1


@pytest.mark.parametrize("count", [1, 2, 7, 50])
def test_slices_follow_the_order(skewed, count):
    points = split_points(skewed, ["v", "id"], count)
    sliced = skewed.select("v", "id", slice_of(skewed, ["v", "id"], points).alias("s")).toPandas()
    for row in sliced.dropna().itertuples():
        assert row.s == sum(p < (row.v, row.id) for p in points)
    assert set(sliced[sliced.v.isna()].s) <= {0}


RANKS = {
    "a": ("rank",),
    "b": ("dense_rank",),
    "c": ("percent_rank",),
    "d": ("cume_dist",),
    "e": ("total_sum", "id"),
    "f": ("total_count",),
}
POSITIONS = {
    "a": ("row_number",),
    "b": ("ntile", 4),
    "c": ("running_sum", "v"),
    "d": ("first", "v"),
    "e": ("last", "v"),
    "f": ("nth", "v", 3),
    "g": ("nth", "v", 10_000),
}


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("keys", [["k"], []])
def test_ranks(skewed, keys, direction):
    order = [("v", direction)]
    same(sequence(skewed, keys, order, RANKS, SPLIT), sequence(skewed, keys, order, RANKS, NEVER))


@pytest.mark.parametrize("order", [[("ts", "asc"), ("id", "asc")], [("v", "desc"), ("id", "asc")]])
@pytest.mark.parametrize("keys", [["k"], []])
def test_positions(skewed, keys, order):
    same(
        sequence(skewed, keys, order, POSITIONS, SPLIT),
        sequence(skewed, keys, order, POSITIONS, NEVER),
    )


def test_mixed_kinds_with_ties(skewed):
    order, wanted = [("v", "asc")], {"a": ("rank",), "b": ("dense_rank",), "c": ("cume_dist",), "d": ("percent_rank",), "e": ("ntile", 1)}
    same(sequence(skewed, ["k"], order, wanted, SPLIT), sequence(skewed, ["k"], order, wanted, NEVER))


def test_one_sort_value_may_hold_every_row(spark):
    df = spark.range(600).select(F.lit("x").alias("k"), F.lit(1.0).alias("v"), "id")
    order = [("v", "asc"), ("id", "asc")]
    wanted = {"n": ("row_number",)}
    found = sequence(df, ["k"], order, wanted, SPLIT)
    assert sorted((r["id"] + 1, r["n"]) for r in found.collect()) == [(i, i) for i in range(1, 601)]


def test_string_order_and_fill(skewed):
    order = [("k", "asc"), ("id", "asc")]
    wanted = {"n": ("row_number",), "filled": ("fill_last", "v")}
    same(sequence(skewed, [], order, wanted, SPLIT), sequence(skewed, [], order, wanted, NEVER))


def test_neighbours(skewed):
    order = [("ts", "asc"), ("id", "asc")]
    wanted = {
        "back": lambda w: F.lag("v", 2).over(w),
        "next": lambda w: F.lead("id", 3).over(w),
        "mean": lambda w: F.avg("v").over(w.rowsBetween(-4, 2)),
    }
    same(
        neighbours(skewed, ["k"], order, 4, 3, wanted, SPLIT),
        neighbours(skewed, ["k"], order, 4, 3, wanted, NEVER),
    )


def test_trailing(skewed):
    wanted = {"n": lambda w: F.count("v").over(w), "s": lambda w: F.sum("v").over(w)}
    same(
        trailing(skewed, ["k"], "ts", 3600, wanted, SPLIT),
        trailing(skewed, ["k"], "ts", 3600, wanted, NEVER),
    )


def test_percentiles_match_numpy(skewed):
    wanted = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    found = {r["k"]: r for r in exact_percentiles(skewed, ["k"], "v", wanted, Skew(0.1, 10, 5)).collect()}
    data = skewed.filter("v IS NOT NULL").toPandas()
    for key, group in data.groupby("k"):
        for name, p in wanted.items():
            assert found[key][name] == pytest.approx(np.quantile(group["v"], p))
    every = exact_percentiles(skewed, [], "v", {"m": 0.5}, Skew(0.1, 10, 5)).first()["m"]
    assert every == pytest.approx(np.quantile(data["v"], 0.5))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join(spark, skewed, how):
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4)], "k string, w long"
    )
    same(skew_join(skewed, right, ["k"], how, SPLIT), skewed.join(right, ["k"], how))


def test_full_and_right_join(spark, skewed):
    right = spark.createDataFrame([("hot", 1), ("k3", 3), ("zz", 4)], "k string, w long")
    same(joins.join_full(skewed, right, ["k"], SPLIT), skewed.join(right, ["k"], "full"))
    same(joins.join_right(right, skewed, ["k"], SPLIT), right.join(skewed, ["k"], "right"))


def test_asof_interval_theta(skewed):
    left = skewed.filter("id % 2 = 0").select("id", "k", "ts", "v")
    right = skewed.filter("id % 2 = 1").select("k", F.col("ts").alias("rts"), F.col("v").alias("rv"))
    lefts, rights = left.toPandas(), right.toPandas()
    found = {
        r["id"]: r["rts"]
        for r in joins.join_asof(left, right, ["k"], "ts", "rts", ["rts", "rv"], SPLIT).collect()
    }
    for row in lefts.itertuples():
        earlier = rights[(rights.k == row.k) & (rights.rts <= row.ts)].rts
        expected = None if earlier.empty else earlier.max()
        assert found[row.id] == expected
    timed = right.select("k", F.col("rts").alias("ts"), F.col("rv").alias("v"))
    counted = joins.interval_counts(left, timed, ["k"], "ts", 7200, "v", SPLIT)
    for row in counted.collect():
        near = rights[(rights.k == row["k"]) & (rights.rts <= row["ts"]) & (rights.rts >= row["ts"] - timedelta(hours=2))]
        assert row["matches"] == len(near)
    below = joins.theta_counts(left, timed, ["k"], "v", "v", "n", SPLIT)
    for row in below.collect():
        assert row["n"] == int(((rights.k == row["k"]) & (rights.rv < (row["v"] or 0))).sum())


def test_range_join(spark, skewed):
    bands = spark.createDataFrame([(0.0, 10.0, "a"), (10.0, 15.0, "b"), (12.0, 30.0, "c")], "lo double, hi double, b string")
    found = joins.range_join(skewed, bands, "v", "lo", "hi").groupBy("b").count()
    data = skewed.toPandas()
    expected = {b: int(((data.v >= lo) & (data.v < hi)).sum()) for lo, hi, b in ((0, 10, "a"), (10, 15, "b"), (12, 30, "c"))}
    assert {r["b"]: r["count"] for r in found.collect()} == expected


def test_set_operations_keep_every_copy(spark, monkeypatch):
    from gristmill.operators import sets

    monkeypatch.setattr(sets._repeat, "__defaults__", (7,))
    a = spark.createDataFrame([("x", None)] * 50 + [("y", 1)] * 3 + [(None, 2)], "col string, v long")
    b = spark.createDataFrame([("x", None)] * 20 + [("y", 1)] * 9, "col string, v long")
    same(sets.intersect_all(a, b), a.intersectAll(b))
    same(sets.except_all(a, b), a.exceptAll(b))
    same(sets.except_all(b, a), b.exceptAll(a))
    same(sets.intersect_rows(a, b), a.intersect(b))
    same(sets.except_rows(a, b), a.subtract(b))


def test_small_product_refuses_large_inputs(spark):
    assert joins.small_product(spark.range(3), spark.range(4).toDF("x")).count() == 12
    with pytest.raises(ValueError):
        joins.small_product(spark.range(2000), spark.range(2000).toDF("x"))


def test_pages_cover_the_table(spark, monkeypatch):
    from gristmill.operators import rows as row_ops

    df = spark.range(1000).withColumn("v", F.col("id") % 37)
    order = [("v", "desc"), ("id", "asc")]
    shallow = [r["id"] for o in range(0, 1000, 90) for r in page_rows(df, order, 90, o).collect()]
    monkeypatch.setattr(row_ops, "DEEP_OFFSET", 0)
    deep = [r["id"] for o in range(0, 1000, 90) for r in page_rows(df, order, 90, o).collect()]
    assert shallow == deep and sorted(deep) == list(range(1000))
    assert page_rows(df, order, 9999, 0).count() == df.count()


def test_top_k_is_cut_before_the_shuffle(skewed):
    window = Window.partitionBy("k").orderBy("id")
    ranked = skewed.withColumn("n", F.row_number().over(window)).filter("n <= 3")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_rows_without_a_time_stay_on_both_paths(spark):
    from gristmill.operators.ordered import trailing

    rows = spark.range(600).selectExpr(
        "id", "id % 3 AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE timestamp_seconds(id * 37 % 5000) END AS ts"
    )
    wanted = {"n": lambda w: F.count(F.lit(1)).over(w), "s": lambda w: F.sum("id").over(w)}
    plain = trailing(rows, ["k"], "ts", 300, wanted, Skew(min_rows=10**9))
    sliced = trailing(rows, ["k"], "ts", 300, wanted, Skew(min_rows=1, share=0.01))
    assert plain.count() == sliced.count() == 600
    assert sorted(map(str, plain.collect())) == sorted(map(str, sliced.collect()))


def test_bands_of_very_different_width(spark):
    facts = spark.range(500).selectExpr("id", "id * 0.75 AS v").unionByName(spark.sql("SELECT -1L AS id, CAST(NULL AS DECIMAL(20,2)) AS v"))
    bands = spark.createDataFrame([(0, -1e6, 1e6), (1, 10.0, 10.5), (2, 100.0, 200.0), (3, 5.0, 5.0), (4, 374.0, 1e300), (5, None, 1.0)], "band int, low double, high double")
    joined = joins.range_join(facts, bands, "v", "low", "high")
    found = sorted((r.id, r.band) for r in joined.collect())
    spans = {0: (-1e6, 1e6), 1: (10.0, 10.5), 2: (100.0, 200.0), 4: (374.0, 1e300)}
    assert found == sorted((i, b) for i in range(500) for b, (lo, hi) in spans.items() if lo <= i * 0.75 < hi)


def test_lookup_join_measures_bytes(spark):
    wide = spark.range(100).selectExpr("id", "repeat('x', 1000) AS t")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(joins.lookup_join(spark.range(10), wide, ["id"]))
    assert "broadcast" not in plan(joins.lookup_join(spark.range(10), wide, ["id"], max_bytes=50_000))


def test_a_range_join_without_bands_has_no_rows(spark):
    facts = spark.createDataFrame([(1, 2.0)], "k int, v double")
    bands = spark.createDataFrame([("flat", 1.0, 1.0)], "name string, low double, high double")
    for some in (bands, bands.limit(0)):
        found = joins.range_join(facts, some, "v", "low", "high")
        assert found.columns == ["k", "v", "name", "low", "high"] and found.count() == 0
