"""Catalog aggregates, grouping forms, percentiles, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import aggregate as agg
from gristmill.operators.ordered import exact_percentiles
from gristmill.plans.federation import federate_views
from gristmill.suite.registry import Tables, query, r, register


def _rounded(frame):
    return frame.withColumn("value", r("value", 4))


def _metric(name: str, metric: str, field: str | None) -> None:
    value = "count(*)" if field is None else f"{metric}({field})"
    register(
        f"agg_{name}",
        lambda t: _rounded(agg.aggregate(t.orders, metric, field, "o_orderpriority")),
        f"""SELECT coalesce(CAST(o_orderpriority AS VARCHAR), '—') AS "group",
            round(coalesce(CAST({value} AS DOUBLE), 0.0), 4) AS value, CAST(count(*) AS BIGINT) AS rows
        FROM orders GROUP BY 1""",
    )


_metric("count", "count", None)
_metric("sum", "sum", "o_totalprice")
_metric("avg", "avg", "o_totalprice")
_metric("min", "min", "o_totalprice")
_metric("max", "max", "o_totalprice")


@query(
    "agg_null_group",
    """
    SELECT coalesce(g, '—') AS "group", round(coalesce(CAST(sum(v) AS DOUBLE), 0.0), 4) AS value, CAST(count(*) AS BIGINT) AS rows
    FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS g,
                 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders)
    GROUP BY 1
    """,
)
def _(t: Tables):
    holed = t.orders.select(
        F.expr("CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END").alias("g"),
        F.expr("CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice END").alias("v"),
    )
    return _rounded(agg.aggregate(holed, "sum", "v", "g"))


@query(
    "agg_many_groups",
    """SELECT coalesce(CAST(o_custkey AS VARCHAR), '—') AS "group", round(sum(o_totalprice), 4) AS value,
           CAST(count(*) AS BIGINT) AS rows FROM orders GROUP BY 1""",
)
def _(t: Tables):
    return _rounded(agg.aggregate(t.orders, "sum", "o_totalprice", "o_custkey"))


@query(
    "agg_all",
    """SELECT 'all' AS "group", round(CAST(avg(o_totalprice) AS DOUBLE), 4) AS value, CAST(count(*) AS BIGINT) AS rows
    FROM orders""",
)
def _(t: Tables):
    return _rounded(agg.aggregate(t.orders, "avg", "o_totalprice"))


WRAPPED = "SELECT o_orderstatus, o_custkey, sum(o_totalprice) AS revenue FROM orders GROUP BY o_orderstatus, o_custkey"


@query(
    "agg_wrapped_query",
    f"""SELECT o_orderstatus AS "group", round(max(revenue), 4) AS value, CAST(count(*) AS BIGINT) AS rows
    FROM ({WRAPPED}) q GROUP BY 1""",
)
def _(t: Tables):
    wrapped = federate_views(t.spark, WRAPPED, {"orders": t.path("orders")})
    return _rounded(agg.aggregate(wrapped, "max", "revenue", "o_orderstatus"))


@query("distinct_rows", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def _(t: Tables):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query(
    "count_distinct",
    """SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts,
        CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers FROM lineitem GROUP BY l_returnflag""",
)
def _(t: Tables):
    flags = t.lineitem.groupBy("l_returnflag")
    return flags.agg(
        F.count_distinct("l_partkey").alias("parts"),
        F.count_distinct("l_suppkey").alias("suppliers"),
    )


@query(
    "count_distinct_approx_error",
    """SELECT l_returnflag, CAST(count(DISTINCT l_partkey) AS BIGINT) AS parts, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS orders,
        true AS parts_within, true AS orders_within FROM lineitem GROUP BY 1""",
)
def _(t: Tables):
    # Beside exact distinct counts a sketch would be kept for every distinct value; apart it is one per group.
    exact = t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_orderkey").alias("orders")
    )
    sketched = t.lineitem.groupBy(F.col("l_returnflag").alias("flag")).agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("p"),
        F.approx_count_distinct("l_orderkey", 0.02).alias("o"),
    )
    both = exact.join(sketched, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    # Five standard errors of the sketch.
    near = [(F.abs(F.col(a) - F.col(e)) <= F.col(e) * 0.1).alias(f"{e}_within") for a, e in (("p", "parts"), ("o", "orders"))]
    return both.select("l_returnflag", "parts", "orders", *near)


@query("count_distinct_approx")
def _(t: Tables):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.approx_count_distinct("l_partkey", 0.02).alias("parts"),
        F.approx_count_distinct("l_orderkey", 0.02).alias("orders"),
    )


def _same(name: str, sql: str, *tables: str) -> None:
    """A query whose text is valid in both engines, run through federation."""
    register(
        name,
        lambda t: federate_views(t.spark, sql, {n: t.path(n) for n in tables}),
        sql,
    )


_same(
    "group_having",
    """SELECT o_custkey, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS revenue
    FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND sum(o_totalprice) > 2000000""",
    "orders",
)
_same(
    "group_filter_agg",
    """SELECT o_orderpriority, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS finished,
        round(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 2) AS open_value
    FROM orders GROUP BY o_orderpriority""",
    "orders",
)
SUMS = "round(sum(l_quantity), 2) AS quantity, CAST(count(*) AS BIGINT) AS lines"
_same(
    "grouping_sets",
    f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, {SUMS}
    FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())""",
    "lineitem",
)


def _levels(name: str, method: str) -> None:
    def run(t: Tables):
        grouped = getattr(t.lineitem, method)("l_returnflag", "l_linestatus")
        return grouped.agg(
            F.grouping_id().alias("level"),
            r(F.sum("l_quantity"), 2).alias("quantity"),
            F.count(F.lit(1)).alias("lines"),
        )

    register(
        name,
        run,
        f"""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, {SUMS}
        FROM lineitem GROUP BY {method.upper()} (l_returnflag, l_linestatus)""",
    )


_levels("rollup", "rollup")
_levels("cube", "cube")


@query(
    "median_percentiles",
    """SELECT o_orderpriority, round(median(o_totalprice), 4) AS median,
        round(quantile_cont(o_totalprice, 0.25), 4) AS q1, round(quantile_cont(o_totalprice, 0.75), 4) AS q3
    FROM orders GROUP BY o_orderpriority""",
)
def _(t: Tables):
    found = exact_percentiles(
        t.orders, ["o_orderpriority"], "o_totalprice", {"median": 0.5, "q1": 0.25, "q3": 0.75}
    )
    return found.select("o_orderpriority", *[r(c).alias(c) for c in ("median", "q1", "q3")])


@query(
    "mode_vote",
    """WITH v AS (SELECT user_id, event_type, count(*) AS votes FROM events GROUP BY ALL)
    SELECT user_id, event_type, CAST(votes AS BIGINT) AS votes FROM v
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, event_type) = 1""",
)
def _(t: Tables):
    return agg.mode_vote(t.events, ["user_id"], "event_type")


@query(
    "argmax_bid",
    """SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) = 1""",
)
def _(t: Tables):
    bids = t.lineitem.select(
        "l_partkey",
        "l_suppkey",
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("_tie"),
    )
    return agg.argmax_bid(bids, ["l_partkey"], "l_extendedprice", "_tie").drop("_tie")
