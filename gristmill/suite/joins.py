"""Federation and every join form, over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import joins
from gristmill.operators.skew import skew_join
from gristmill.plans.federation import federate_views
from gristmill.suite.registry import Tables, query, r

FLAGSHIP = """
SELECT r_name AS region, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
FROM orders
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey
GROUP BY r_name
"""


@query("federate", FLAGSHIP)
def _(t: Tables):
    names = ("region", "nation", "customer", "orders")
    return federate_views(t.spark, FLAGSHIP, {n: t.path(n) for n in names})


@query(
    "join_inner_using",
    """
    WITH o AS (SELECT o_custkey AS custkey, o_totalprice FROM orders),
         c AS (SELECT c_custkey AS custkey, c_mktsegment FROM customer)
    SELECT c_mktsegment, count(*) AS orders, round(sum(o_totalprice), 2) AS revenue
    FROM o JOIN c USING (custkey) GROUP BY c_mktsegment
    """,
)
def _(t: Tables):
    o = t.orders.select(F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = t.customer.select(F.col("c_custkey").alias("custkey"), "c_mktsegment")
    joined = skew_join(o, c, ["custkey"])
    return joined.groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("orders"), r(F.sum("o_totalprice"), 2).alias("revenue")
    )


def _orders_by_key(t: Tables):
    return t.orders.select(
        (F.col("o_custkey") + 100).alias("custkey"), "o_orderkey", "o_totalprice"
    )


def _customers(t: Tables):
    return t.customer.select(F.col("c_custkey").alias("custkey"), "c_name")


SHIFTED = """
    o AS (SELECT o_custkey + 100 AS custkey, o_orderkey, o_totalprice FROM orders),
    c AS (SELECT c_custkey AS custkey, c_name FROM customer)
"""


@query(
    "join_left",
    f"WITH {SHIFTED} SELECT custkey, o_orderkey, o_totalprice, c_name FROM o LEFT JOIN c USING (custkey)",
)
def _(t: Tables):
    return skew_join(_orders_by_key(t), _customers(t), ["custkey"], "left")


@query(
    "join_right",
    f"WITH {SHIFTED} SELECT custkey, c_name, o_orderkey, o_totalprice FROM c RIGHT JOIN o USING (custkey)",
)
def _(t: Tables):
    return joins.join_right(_customers(t), _orders_by_key(t), ["custkey"])


@query(
    "join_full",
    f"""WITH {SHIFTED} SELECT custkey, o_orderkey, o_totalprice, c_name
    FROM o FULL JOIN c USING (custkey)""",
)
def _(t: Tables):
    return joins.join_full(_orders_by_key(t), _customers(t), ["custkey"])


@query(
    "join_semi",
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
    """,
)
def _(t: Tables):
    # Distinct keys: a busy customer's orders are combined before they are moved.
    pending = (
        t.orders.filter(F.col("o_orderstatus") == "P")
        .select(F.col("o_custkey").alias("c_custkey"))
        .distinct()
    )
    return t.customer.select("c_custkey", "c_name").join(pending, ["c_custkey"], "left_semi")


@query(
    "join_anti",
    """
    SELECT c_custkey, c_name FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)
    """,
)
def _(t: Tables):
    large = (
        t.orders.filter(F.col("o_totalprice") > 450000)
        .select(F.col("o_custkey").alias("c_custkey"))
        .distinct()
    )
    return t.customer.select("c_custkey", "c_name").join(large, ["c_custkey"], "left_anti")


@query(
    "join_cross",
    """
    WITH pairs AS (SELECT r_name, n_name, n_nationkey, n_regionkey = r_regionkey AS home
                   FROM region CROSS JOIN nation),
         n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)
    SELECT r_name, n_name, CAST(CASE WHEN home THEN coalesce(n.n, 0) ELSE 0 END AS BIGINT) AS customers
    FROM pairs LEFT JOIN n ON c_nationkey = n_nationkey
    """,
)
def _(t: Tables):
    pairs = joins.small_product(t.region, t.nation)
    counts = t.customer.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    joined = pairs.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    at_home = F.col("n_regionkey") == F.col("r_regionkey")
    return joined.select(
        "r_name",
        "n_name",
        F.when(at_home, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("customers"),
    )


@query(
    "join_theta",
    """
    SELECT s_suppkey, CAST(count(c_custkey) AS BIGINT) AS poorer_customers
    FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND c_acctbal < s_acctbal
    GROUP BY s_suppkey
    """,
)
def _(t: Tables):
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = t.customer.select(F.col("c_nationkey").alias("nation"), "c_acctbal")
    counted = joins.theta_counts(s, c, ["nation"], "s_acctbal", "c_acctbal", "poorer_customers")
    return counted.select("s_suppkey", "poorer_customers")


@query(
    "join_broadcast",
    """
    SELECT p_brand, p_type, round(sum(l_extendedprice), 2) AS price, CAST(count(*) AS BIGINT) AS lines
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand, p_type
    """,
)
def _(t: Tables):
    facts = t.lineitem.select(F.col("l_partkey").alias("p_partkey"), "l_extendedprice")
    dims = t.part.select("p_partkey", "p_brand", "p_type")
    joined = joins.lookup_join(facts, dims, ["p_partkey"])
    return joined.groupBy("p_brand", "p_type").agg(
        r(F.sum("l_extendedprice"), 2).alias("price"), F.count(F.lit(1)).alias("lines")
    )


@query(
    "join_range",
    """
    WITH bands AS (SELECT i AS band, i * 50000.0::DOUBLE AS lo, (i + 1) * 50000.0::DOUBLE AS hi
                   FROM range(0, 10) x(i))
    SELECT CAST(band AS BIGINT) AS band, CAST(count(*) AS BIGINT) AS orders, round(sum(o_totalprice), 2) AS total
    FROM orders JOIN bands ON o_totalprice >= lo AND o_totalprice < hi GROUP BY band
    """,
)
def _(t: Tables):
    bands = t.spark.range(10).select(
        F.col("id").alias("band"),
        (F.col("id") * 50000.0).alias("lo"),
        ((F.col("id") + 1) * 50000.0).alias("hi"),
    )
    banded = joins.range_join(t.orders.select("o_totalprice"), bands, "o_totalprice", "lo", "hi")
    return banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("orders"), r(F.sum("o_totalprice"), 2).alias("total")
    )


@query(
    "join_asof",
    """
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
         c AS (SELECT event_id AS click_id, user_id, ts AS click_ts, value AS click_value
               FROM events WHERE event_type = 'click')
    SELECT event_id, p.user_id, click_id, click_value
    FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.click_ts
    """,
)
def _(t: Tables):
    e = t.events
    purchases = e.filter(F.col("event_type") == "purchase").select("event_id", "user_id", "ts")
    clicks = e.filter(F.col("event_type") == "click").select(
        F.col("event_id").alias("click_id"),
        "user_id",
        F.col("ts").alias("click_ts"),
        F.col("value").alias("click_value"),
    )
    found = joins.join_asof(
        purchases, clicks, ["user_id"], "ts", "click_ts", ["click_id", "click_value"]
    )
    return found.select("event_id", "user_id", "click_id", "click_value")


@query(
    "join_interval",
    """
    SELECT p.event_id, CAST(count(c.event_id) AS BIGINT) AS clicks, round(coalesce(sum(c.value), 0), 2) AS click_value
    FROM events p LEFT JOIN events c
      ON c.user_id = p.user_id AND c.event_type = 'click' AND c.ts BETWEEN p.ts - INTERVAL 12 HOUR AND p.ts
    WHERE p.event_type = 'purchase' GROUP BY p.event_id
    """,
)
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    counted = joins.interval_counts(
        e.filter(F.col("event_type") == "purchase"),
        e.filter(F.col("event_type") == "click"),
        ["user_id"],
        "ts",
        12 * 3600,
        "value",
    )
    return counted.select(
        "event_id",
        F.col("matches").alias("clicks"),
        r(F.coalesce("match_value", F.lit(0.0)), 2).alias("click_value"),
    )


@query(
    "join_star",
    """
    SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS lines, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    GROUP BY r_name, n_name
    """,
)
def _(t: Tables):
    # Measures are summed per join key before each join, so every exchange carries
    # one row per key and no key is heavy when it reaches a join.
    per_order = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        F.count(F.lit(1)).alias("lines"),
    )
    per_customer = (
        t.orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
        .join(per_order, ["o_orderkey"])
        .groupBy("c_custkey")
        .agg(F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines"))
    )
    per_nation = (
        t.customer.select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
        .join(per_customer, ["c_custkey"])
        .groupBy("n_nationkey")
        .agg(F.sum("revenue").alias("revenue"), F.sum("lines").alias("lines"))
    )
    named = per_nation.join(t.nation, ["n_nationkey"]).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return named.groupBy("r_name", "n_name").agg(
        F.sum("lines").alias("lines"), r(F.sum("revenue")).alias("revenue")
    )


SCALAR = """
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS above_average
FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
GROUP BY o_orderpriority
"""


@query("subquery_scalar", SCALAR)
def _(t: Tables):
    return federate_views(t.spark, SCALAR, {"orders": t.path("orders")})


CORRELATED = """
SELECT o.o_orderkey, o.o_custkey, o.o_totalprice FROM orders o
WHERE o.o_totalprice > (SELECT 1.5 * avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)
"""


@query("subquery_correlated", CORRELATED)
def _(t: Tables):
    # The per-key average is combined before its shuffle; heavy keys are then salted.
    average = t.orders.groupBy("o_custkey").agg((1.5 * F.avg("o_totalprice")).alias("bar"))
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    joined = skew_join(orders, average, ["o_custkey"])
    return joined.filter(F.col("o_totalprice") > F.col("bar")).drop("bar")
