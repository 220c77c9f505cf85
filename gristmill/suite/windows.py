"""Window functions, on the skew-safe operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators.merge import topk_per_group
from gristmill.operators.ordered import neighbours, sequence, trailing
from gristmill.suite.registry import Tables, day_text, query, r, register

BY_DATE = [("o_orderdate", "asc"), ("o_orderkey", "asc")]
BY_PRICE = [("o_totalprice", "desc"), ("o_orderkey", "asc")]
DATE_SQL = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
PRICE_SQL = "PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey"


def _orders(t: Tables):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")


def _ranked(name: str, kind: tuple, order, function: str, window: str) -> None:
    register(
        name,
        lambda t: sequence(_orders(t), ["o_custkey"], order, {"result": kind}).select(
            "o_orderkey", "result"
        ),
        f"SELECT o_orderkey, CAST({function} OVER ({window}) AS INTEGER) AS result FROM orders",
    )


# Quantities repeat, so ranks over them have ties.
RANK_ORDER = [("l_quantity", "desc")]
RANK_SQL = "PARTITION BY l_partkey ORDER BY l_quantity DESC"


def _tied(name: str, kind: str, digits: int | None = None) -> None:
    def run(t: Tables):
        lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
        placed = sequence(lines, ["l_partkey"], RANK_ORDER, {"result": (kind,)})
        value = r("result", digits) if digits else F.col("result")
        return placed.select("l_orderkey", "l_linenumber", value.alias("result"))

    value = f"{kind}() OVER ({RANK_SQL})"
    value = f"round({value}, {digits})" if digits else f"CAST({value} AS INTEGER)"
    register(name, run, f"SELECT l_orderkey, l_linenumber, {value} AS result FROM lineitem")


_ranked("win_row_number", ("row_number",), BY_DATE, "row_number()", DATE_SQL)
_ranked("win_ntile", ("ntile", 4), BY_PRICE, "ntile(4)", PRICE_SQL)
_tied("win_rank", "rank")
_tied("win_dense_rank", "dense_rank")
_tied("win_percent_rank", "percent_rank", 8)
_tied("win_cume_dist", "cume_dist", 8)


@query(
    "win_lag_lead",
    """
    WITH m AS (SELECT o_orderpriority, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month,
                      round(sum(o_totalprice), 2) AS total
               FROM orders GROUP BY ALL)
    SELECT o_orderpriority, month, total,
           round(total - lag(total) OVER w, 2) AS delta, lead(month) OVER w AS next_month
    FROM m WINDOW w AS (PARTITION BY o_orderpriority ORDER BY month)
    """,
)
def _(t: Tables):
    monthly = t.orders.groupBy(
        "o_orderpriority", day_text(F.date_trunc("month", "o_orderdate")).alias("month")
    ).agg(r(F.sum("o_totalprice"), 2).alias("total"))
    return neighbours(
        monthly,
        ["o_orderpriority"],
        [("month", "asc")],
        1,
        1,
        {
            "delta": lambda w: r(F.col("total") - F.lag("total").over(w), 2),
            "next_month": lambda w: F.lead("month").over(w),
        },
    )


def _full_frame(name: str, wanted: dict[str, tuple], sql: str) -> None:
    register(
        name,
        lambda t: sequence(_orders(t), ["o_custkey"], BY_DATE, wanted).select(
            "o_orderkey", *wanted
        ),
        f"""SELECT o_orderkey, {sql} FROM orders
        WINDOW w AS ({DATE_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    )


_full_frame(
    "win_first_last",
    {"first_price": ("first", "o_totalprice"), "last_price": ("last", "o_totalprice")},
    "first_value(o_totalprice) OVER w AS first_price, last_value(o_totalprice) OVER w AS last_price",
)
_full_frame(
    "win_nth_value",
    {"third_price": ("nth", "o_totalprice", 3)},
    "nth_value(o_totalprice, 3) OVER w AS third_price",
)


@query(
    "win_running_total",
    f"""SELECT o_orderkey, round(sum(o_totalprice) OVER ({DATE_SQL} ROWS UNBOUNDED PRECEDING), 2) AS running
    FROM orders""",
)
def _(t: Tables):
    summed = sequence(_orders(t), ["o_custkey"], BY_DATE, {"running": ("running_sum", "o_totalprice")})
    return summed.select("o_orderkey", r("running", 2).alias("running"))


@query(
    "win_moving_avg",
    f"""SELECT o_orderkey, round(avg(o_totalprice) OVER ({DATE_SQL} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving
    FROM orders""",
)
def _(t: Tables):
    moved = neighbours(
        _orders(t),
        ["o_custkey"],
        BY_DATE,
        2,
        0,
        {"moving": lambda w: F.avg("o_totalprice").over(w.rowsBetween(-2, 0))},
    )
    return moved.select("o_orderkey", r("moving").alias("moving"))


@query(
    "win_range_frame",
    """
    SELECT event_id,
           round(sum(value) OVER w, 2) AS week_value, CAST(count(*) OVER w AS BIGINT) AS week_events
    FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)
    """,
)
def _(t: Tables):
    events = t.events.select("event_id", "user_id", "ts", "value")
    summed = trailing(
        events,
        ["user_id"],
        "ts",
        7 * 86_400,
        {
            "week_value": lambda w: F.sum("value").over(w),
            "week_events": lambda w: F.count(F.lit(1)).over(w),
        },
    )
    return summed.select("event_id", r("week_value", 2).alias("week_value"), "week_events")


@query(
    "win_share_of_total",
    """SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share
    FROM orders""",
)
def _(t: Tables):
    shared = sequence(_orders(t), ["o_custkey"], BY_DATE, {"total": ("total_sum", "o_totalprice")})
    return shared.select("o_orderkey", r(F.col("o_totalprice") / F.col("total"), 8).alias("share"))


@query(
    "topk_per_group",
    f"""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER ({PRICE_SQL}) <= 3""",
)
def _(t: Tables):
    orders = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return topk_per_group(orders, ["o_custkey"], BY_PRICE, 3)
