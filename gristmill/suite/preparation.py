"""Profiles, cleaning, features, chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.operators import charts, prep, profile, rows
from gristmill.suite.registry import Tables, day_text, query, r

NULLED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders"""


def _nulled(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey",
        "o_custkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS price",
        "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority",
    )


_KIND = """CASE WHEN column_type = 'BOOLEAN' THEN 'boolean' WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'number'
    WHEN column_type LIKE '%[]' THEN 'object' ELSE 'string' END"""


@query(
    "infer_schema",
    " UNION ALL ".join(
        f"SELECT '{n}' AS source, column_name AS name, {_KIND} AS type FROM (DESCRIBE SELECT * FROM {n})"
        for n in ("orders", "lineitem", "events", "embeddings")
    ),
)
def _(t: Tables):
    found = None
    for name in ("orders", "lineitem", "events", "embeddings"):
        part = profile.infer_schema(getattr(t, name)).withColumn("source", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return found


MIXED = """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"k": "none", "tag": "x"}' WHEN event_id % 3 = 1 THEN '{"k": 4, "on": true}'
    ELSE replace(props, '}', ', "sub": {"a": 1}}') END AS props FROM events"""


@query(
    "infer_record_types",
    f"""SELECT key AS name, coalesce(arg_min(kind, event_id) FILTER (WHERE kind <> 'string'), 'string') AS type FROM (
        SELECT event_id, key, CASE json_type(props, '$.' || key) WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string'
            WHEN 'NULL' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'object' ELSE 'number' END AS kind
        FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM ({MIXED}))) GROUP BY key""",
)
def _(t: Tables):
    mixed = t.events.selectExpr(
        "event_id",
        """CASE WHEN event_id % 3 = 0 THEN '{"k": "none", "tag": "x"}' WHEN event_id % 3 = 1 THEN '{"k": 4, "on": true}'
        ELSE replace(props, '}', ', "sub": {"a": 1}}') END AS props""",
    )
    return profile.infer_record_types(mixed, "props", "event_id")


@query(
    "infer_load_types",
    """WITH raw AS (SELECT CAST(o_custkey AS VARCHAR) AS whole, CAST(o_totalprice AS VARCHAR) AS fraction, o_orderpriority AS word,
        CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag, CAST(NULL AS VARCHAR) AS nothing FROM orders),
    long AS (UNPIVOT raw ON whole, fraction, word, flag INTO NAME name VALUE v),
    seen AS (SELECT name, bool_and(TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) AS i, bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) AS d,
        bool_and(v IN ('true', 'false')) AS b FROM long GROUP BY name)
    SELECT name, CASE WHEN i THEN 'BIGINT' WHEN d THEN 'DOUBLE' WHEN b THEN 'BOOLEAN' ELSE 'VARCHAR' END AS load_type FROM seen
    UNION ALL SELECT 'nothing', 'VARCHAR'""",
)
def _(t: Tables):
    raw = t.orders.selectExpr(
        "cast(o_custkey AS string) AS whole",
        "cast(o_totalprice AS string) AS fraction",
        "o_orderpriority AS word",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS flag",
        "cast(NULL AS string) AS nothing",
    )
    return profile.infer_load_types(raw, raw.columns)


@query(
    "sample_rows",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('seed' || o_orderkey), o_orderkey LIMIT 100",
)
def _(t: Tables):
    return rows.sample_rows(t.orders.select("o_orderkey", "o_totalprice"), "o_orderkey", 100, "seed")


def _profile_sql(source: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS name, CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct",
        CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std FROM {source}"""
        for c in columns
    )


def _rounded(df):
    return df.withColumns({"mean": r("mean"), "std": r("std")})


LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]


@query("profile_numeric", _profile_sql("lineitem", LINE_NUMBERS))
def _(t: Tables):
    return _rounded(profile.profile_numeric(t.lineitem, LINE_NUMBERS))


@query("profile_numeric_nulls", _profile_sql(f"({NULLED})", ["o_orderkey", "o_custkey", "price"]))
def _(t: Tables):
    return _rounded(profile.profile_numeric(_nulled(t)))


_HOLED = """WITH q AS (SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority, o_orderstatus FROM orders) """


@query(
    "profile_categorical",
    _HOLED
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS name, nulls, "distinct", value, count FROM
        (SELECT {c} AS value, CAST(count(*) AS BIGINT) AS count FROM q WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count DESC, {c} LIMIT 5),
        (SELECT CAST(count(*) - count({c}) AS BIGINT) AS nulls, CAST(count(DISTINCT {c}) AS BIGINT) AS "distinct" FROM q)"""
        for c in ("priority", "o_orderstatus")
    ),
)
def _(t: Tables):
    holed = t.orders.selectExpr(
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS priority", "o_orderstatus"
    )
    return profile.profile_categorical(holed)


@query("profile_approx")
def _(t: Tables):
    return profile.profile_approx(t.lineitem, ["l_quantity", "l_extendedprice", "l_returnflag"])


# ---- preparation


@query(
    "eda_nulls",
    f"""WITH q AS ({NULLED}) SELECT 'price' AS name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(price) AS BIGINT) AS nulls FROM q
    UNION ALL SELECT 'priority', count(*), count(*) - count(priority) FROM q""",
)
def _(t: Tables):
    return prep.null_counts(_nulled(t), ["price", "priority"])


@query(
    "eda_queries",
    f"""SELECT coalesce(priority, '—') AS value, CAST(count(*) AS BIGINT) AS rows FROM ({NULLED}) GROUP BY 1
""",
)
def _(t: Tables):
    return prep.target_distribution(_nulled(t), "priority")


@query(
    "clean_dedupe",
    """SELECT user_id, event_type, event_id, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""",
)
def _(t: Tables):
    first = prep.clean_dedupe(t.events, ["user_id", "event_type"], [("ts", "asc"), ("event_id", "asc")])
    return first.select("user_id", "event_type", "event_id", "value")


@query(
    "clean_nulls",
    f"""WITH q AS ({NULLED}), two AS (SELECT *, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cust,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE price END AS other FROM q),
    kept AS (SELECT * FROM two WHERE cust IS NOT NULL)
    SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM kept)), 4) AS price,
        round(coalesce(other, (SELECT median(other) FROM kept)), 4) AS other,
        coalesce(priority, (SELECT priority FROM kept WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)) AS priority
    FROM kept""",
)
def _(t: Tables):
    two = _nulled(t).selectExpr(
        "*",
        "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS cust",
        "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE price END AS other",
    )
    rules = {"cust": "drop", "price": "mean", "other": "median", "priority": "mode"}
    cleaned = prep.clean_nulls(two, rules)
    return cleaned.select(
        "o_orderkey", r("price").alias("price"), r("other").alias("other"), "priority"
    )


CELLS = "CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(o_custkey AS {}) END AS cust"


@query(
    "clean_types",
    f"SELECT o_orderkey, TRY_CAST(cust AS BIGINT) AS cust FROM (SELECT o_orderkey, {CELLS.format('VARCHAR')} FROM orders)",
)
def _(t: Tables):
    raw = t.orders.selectExpr("o_orderkey", CELLS.format("STRING"))
    return prep.clean_types(raw, {"cust": "bigint"})


@query(
    "clean_type_failures",
    f"""SELECT 'cust' AS name, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE TRY_CAST(cust AS BIGINT) IS NULL) AS BIGINT) AS failures
    FROM (SELECT {CELLS.format('VARCHAR')} FROM orders)""",
)
def _(t: Tables):
    raw = t.orders.selectExpr("o_orderkey", CELLS.format("STRING"))
    return prep.type_failures(raw, {"cust": "bigint"})


IQR = """b AS (SELECT q1 - 0.3 * (q3 - q1) AS low, q3 + 0.3 * (q3 - q1) AS high FROM
    (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders))"""


@query(
    "clean_outliers",
    f"WITH {IQR} SELECT o_orderkey, o_totalprice FROM orders, b WHERE o_totalprice BETWEEN low AND high",
)
def _(t: Tables):
    return prep.clean_outliers(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", reach=0.3)


@query(
    "clean_outliers_clip",
    """WITH b AS (SELECT avg(o_totalprice) - 1.5 * stddev_samp(o_totalprice) AS low, avg(o_totalprice) + 1.5 * stddev_samp(o_totalprice) AS high FROM orders)
    SELECT o_orderkey, round(greatest(least(o_totalprice, high), low), 4) AS o_totalprice FROM orders, b""",
)
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    clipped = prep.clean_outliers(orders, "o_totalprice", "zscore", "clip", 1.5)
    return clipped.withColumn("o_totalprice", r("o_totalprice"))


@query(
    "feat_ratio",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price,
        CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS tax_share FROM lineitem""",
)
def _(t: Tables):
    return t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        prep.feat_ratio("l_extendedprice", "l_quantity").alias("unit_price"),
        prep.feat_ratio("l_tax", "l_discount").alias("tax_share"),
    )


WIDTH = """b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)"""


@query(
    "feat_bucket",
    f"""WITH {WIDTH} SELECT o_orderkey, CAST(least(floor(10.0::DOUBLE * (o_totalprice - lo) / (hi - lo)) + 1, 10) AS BIGINT) AS width_bucket,
        CAST(ntile(4) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS quantile_bucket FROM orders, b""",
)
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    wide = orders.withColumn("width_bucket", prep.equal_width(orders, "o_totalprice", 10))
    order = [("o_totalprice", "asc"), ("o_orderkey", "asc")]
    return prep.quantile_bucket(wide, order, 4, "quantile_bucket").drop("o_totalprice")


@query(
    "feat_dateparts",
    """SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS o_orderdate_month, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS o_orderdate_weekday,
        CAST(date_diff('day', o_orderdate, DATE '2002-01-01') AS INTEGER) AS o_orderdate_days FROM orders""",
)
def _(t: Tables):
    parts = prep.feat_dateparts("o_orderdate", "2002-01-01")
    return t.orders.select("o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query(
    "feat_encode",
    f"""SELECT o_orderkey, CASE WHEN priority IS NULL THEN NULL ELSE CAST(dense_rank() OVER (ORDER BY priority NULLS LAST) - 1 AS INTEGER) END AS code,
        CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS "o_orderstatus_F", CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS "o_orderstatus_O",
        CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS "o_orderstatus_P"
    FROM (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders)""",
)
def _(t: Tables):
    holed = t.orders.selectExpr(
        "o_orderkey", "o_orderstatus", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS priority"
    )
    coded = prep.ordinal_encode(holed, "priority", "code")
    return prep.one_hot(coded, "o_orderstatus").drop("o_orderstatus", "priority")


@query(
    "feature_table",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / l_quantity AS unit_price, CAST(month(l_shipdate) AS INTEGER) AS l_shipdate_month,
        CAST(dayofweek(l_shipdate) + 1 AS INTEGER) AS l_shipdate_weekday, CAST(date_diff('day', l_shipdate, DATE '2002-01-01') AS INTEGER) AS l_shipdate_days,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS returned, l_extendedprice FROM lineitem""",
)
def _(t: Tables):
    features = {
        "unit_price": prep.feat_ratio("l_extendedprice", "l_quantity"),
        **prep.feat_dateparts("l_shipdate", "2002-01-01"),
        "returned": F.when(F.col("l_returnflag") == "R", 1).otherwise(0),
    }
    table = prep.feature_table(t.lineitem, features, "l_extendedprice", ["l_orderkey", "l_linenumber"])
    prep.check_target(t.lineitem, table, "l_extendedprice")
    return table


# ---- charts


@query(
    "chart_line",
    """SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS x, round(sum(o_totalprice), 2) AS y FROM orders
    GROUP BY 1""",
)
def _(t: Tables):
    month = day_text(F.date_trunc("month", "o_orderdate"))
    return charts.chart_line(t.orders, month, "sum", "o_totalprice").withColumn("y", r("y", 2))


@query(
    "chart_bar",
    """SELECT coalesce(p_brand, '—') AS x, round(avg(v), 4) AS y FROM (
        SELECT CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS p_brand,
               CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_retailprice END AS v FROM part)
    GROUP BY 1""",
)
def _(t: Tables):
    mixed = t.part.selectExpr(
        "CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_brand END AS p_brand",
        "CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_retailprice END AS v",
    )
    return charts.chart_bar(mixed, "p_brand", "avg", "v").withColumn("y", r("y"))


@query(
    "chart_hist",
    f"""WITH {WIDTH}, c AS (SELECT CAST(least(floor(20.0::DOUBLE * (o_totalprice - lo) / (hi - lo)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, CAST(coalesce(n, 0) AS BIGINT) AS count FROM range(1, 21) x(i) LEFT JOIN c ON c.bin = i""",
)
def _(t: Tables):
    return charts.chart_hist(t.orders.select("o_totalprice"), "o_totalprice", 20)


@query(
    "chart_box",
    """SELECT l_returnflag, min(l_extendedprice) AS low, round(quantile_cont(l_extendedprice, 0.25), 4) AS q1,
        round(quantile_cont(l_extendedprice, 0.5), 4) AS median, round(quantile_cont(l_extendedprice, 0.75), 4) AS q3, max(l_extendedprice) AS high
    FROM lineitem GROUP BY l_returnflag""",
)
def _(t: Tables):
    box = charts.chart_box(t.lineitem, "l_returnflag", "l_extendedprice")
    return box.withColumns({c: r(c) for c in ("q1", "median", "q3")})


@query(
    "chart_heatmap",
    """WITH a AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY ALL)
    SELECT p.o_orderpriority, s.o_orderstatus, round(coalesce(v, 0), 2) AS value
    FROM (SELECT DISTINCT o_orderpriority FROM orders) p CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s
    LEFT JOIN a ON a.o_orderpriority = p.o_orderpriority AND a.o_orderstatus = s.o_orderstatus""",
)
def _(t: Tables):
    cells = charts.chart_heatmap(t.orders, "o_orderpriority", "o_orderstatus", "sum", "o_totalprice")
    return cells.withColumn("value", r("value", 2))


@query(
    "chart_scatter",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5('0' || o_orderkey), o_orderkey LIMIT 200""",
)
def _(t: Tables):
    return charts.chart_scatter(t.orders, "o_orderkey", "o_custkey", "o_totalprice", 200)
