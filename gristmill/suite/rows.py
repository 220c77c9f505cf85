"""Filters, projections, routing, validation, scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.functions import dates, records, text, values
from gristmill.operators import aggregate as agg
from gristmill.operators import rows
from gristmill.suite.registry import Tables, query, r, register

NUMBERS = {
    "equals": ("p_size", "10", "p_size = 10"),
    "not_equals": ("p_size", "10", "p_size <> 10"),
    "greater_than": ("p_retailprice", "950.5", "p_retailprice > 950.5"),
    "less_than": ("p_retailprice", "950.5", "p_retailprice < 950.5"),
    "greater_or_equal": ("p_size", "40", "p_size >= 40"),
    "less_or_equal": ("p_size", "7", "p_size <= 7"),
    "contains": ("p_name", "widget", "contains(p_name, 'widget')"),
    "not_contains": ("p_name", "widget", "NOT contains(p_name, 'widget')"),
    "starts_with": ("p_type", "ECO", "starts_with(p_type, 'ECO')"),
    "ends_with": ("p_name", "bolt", "ends_with(p_name, 'bolt')"),
}


def _filter(operator: str, field: str, value: str, sql: str) -> None:
    register(
        f"filter_{operator}",
        lambda t: rows.filter_rows(t.part, field, operator, value),
        f"SELECT * FROM part WHERE {sql}",
    )


for _operator, (_field, _value, _sql) in NUMBERS.items():
    _filter(_operator, _field, _value, _sql)

HOLED = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' WHEN o_orderkey % 5 = 1 THEN 'no' WHEN o_orderkey % 5 = 2 THEN 'true'
         WHEN o_orderkey % 5 = 3 THEN 'FALSE' ELSE 'maybe' END AS flag FROM orders"""


def _holed(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'Yes' WHEN o_orderkey % 5 = 1 THEN 'no' WHEN o_orderkey % 5 = 2 THEN 'true' "
        "WHEN o_orderkey % 5 = 3 THEN 'FALSE' ELSE 'maybe' END AS flag",
    )


for _operator, _field, _sql in (
    ("is_empty", "priority", "priority IS NULL OR priority = ''"),
    ("is_not_empty", "priority", "priority IS NOT NULL AND priority <> ''"),
    ("is_true", "flag", "lower(flag) IN ('true', '1', 'yes')"),
    ("is_false", "flag", "lower(flag) IN ('false', '0', 'no')"),
):
    register(
        f"filter_{_operator}",
        lambda t, field=_field, operator=_operator: rows.filter_rows(_holed(t), field, operator),
        f"SELECT * FROM ({HOLED}) WHERE {_sql}",
    )


@query(
    "filter_drop",
    f"SELECT * FROM ({HOLED}) WHERE priority IS NULL OR priority <> '1-URGENT'",
)
def _(t: Tables):
    return rows.filter_rows(_holed(t), "priority", "equals", "1-URGENT", keep=False)


@query(
    "filter_items",
    """SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0.1)) AS BIGINT) AS kept,
        round(CAST(list_sum(list_filter(embedding, lambda x: x > 0.1)) AS DOUBLE), 3) AS total
    FROM embeddings""",
)
def _(t: Tables):
    wide = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("items"))
    kept = rows.filter_items(wide, "items", "greater_than", 0.1)
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x)
    size = F.size("items").cast("long")
    return kept.select("vec_id", size.alias("kept"), F.when(size > 0, r(total, 3)).alias("total"))


@query(
    "set_fields",
    """SELECT l_orderkey AS "order", l_linenumber AS line, round(l_extendedprice * (1 - l_discount), 4) AS net,
        'line ' || l_linenumber || ' of ' || l_orderkey AS title FROM lineitem""",
)
def _(t: Tables):
    return rows.set_fields(
        t.lineitem,
        {
            "order": "{{ l_orderkey }}",
            "line": "{{ l_linenumber }}",
            "net": r(F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            "title": "line {{ l_linenumber }} of {{ l_orderkey }}",
        },
    )


@query(
    "interpolate",
    "SELECT c_custkey, c_name || ' buys ' || c_mktsegment AS label, c_nationkey AS nation FROM customer",
)
def _(t: Tables):
    nested = t.customer.select("c_custkey", F.struct("c_name", "c_mktsegment", "c_nationkey").alias("c"))
    fields = {
        "c_custkey": "{{ c_custkey }}",
        "label": "{{ c.c_name }} buys {{ c.c_mktsegment }}",
        "nation": "{{c.c_nationkey}}",
    }
    return rows.set_fields(nested, fields)


@query(
    "page_rows",
    """SELECT o_orderkey, o_totalprice, (SELECT CAST(count(*) AS BIGINT) FROM orders) AS total FROM orders
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 250""",
)
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    page = rows.page_rows(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")], 100, 250)
    return page.withColumn("total", orders.agg(F.count(F.lit(1))).scalar())


@query(
    "route_rows",
    """SELECT CASE WHEN p = '1-URGENT' THEN 'urgent' WHEN o_totalprice > 300000 THEN 'large' ELSE 'else' END AS route,
        CAST(count(*) AS BIGINT) AS rows, round(sum(o_totalprice), 2) AS total
    FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p, o_totalprice FROM orders) GROUP BY 1""",
)
def _(t: Tables):
    holed = t.orders.selectExpr(
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p", "o_totalprice"
    )
    tests = {"urgent": F.col("p") == "1-URGENT", "large": F.col("o_totalprice") > 300000}
    return (
        rows.tag_route(holed, tests)
        .groupBy("route")
        .agg(F.count(F.lit(1)).alias("rows"), r(F.sum("o_totalprice"), 2).alias("total"))
    )


@query(
    "event_filter",
    """SELECT event_id, event_type, action FROM (
        SELECT event_id, event_type, CASE WHEN event_id % 2 = 0 THEN 'opened' ELSE 'closed' END AS action FROM events)
    WHERE event_type IN ('signup') OR event_type || '.' || action IN ('purchase.opened')""",
)
def _(t: Tables):
    acted = t.events.selectExpr(
        "event_id", "event_type", "CASE WHEN event_id % 2 = 0 THEN 'opened' ELSE 'closed' END AS action"
    )
    return rows.event_filter(acted, ["signup", "purchase.opened"], "event_type", "action")


@query(
    "stringify_nested",
    """SELECT l_orderkey, l_linenumber, '{"part":' || l_partkey || ',"flag":"' || l_returnflag || '"}' AS info,
        '[' || l_suppkey || ',' || l_linenumber || ']' AS ids FROM lineitem""",
)
def _(t: Tables):
    nested = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag")).alias("info"),
        F.array(F.col("l_suppkey"), F.col("l_linenumber").cast("long")).alias("ids"),
    )
    return values.stringify_nested(nested)


@query(
    "cap_values",
    """SELECT doc_id, length(text) > 20000 AS truncated, CAST(length(substr(text, 1, 20000)) AS BIGINT) AS preview_chars,
        md5(substr(text, 1, 20000)) AS preview_md5, CAST(length(text) AS BIGINT) AS full_size_chars FROM documents""",
)
def _(t: Tables):
    cut = t.documents.select("doc_id", values.capped(F.col("text")).alias("c"))
    return cut.select(
        "doc_id",
        "c.truncated",
        F.length("c.preview").cast("long").alias("preview_chars"),
        F.md5("c.preview").alias("preview_md5"),
        F.col("c.full_size_chars").cast("long").alias("full_size_chars"),
    )


RAW_FORM = """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS priority,
    CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS amount FROM orders"""


@query(
    "validate_records",
    f"""SELECT o_orderkey, trim(priority) AS priority, TRY_CAST(nullif(trim(amount), '') AS DOUBLE) AS amount,
        concat_ws('; ', CASE WHEN coalesce(trim(priority), '') = '' THEN 'Priority' END,
            CASE WHEN coalesce(trim(amount), '') <> '' AND TRY_CAST(amount AS DOUBLE) IS NULL THEN 'amount (must be a number)' END) AS messages
    FROM (SELECT o_orderkey, nullif(trim(priority), '') AS priority, amount FROM ({RAW_FORM}))""",
)
def _(t: Tables):
    raw = t.orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '  ' ELSE o_orderpriority END AS priority",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 17 = 0 THEN '' ELSE CAST(o_custkey AS STRING) END AS amount",
    )
    fields = [
        {"name": "priority", "label": "Priority", "required": True},
        {"name": "amount", "type": "number"},
    ]
    checked = rows.validate_records(raw, fields)
    return checked.withColumn("messages", F.concat_ws("; ", "_messages")).drop("_messages")


def _date(name: str, build, sql: str) -> None:
    register(
        name,
        lambda t: t.events.select("event_id", *build()),
        f"SELECT event_id, {sql} FROM events",
    )


_date(
    "dt_format",
    lambda: [
        dates.dt_format(F.col("ts"), "iso").alias("iso"),
        dates.dt_format(F.col("ts"), "date").alias("date"),
        dates.dt_format(F.col("ts"), "time").alias("time"),
        dates.dt_format(F.col("ts"), "datetime").alias("datetime"),
        dates.dt_format(F.col("ts"), "us").alias("us"),
        dates.dt_format(F.col("ts"), "human").alias("human"),
        dates.dt_format(F.col("ts"), "%a %d %b %y, %I:%M %p (day %j)").alias("custom"),
    ],
    """strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S') AS time,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS datetime, strftime(ts, '%m/%d/%Y') AS us,
    strftime(ts, '%B %-d, %Y') AS human, strftime(ts, '%a %d %b %y, %I:%M %p (day %j)') AS custom""",
)


def _shift(name: str, function, sign: str) -> None:
    def run(t: Tables):
        shifted = t.events.select(
            "event_id",
            *[
                F.date_format(function(F.col("ts"), n, unit), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(unit)
                for unit, n in SHIFTS.items()
            ],
        )
        return shifted

    sql = ", ".join(
        f"strftime(ts {sign} INTERVAL {n} {unit.rstrip('s')}, '%Y-%m-%d %H:%M:%S.%f') AS {unit}"
        for unit, n in SHIFTS.items()
    )
    register(name, run, f"SELECT event_id, {sql} FROM events")


SHIFTS = {"seconds": 90, "minutes": 45, "hours": 30, "days": 10, "weeks": 3}
_shift("dt_add", dates.dt_add, "+")
_shift("dt_subtract", dates.dt_subtract, "-")
_date(
    "dt_diff",
    lambda: [
        r(dates.dt_diff(F.col("ts"), F.lit("2024-01-31 00:00:00").cast("timestamp"), u), 6).alias(u)
        for u in ("seconds", "hours", "days")
    ],
    ", ".join(
        f"round((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts)) / 1000000.0 / {n}, 6) AS {u}"
        for u, n in (("seconds", "1.0"), ("hours", "3600.0"), ("days", "86400.0"))
    ),
)


def _parts():
    parts = dates.dt_parts(F.col("ts"))
    whole = [parts[n].cast("long").alias(n) for n in ("year", "month", "weekday", "hour")]
    cut = [F.date_format(parts[n], "yyyy-MM-dd").alias(n) for n in ("day", "month_start")]
    return whole + cut


_date(
    "dt_parts_trunc",
    _parts,
    """CAST(year(ts) AS BIGINT) AS year, CAST(month(ts) AS BIGINT) AS month, CAST(dayofweek(ts) + 1 AS BIGINT) AS weekday,
    CAST(hour(ts) AS BIGINT) AS hour, strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('month', ts), '%Y-%m-%d') AS month_start""",
)


@query(
    "calc_expression",
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge,
        round(power(l_quantity, 2) - l_quantity / 4, 4) AS curve, CAST(l_orderkey % 7 AS BIGINT) AS bucket,
        round(CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END, 6) AS ratio FROM lineitem""",
)
def _(t: Tables):
    return t.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge",
        "round(power(l_quantity, 2) - l_quantity / 4, 4) AS curve",
        "l_orderkey % 7 AS bucket",
        "round(try_divide(l_tax, l_discount), 6) AS ratio",
    )


@query(
    "fingerprint_dedup",
    """SELECT sha256(text) AS digest, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS kept
    FROM documents GROUP BY 1 HAVING count(*) > 1""",
)
def _(t: Tables):
    return agg.duplicate_groups(t.documents, values.digest([F.col("text")], "sha256"), "doc_id")


@query(
    "fingerprint_digests",
    "SELECT doc_id, md5(lang || chr(31) || source) AS md5, sha1(lang || chr(31) || source) AS sha1 FROM documents",
)
def _(t: Tables):
    columns = [F.col("lang"), F.col("source")]
    return t.documents.select(
        "doc_id",
        values.digest(columns, "md5").alias("md5"),
        values.digest(columns, "sha1").alias("sha1"),
    )


PATTERNS = {"number": "[0-9]+", "capital": "[A-Z][a-z]+", "the": "\\bthe\\b"}


@query(
    "regex_counts",
    " UNION ALL ".join(
        f"""SELECT lang, '{n}' AS pattern, CAST(count(*) FILTER (WHERE len(h) > 0) AS BIGINT) AS rows_matched,
        CAST(sum(len(h)) AS BIGINT) AS matches, (SELECT CAST(count(DISTINCT x) AS BIGINT) FROM
            (SELECT unnest(regexp_extract_all(text, '{p}')) AS x FROM documents i WHERE i.lang = o.lang)) AS distinct_matches
        FROM (SELECT lang, regexp_extract_all(text, '{p}') AS h FROM documents) o GROUP BY lang"""
        for n, p in PATTERNS.items()
    ),
)
def _(t: Tables):
    return text.regex_counts(t.documents, "text", PATTERNS, ["lang"])


@query(
    "regex_replace",
    "SELECT doc_id, md5(regexp_replace(text, '[0-9]+', '#', 'g')) AS replaced FROM documents",
)
def _(t: Tables):
    cleaned = text.regex_replace(t.documents, "text", "[0-9]+", "#")
    return cleaned.select("doc_id", F.md5("text").alias("replaced"))


@query(
    "text_stats",
    r"""SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars,
        CAST(sum(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) AS BIGINT) AS words,
        CAST(sum(len(regexp_extract_all(text, '[.!?]+'))) AS BIGINT) AS sentences,
        CAST(sum(length(text) - length(replace(text, chr(10), '')) + 1) AS BIGINT) AS lines
    FROM documents GROUP BY lang""",
)
def _(t: Tables):
    return text.text_stats(t.documents, "text", ["lang"])


@query(
    "frequent_words",
    r"""SELECT word, CAST(count(*) AS BIGINT) AS occurrences
    FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> ''
    GROUP BY word ORDER BY occurrences DESC, word LIMIT 10""",
)
def _(t: Tables):
    return text.frequent_words(t.documents, "text")


BROKEN = "CASE WHEN event_id % 10 = 0 THEN replace(props, '}', '') ELSE props END"


@query(
    "json_flatten",
    f"""SELECT event_id, CASE WHEN json_valid(p) THEN CAST(json_extract_string(p, '$.k') AS BIGINT) END AS k
    FROM (SELECT event_id, {BROKEN} AS p FROM events)""",
)
def _(t: Tables):
    broken = t.events.selectExpr("event_id", f"{BROKEN} AS p")
    return records.json_flatten(broken, "p", {"k": ("$.k", "bigint")}).select("event_id", "k")


@query(
    "json_keys",
    """SELECT "key", CAST(count(*) AS BIGINT) AS rows FROM (SELECT unnest(json_keys(props)) AS "key" FROM events) GROUP BY 1""",
)
def _(t: Tables):
    return records.json_keys(t.events, "props")


@query(
    "json_failures",
    f"""SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) FILTER (WHERE NOT json_valid(p)) AS BIGINT) AS failures
    FROM (SELECT {BROKEN} AS p FROM events)""",
)
def _(t: Tables):
    return records.json_failures(t.events.selectExpr(f"{BROKEN} AS p"), "p")


DELIMITED = "CASE WHEN o_orderkey % 10 = 0 THEN 'x' || o_custkey || ';' || o_orderstatus ELSE o_custkey || ';' || o_orderstatus END"


@query(
    "delimited_flatten",
    f"""SELECT o_orderkey, TRY_CAST(split_part(line, ';', 1) AS BIGINT) AS cust, split_part(line, ';', 2) AS status,
        o_orderkey % 10 = 0 AS failed FROM (SELECT o_orderkey, {DELIMITED} AS line FROM orders)""",
)
def _(t: Tables):
    lines = t.orders.selectExpr("o_orderkey", f"{DELIMITED} AS line")
    flat = records.delimited_flatten(lines, "line", "cust BIGINT, status STRING", ";")
    return flat.select("o_orderkey", "cust", "status", F.col("_bad").isNotNull().alias("failed"))


@query(
    "xml_flatten",
    "SELECT p_partkey, p_name AS name, p_size AS size FROM part",
)
def _(t: Tables):
    packed = t.part.selectExpr(
        "p_partkey",
        "concat('<part><name>', p_name, '</name><size>', p_size, '</size></part>') AS xml",
    )
    return records.xml_flatten(packed, "xml", "name STRING, size INT").drop("xml")


LINK_SQL = r"""regexp_extract_all(html, '<a\s[^>]*?href=["'']([^"'']*)["'']', 1)"""


@query(
    "page_links",
    f"""SELECT target, CAST(count(*) AS BIGINT) AS links, CAST(count(DISTINCT page_id) AS BIGINT) AS pages
    FROM (SELECT page_id, unnest({LINK_SQL}) AS target FROM pages) GROUP BY target""",
)
def _(t: Tables):
    links = records.page_links(t.pages, "page_id", "html")
    return links.groupBy("target").agg(
        F.count(F.lit(1)).alias("links"), F.count_distinct("page_id").alias("pages")
    )


@query(
    "page_titles",
    f"""SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
        CAST(len({LINK_SQL}) AS BIGINT) AS out_links FROM pages""",
)
def _(t: Tables):
    titled = records.page_titles(t.pages, "html")
    links = F.size(F.regexp_extract_all("html", F.lit(records.LINK), F.lit(1))).cast("long")
    return titled.select("page_id", "title", links.alias("out_links"))


@query(
    "url_host_stats",
    r"""SELECT coalesce(host, '—') AS host, CAST(count(*) AS BIGINT) AS pages, CAST(count(*) FILTER (WHERE NOT valid) AS BIGINT) AS invalid,
        CAST(max(depth) AS INTEGER) AS max_depth
    FROM (SELECT valid, CASE WHEN valid THEN regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) END AS host,
                 CASE WHEN valid THEN len(list_filter(string_split(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')) END AS depth
          FROM (SELECT u, regexp_full_match(u, '[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+[^\s]*') AS valid
                FROM (SELECT CASE WHEN page_id % 10 = 0 THEN 'not a url ' || page_id ELSE url END AS u FROM pages)))
    GROUP BY 1""",
)
def _(t: Tables):
    mixed = t.pages.selectExpr(
        "CASE WHEN page_id % 10 = 0 THEN concat('not a url ', page_id) ELSE url END AS u"
    )
    return records.url_host_stats(mixed, "u")




@query(
    "number_parse",
    f"""SELECT kind, CAST(count(*) AS BIGINT) AS cells, round(sum(TRY_CAST(trim(cell) AS DOUBLE)), 2) AS total
    FROM (SELECT cell, CASE WHEN trim(cell) = '' THEN 'blank' WHEN TRY_CAST(trim(cell) AS BIGINT) IS NOT NULL AND trim(cell) NOT LIKE '%.%' THEN 'int'
          WHEN TRY_CAST(trim(cell) AS DOUBLE) IS NOT NULL THEN 'float' ELSE 'text' END AS kind
          FROM (SELECT CASE WHEN o_orderkey % 4 = 0 THEN ' ' || o_custkey || ' ' WHEN o_orderkey % 4 = 1 THEN o_custkey || '.25'
                       WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE ' ' END AS cell FROM orders)) GROUP BY kind""",
)
def _(t: Tables):
    cells = t.orders.selectExpr(
        "CASE WHEN o_orderkey % 4 = 0 THEN ' ' || o_custkey || ' ' WHEN o_orderkey % 4 = 1 THEN o_custkey || '.25' "
        "WHEN o_orderkey % 4 = 2 THEN o_orderpriority ELSE ' ' END AS cell"
    )
    return cells.groupBy(values.number_kind(F.col("cell")).alias("kind")).agg(
        F.count(F.lit(1)).alias("cells"), r(F.sum(values.number_of(F.col("cell"))), 2).alias("total")
    )


@query(
    "array_ops",
    """SELECT vec_id, round(list_sum(list_transform(e, lambda x: x * x)), 6) AS norm2, CAST(len(list_filter(e, lambda x: x < 0)) AS BIGINT) AS negatives,
        round(list_max(e), 6) AS largest, round(e[1], 6) AS first
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
)
def _(t: Tables):
    wide = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    squares = F.transform("e", lambda x: x * x)
    return wide.select(
        "vec_id",
        r(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), 6).alias("norm2"),
        F.size(F.filter("e", lambda x: x < 0)).cast("long").alias("negatives"),
        r(F.array_max("e"), 6).alias("largest"),
        r(F.col("e")[0], 6).alias("first"),
    )


@query(
    "map_ops",
    """SELECT name, CAST(count(*) AS BIGINT) AS entries, round(sum(v), 2) AS total FROM (
        SELECT 'price' AS name, o_totalprice AS v FROM orders WHERE o_totalprice > 1000
        UNION ALL SELECT 'customer', CAST(o_custkey AS DOUBLE) FROM orders WHERE o_custkey > 1000)
    GROUP BY name""",
)
def _(t: Tables):
    packed = t.orders.select(
        F.map_from_entries(
            F.array(
                F.struct(F.lit("price").alias("k"), F.col("o_totalprice").alias("v")),
                F.struct(F.lit("customer").alias("k"), F.col("o_custkey").cast("double").alias("v")),
            )
        ).alias("m")
    )
    kept = packed.select(F.explode(F.map_filter("m", lambda _, v: v > 1000)).alias("name", "v"))
    return kept.groupBy("name").agg(
        F.count(F.lit(1)).alias("entries"), r(F.sum("v"), 2).alias("total")
    )


@query(
    "conditional",
    """SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band,
        coalesce(nullif(o_orderpriority, '4-NOT SPECIFIED'), 'none') AS priority, CAST(count(*) AS BIGINT) AS orders
    FROM orders GROUP BY 1, 2""",
)
def _(t: Tables):
    price = F.col("o_totalprice")
    band = F.when(price < 100000, "low").when(price < 300000, "mid").otherwise("high")
    priority = F.coalesce(F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")), F.lit("none"))
    return t.orders.groupBy(band.alias("band"), priority.alias("priority")).agg(
        F.count(F.lit(1)).alias("orders")
    )


@query(
    "validate_data",
    """SELECT rule, CAST(p AS BIGINT) AS passed, CAST(n - p AS BIGINT) AS failed FROM (
        SELECT 'positive price' AS rule, count(*) FILTER (WHERE l_extendedprice > 0) AS p, count(*) AS n FROM lineitem
        UNION ALL SELECT 'small discount', count(*) FILTER (WHERE l_discount <= 0.05), count(*) FROM lineitem
        UNION ALL SELECT 'known flag', count(*) FILTER (WHERE l_returnflag IN ('A', 'N')), count(*) FROM lineitem)""",
)
def _(t: Tables):
    return rows.check_rules(
        t.lineitem,
        {
            "positive price": F.col("l_extendedprice") > 0,
            "small discount": F.col("l_discount") <= 0.05,
            "known flag": F.col("l_returnflag").isin("A", "N"),
        },
    )


@query(
    "transform_data",
    """SELECT c_custkey AS id, upper(c_mktsegment) AS segment, round(c_acctbal / 100, 4) AS hundreds
    FROM customer WHERE c_acctbal >= 0 ORDER BY hundreds DESC, id""",
)
def _(t: Tables):
    return (
        t.customer.filter(F.col("c_acctbal") >= 0)
        .withColumnRenamed("c_custkey", "id")
        .select("id", F.upper("c_mktsegment").alias("segment"), r(F.col("c_acctbal") / 100).alias("hundreds"))
        .orderBy(F.desc("hundreds"), "id")
    )


@query(
    "map_items",
    """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS count,
        round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x * 2 + (i - 1))), 4) AS total,
        CAST(len(list_filter(embedding, lambda x: x <= 0)) AS BIGINT) AS failed
    FROM embeddings""",
)
def _(t: Tables):
    wide = t.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    # A failing item is kept as data: its error is set and the loop goes on.
    step = lambda item, index: F.struct(
        (item * 2 + index).alias("value"), F.when(item <= 0, "not positive").alias("error")
    )
    mapped = rows.map_items(wide, "e", step)
    total = F.aggregate("items", F.lit(0.0), lambda a, x: a + x["value"])
    failed = F.size(F.filter("items", lambda x: x["error"].isNotNull())).cast("long")
    return mapped.select("vec_id", "count", r(total).alias("total"), failed.alias("failed"))
