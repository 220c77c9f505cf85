"""Readers, writers, datasets, keyed merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import merge
from gristmill.operators.aggregate import aggregate
from gristmill.scratch import new_folder
from gristmill.sources import files, jdbc, sinks
from gristmill.sources.catalog import Catalog
from gristmill.sources.datasets import DatasetStore, dataset_listing
from gristmill.suite.registry import Tables, query, r, ts_text

PART = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _store(t: Tables) -> DatasetStore:
    return DatasetStore(t.spark, new_folder(t.spark, "datasets"))


def _public(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in df.columns if not c.startswith("_")])


@query("read_dataset", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def _(t: Tables):
    store = _store(t)
    store.append("orders", t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"))
    return _public(store.read("orders"))


@query(
    "write_dataset_append",
    """SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
)
def _(t: Tables):
    store = _store(t)
    store.append(
        "parties", t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_acctbal AS balance")
    )
    store.append(
        "parties", t.supplier.selectExpr("s_suppkey AS key", "s_name AS name", "s_acctbal AS balance")
    )
    return _public(store.read("parties"))


@query(
    "write_dataset_replace",
    "SELECT o_orderkey, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def _(t: Tables):
    store = _store(t)
    store.replace("orders", t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"))
    # The new content is computed from the dataset it replaces.
    mine = store.read("orders").filter(F.col("o_orderstatus") == "F")
    store.replace("orders", mine.selectExpr("o_orderkey", "o_totalprice * 2 AS o_totalprice"))
    return _public(store.read("orders"))


@query(
    "list_datasets",
    """SELECT c_custkey AS dataset, CAST(count(o_orderkey) AS BIGINT) AS rows, strftime(max(o_orderdate), '%Y-%m-%d') AS last_written_at
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""",
)
def _(t: Tables):
    registry = t.customer.select(F.col("c_custkey").alias("dataset"))
    rows = t.orders.select(F.col("o_custkey").alias("dataset"), "o_orderdate")
    listed = dataset_listing(registry, rows, "dataset", "o_orderdate")
    return listed.withColumn("last_written_at", F.date_format("last_written_at", "yyyy-MM-dd"))


CSV_SQL = """SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END AS p_size, p_retailprice,
    CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS mixed FROM part"""


def _padded(t: Tables) -> DataFrame:
    return t.part.selectExpr(
        "p_partkey",
        "concat('  ', p_name, ' ') AS p_name",
        "CASE WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat(' ', p_size) END AS p_size",
        "p_retailprice",
        "CASE WHEN p_partkey % 5 = 0 THEN 'n/a' ELSE cast(p_size AS string) END AS mixed",
    )


def _write_csv(df: DataFrame, path: str) -> None:
    writer = df.write.option("header", True).option("ignoreLeadingWhiteSpace", False)
    writer.option("ignoreTrailingWhiteSpace", False).csv(path)


CSV_TYPED = f"SELECT p_partkey, p_name, CAST(p_size AS BIGINT) AS p_size, p_retailprice, mixed FROM ({CSV_SQL})"


@query("read_csv_source", CSV_TYPED)
def _(t: Tables):
    path = new_folder(t.spark, "csv")
    _write_csv(_padded(t), path)
    return files.read_csv(t.spark, path)


@query("read_object_source", CSV_TYPED)
def _(t: Tables):
    path = new_folder(t.spark, "objects")
    # Two folders of files under one glob.
    halves = F.col("p_partkey") % 2 == 0
    _write_csv(_padded(t).filter(halves), f"{path}/a")
    _write_csv(_padded(t).filter(~halves), f"{path}/b")
    return files.read_objects(t.spark, f"{path}/*/*.csv")


@query(
    "read_json_records",
    """SELECT 'good' AS kind, CAST(count(*) AS BIGINT) AS records, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 10 <> 0
    UNION ALL SELECT 'bad', CAST(count(*) AS BIGINT), NULL FROM orders WHERE o_orderkey % 10 = 0""",
)
def _(t: Tables):
    path = new_folder(t.spark, "json")
    lines = t.orders.select("o_orderkey", F.to_json(F.struct("o_orderkey", "o_totalprice")).alias("line"))
    broken = F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("{oops "), "line")).otherwise(F.col("line"))
    lines.select(broken.alias("value")).write.text(path)
    good, bad = files.read_json_records(t.spark, path, "o_orderkey BIGINT, o_totalprice DOUBLE")
    counted = good.agg(
        F.lit("good").alias("kind"),
        F.count("o_orderkey").alias("records"),
        r(F.sum("o_totalprice"), 2).alias("total"),
    )
    return counted.unionByName(
        bad.agg(
            F.lit("bad").alias("kind"),
            F.count("record").alias("records"),
            F.lit(None).cast("double").alias("total"),
        )
    )


@query("read_feed_items", "SELECT page_id AS id, url AS link FROM pages")
def _(t: Tables):
    path = new_folder(t.spark, "feed")
    items = t.pages.select(F.col("page_id").alias("id"), F.col("url").alias("link"))
    items.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    return files.read_feed_items(t.spark, path, "id BIGINT, link STRING")


@query(
    "grid_to_table",
    """SELECT CAST(p_partkey AS VARCHAR) AS part, CAST(p_size AS VARCHAR) AS col_2, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS brand,
        CASE WHEN p_partkey % 3 = 1 THEN p_type END AS col_4 FROM part""",
)
def _(t: Tables):
    header = t.spark.createDataFrame([(-1, ["part", "", "brand"])], "row long, cells array<string>")
    body = t.part.selectExpr(
        "p_partkey AS row",
        """CASE p_partkey % 3 WHEN 0 THEN array(cast(p_partkey AS string), cast(p_size AS string))
           WHEN 1 THEN array(cast(p_partkey AS string), cast(p_size AS string), p_brand, p_type)
           ELSE array(cast(p_partkey AS string), cast(p_size AS string), p_brand) END AS cells""",
    )
    return files.grid_to_table(header.unionByName(body), "row", "cells")


@query("export_csv", "SELECT c_custkey, c_name, '{\"nation\":' || c_nationkey || '}' AS place FROM customer")
def _(t: Tables):
    nested = t.customer.select(
        "c_custkey", "c_name", F.struct(F.col("c_nationkey").alias("nation")).alias("place"), F.lit(1).alias("_hidden")
    )
    path = sinks.export(nested, new_folder(t.spark, "export"), "customer list!", "csv")
    reader = t.spark.read.option("header", True).option("escape", '"').schema(
        "c_custkey BIGINT, c_name STRING, place STRING"
    )
    return reader.csv(path)


@query(
    "export_parquet",
    "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
)
def _(t: Tables):
    lines = t.lineitem.withColumn("_hidden", F.lit(1))
    path = sinks.export(lines, new_folder(t.spark, "export"), "lines", "parquet")
    back = t.spark.read.parquet(path)
    return back.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"), r(F.sum("l_extendedprice"), 2).alias("total")
    )


@query(
    "materialize_source",
    """SELECT p_partkey, p_size FROM part UNION ALL SELECT p_partkey, p_size FROM part""",
)
def _(t: Tables):
    store = _store(t)
    catalog = Catalog(t.spark, store)
    source = catalog.register("parts", "file", {"path": t.path("part")})
    wanted = catalog.load(source).select("p_partkey", "p_size")
    sinks.materialize(wanted, store, "parts_copy", "replace")
    sinks.materialize(wanted, store, "parts_copy", "append")
    return _public(catalog.load("dataset:parts_copy"))


UPDATES = """SELECT CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey, o_totalprice + v AS o_totalprice, v
    FROM orders, (VALUES (1), (2)) x(v) WHERE o_orderstatus = 'P'"""


@query(
    "upsert_by_key",
    f"""WITH u AS (SELECT o_orderkey, o_totalprice FROM ({UPDATES}) WHERE v = 2)
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u)
    UNION ALL SELECT o_orderkey, o_totalprice FROM u""",
)
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    changed = t.orders.filter(F.col("o_orderstatus") == "P").selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey",
        "o_totalprice AS base",
        "explode(array(1, 2)) AS v",
    )
    updates = changed.selectExpr("o_orderkey", "base + v AS o_totalprice", "v")
    return merge.upsert_by_key(orders, updates, ["o_orderkey"], ["v"])


@query(
    "insert_if_absent",
    """SELECT o_orderkey, o_totalprice FROM orders
    UNION ALL SELECT o_orderkey + 10000000, o_totalprice FROM orders WHERE o_orderkey % 2 = 1""",
)
def _(t: Tables):
    orders = t.orders.select("o_orderkey", "o_totalprice")
    incoming = orders.selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey", "o_totalprice"
    )
    return merge.insert_if_absent(orders, incoming, ["o_orderkey"])


@query(
    "load_counts",
    """SELECT CAST(count(*) FILTER (WHERE o_orderkey % 2 = 1) AS BIGINT) AS migrated,
        CAST(count(*) FILTER (WHERE o_orderkey % 2 = 0) AS BIGINT) AS already_present FROM orders""",
)
def _(t: Tables):
    incoming = t.orders.selectExpr(
        "CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_orderkey + 10000000 END AS o_orderkey"
    )
    return merge.load_counts(t.orders, incoming, ["o_orderkey"])


@query(
    "retain_last_n",
    """SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""",
)
def _(t: Tables):
    newest = [("o_orderdate", "desc"), ("o_orderkey", "desc")]
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    kept = merge.retain_last_n(orders, ["o_custkey"], newest, 5)
    return kept.withColumn("o_orderdate", ts_text("o_orderdate"))


# ---- relational sources

PART_TYPES = "P_NAME VARCHAR(200), P_BRAND VARCHAR(50), P_TYPE VARCHAR(50)"


def database(t: Tables) -> str:
    """The database of the JDBC queries: the session's setting, or, in local mode only,
    an in-memory one inside Spark's own JVM."""
    url = t.spark.conf.get("spark.gristmill.jdbc.url", None)
    if url:
        return url
    if t.spark.sparkContext.master.partition("[")[0] != "local":  # local-cluster has executors of its own
        raise RuntimeError("set spark.gristmill.jdbc.url to a database every executor can reach")
    t.spark.sparkContext._jvm.java.lang.System.setProperty("derby.stream.error.file", "/dev/null")
    return f"jdbc:derby:memory:g{uuid.uuid4().hex};create=true"


def _loaded(t: Tables) -> tuple[str, str, int]:
    url, table = database(t), f"PART_{uuid.uuid4().hex[:12]}"
    upper = t.part.toDF(*[c.upper() for c in t.part.columns])
    inserted = jdbc.write_rows(upper, url, table, options={"createTableColumnTypes": PART_TYPES})
    return url, table, inserted


def _lower(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


@query("read_jdbc_table", PART + " WHERE p_size > 20")
def _(t: Tables):
    url, table, _ = _loaded(t)
    scanned = _lower(jdbc.read_table(t.spark, url, table, "P_PARTKEY", 4))
    return scanned.filter(F.col("p_size") > 20)


@query(
    "read_jdbc_query",
    """SELECT p_brand AS "group", round(max(p_retailprice), 4) AS value, CAST(count(*) AS BIGINT) AS rows
    FROM part WHERE p_size < 30 GROUP BY 1""",
)
def _(t: Tables):
    url, table, _ = _loaded(t)
    small = f"SELECT P_BRAND, P_RETAILPRICE FROM {table} WHERE P_SIZE < 30"
    return _lower(jdbc.read_aggregate(t.spark, url, small, "max", "P_RETAILPRICE", "P_BRAND"))


@query(
    "write_jdbc_rows",
    """SELECT p_type AS "group", CAST(sum(p_size) AS DOUBLE) AS value, CAST(count(*) AS BIGINT) AS rows,
        (SELECT CAST(count(*) AS BIGINT) FROM part) AS inserted FROM part GROUP BY 1""",
)
def _(t: Tables):
    url, table, inserted = _loaded(t)
    back = _lower(jdbc.read_query(t.spark, url, f"SELECT P_TYPE, P_SIZE FROM {table}"))
    return aggregate(back, "sum", "p_size", "p_type").withColumn("inserted", F.lit(inserted).cast("long"))


@query(
    "read_csv_breaks",
    """SELECT doc_id, md5(replace(text, ' ', '')) AS text_md5, lang, source, n_chars FROM documents""",
)
def _(t: Tables):
    """Whole texts with line breaks through CSV files and back, in splits."""
    folder = new_folder(t.spark, "csv-breaks")
    t.documents.write.option("header", True).option("escape", '"').csv(folder)
    back = files.read_csv(t.spark, folder)
    return back.select("doc_id", F.md5(F.replace("text", F.lit(" "), F.lit(""))).alias("text_md5"), "lang", "source", "n_chars")
