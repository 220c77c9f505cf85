"""Datasets, files, JDBC, profiles, aggregates: small literal tables, exact answers."""

import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from gristmill.functions import conditions, dates, templates, values
from gristmill.operators import aggregate as agg
from gristmill.operators import charts, merge, prep, profile
from gristmill.operators import rows as row_ops
from gristmill.plans.federation import federate
from gristmill.plans.sqlgate import readonly_sql
from gristmill.scratch import new_folder
from gristmill.sources import files, jdbc, sinks


# ---- datasets


def test_dataset_round_trip(store, sales):
    assert store.append("sales", sales) == 3
    newest = store.read("sales").orderBy(F.desc("_id")).first()
    assert newest["amount"] == 30
    assert store.append("sales", sales.limit(1)) == 1
    read = store.read("sales")
    assert read.count() == 4 and read.select("_id").distinct().count() == 4
    listed = store.listing().first()
    assert (listed["name"], listed["rows"]) == ("sales", 4)
    assert store.delete("sales") is True and store.delete("sales") is False
    with pytest.raises(LookupError):
        store.read("sales")


def test_replace_may_read_its_own_dataset(store, sales):
    store.replace("s", sales)
    store.replace("s", store.read("s").filter("region = 'east'"))
    assert rows(store.read("s").select("amount"), "amount") == [(10,), (30,)]


def test_empty_append_registers(store, sales):
    assert store.append("empty", sales.limit(0)) == 0
    assert store.read("empty").columns == ["region", "amount", "_id", "_created_at"]
    assert store.read("empty").count() == 0
    assert store.listing().first()["last_written_at"] is None


def test_repeated_batch_adds_nothing(store, sales):
    assert store.append("s", sales, batch=("poll", 0)) == 3
    assert store.append("s", sales, batch=("poll", 0)) == 0
    assert store.append("s", sales, batch=("poll", 1)) == 3
    assert store.read("s").count() == 6


def test_append_widens_columns(spark, store):
    store.append("m", spark.createDataFrame([(1, "a")], "x int, y string"))
    store.append("m", spark.createDataFrame([(2.5, True)], "x double, z boolean"))
    store.append("m", spark.createDataFrame([("word",)], "x string"))
    found = store.read("m")
    assert dict(found.dtypes)["x"] == "string"
    assert rows(found.select("x", "y", "z"), "_id") == [("1", "a", None), ("2.5", None, True), ("word", None, None)]


def test_versions_tell_what_they_add(store, sales):
    name, log = "log", f"{store.root}/log/_versions"
    for i in range(18):
        store.append(name, sales.limit(1), batch=("s", i))
    sizes = {n: len(store._files.read_text(f"{log}/{n:012d}.json")) for n in (2, 15, 16, 17)}
    assert sizes[15] <= sizes[2] + 8 and sizes[16] > 4 * sizes[15] and sizes[17] < 2 * sizes[2]
    last = store.version(name)
    assert (last.number, last.rows, len(last.segments), last.batches) == (18, 18, 18, {"s": 17})
    assert store.version(name, 9).rows == 9 and len(store.version(name, 9).segments) == 9
    assert store.read(name).count() == 18


def test_compaction_keeps_rows_and_those_added_meanwhile(spark, store, sales, monkeypatch):
    for i in range(4):
        store.append("c", sales, batch=("s", i))
    store.append("c", spark.createDataFrame([("north", 1.5)], "region string, amount double"))
    before = rows(store.read("c"), "_id")
    plain = store._publish

    def late(name, version, base=None):
        if not base:  # the compaction: another writer is first
            monkeypatch.setattr(store, "_publish", plain)
            store.append("c", sales.limit(1), batch=("s", 4))
        return plain(name, version, base)

    monkeypatch.setattr(store, "_publish", late)
    assert store.compact("c") == 4
    after = store.read("c")
    assert rows(after, "_id")[:13] == before and after.count() == 14
    assert len(store.version("c").segments) == 3 and store.append("c", sales, batch=("s", 4)) == 0
    old = store.version("c", 5)
    assert store.vacuum("c") == 0 and len(old.segments) == 5  # all are of the retention time
    assert store.vacuum("c", older_than=-60) == 4
    assert rows(store.read("c"), "_id")[:13] == before
    assert store.append("c", sales) == 3 and store.read("c").count() == 17
    with pytest.raises(LookupError):
        store.compact("none")
    assert store.vacuum("none") == 0


def test_a_replaced_dataset_is_not_compacted(store, sales, monkeypatch):
    store.append("r", sales)
    store.append("r", sales)
    stale = store.version("r")
    store.replace("r", sales.limit(1))
    current = store.version
    answers = [stale]
    monkeypatch.setattr(store, "version", lambda name: answers.pop() if answers else current(name))
    assert store.compact("r") == 0
    assert store.read("r").count() == 1


@pytest.mark.parametrize("links", [True, False])
def test_a_file_is_published_once(store, links, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    if not links:  # as on other file systems
        monkeypatch.setattr(type(store._files), "_linked", staticmethod(lambda staged, target: False))
    path = f"{store.root}/once/{links}.json"
    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(lambda i: store._files.write_new(path, f"writer {i}"), range(4)))
    assert won.count(True) >= 1 and (not links or won.count(True) == 1)
    assert store._files.write_new(path, "late") is False
    assert store._files.read_text(path) in [f"writer {i}" for i, w in enumerate(won) if w]
    assert store._files.names(f"{store.root}/once") == [f"{links}.json"]


# ---- aggregates


def test_aggregates(sales):
    assert rows(agg.aggregate(sales, "sum", "amount", "region")) == [("east", 40.0, 2), ("west", 5.0, 1)]
    assert rows(agg.aggregate(sales, "count")) == [("all", 3.0, 3)]
    with pytest.raises(ValueError):
        agg.aggregate(sales, "median", "amount", "region")
    with pytest.raises(ValueError):
        agg.aggregate(sales, "sum", None, "region")


# ---- files


def test_csv(spark):
    folder = new_folder(spark, "csv")
    spark.createDataFrame([("﻿region,total",), ("east, 10",), (" east ,30",), ("west,5",), ("north,,9",)], "v string").coalesce(1).write.text(folder)
    found = files.read_csv(spark, folder)
    assert dict(found.dtypes) == {"region": "string", "total": "bigint"}
    means = rows(agg.aggregate(found, "avg", "total", "region"))
    assert means == [("east", 20.0, 2), ("west", 5.0, 1), ("north", 0.0, 1)]


def test_grid(spark):
    grid = spark.createDataFrame(
        [(0, ["region", ""]), (1, ["east", "40", "x"]), (2, ["west"])], "i int, c array<string>"
    )
    found = files.grid_to_table(grid, "i", "c")
    assert found.columns == ["region", "col_2", "col_3"]
    assert rows(found, "region") == [("east", "40", "x"), ("west", None, None)]


def test_export(spark):
    data = spark.createDataFrame([("east", 10, 1), ("west", 5, 2)], "region string, total long, _id long")
    folder = new_folder(spark, "export")
    path = sinks.export(data.coalesce(1), folder, "my report/1", "csv")
    assert path.endswith("my_report_1.csv")
    assert [r[0] for r in spark.read.text(path).collect()] == ["region,total", "east,10", "west,5"]
    back = spark.read.parquet(sinks.export(data, folder, "p", "parquet"))
    assert back.agg(F.sum("total")).first()[0] == 15 and back.columns == ["region", "total"]
    with pytest.raises(ValueError):
        sinks.export(data, folder, "x", "xml")


def test_jdbc(spark):
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    data = spark.createDataFrame([("east", 10.0), ("east", 30.0), ("west", 5.0)], "REGION string, TOTAL double")
    types = {"createTableColumnTypes": "REGION VARCHAR(20)"}
    assert jdbc.write_rows(data, url, "ORDERS", options=types) == 3
    assert jdbc.write_rows(data, url, "ORDERS", options=types) == 3
    assert "ORDERS" in jdbc.list_tables(spark, url)
    assert rows(jdbc.read_aggregate(spark, url, "ORDERS", "sum", "TOTAL", "REGION")) == [("east", 80.0, 4), ("west", 10.0, 2)]
    wrapped = "SELECT REGION, SUM(TOTAL) AS REVENUE FROM ORDERS GROUP BY REGION"
    assert jdbc.read_query(spark, url, wrapped).count() == 2
    assert rows(jdbc.read_aggregate(spark, url, wrapped, "max", "REVENUE")) == [("all", 80.0, 2)]
    for bad in ("orders; drop", "1x", ""):
        with pytest.raises(ValueError):
            jdbc.read_table(spark, url, bad)
    with pytest.raises(ValueError):
        jdbc.read_query(spark, url, "DELETE FROM ORDERS")


@pytest.mark.parametrize("master", ["local-cluster[3,2,3000]", "spark://host:7077", "yarn"])
def test_database_in_memory_is_for_local_mode_only(spark, master):
    from types import SimpleNamespace as Stub

    from gristmill.suite.sources import database

    def session(master, settings):
        context = Stub(master=master, _jvm=spark.sparkContext._jvm)
        return Stub(spark=Stub(conf=Stub(get=settings.get), sparkContext=context))

    with pytest.raises(RuntimeError, match="spark.gristmill.jdbc.url"):
        database(session(master, {}))
    named = {"spark.gristmill.jdbc.url": "jdbc:named"}
    assert database(session(master, named)) == "jdbc:named"
    for local in ("local", "local[4]", "local[*, 2]"):
        assert database(session(local, {})).startswith("jdbc:derby:memory:")


def test_browse(spark, catalog, store, sales):
    from gristmill.plans import browse

    store.append("sales", sales)
    page = browse.rows(catalog, "dataset:sales", 2, 1)
    assert page["total"] == 3 and [r["amount"] for r in page["rows"]] == [5, 10]
    assert rows(browse.schema(catalog, "sales")) == [("region", "string"), ("amount", "number")]
    assert browse.sample(catalog, "sales", 2)["total"] == 3
    assert set(browse.profile(catalog, "sales")) == {"number", "string"}
    assert rows(browse.aggregate(catalog, "sales", "sum", "amount", "region"))[0] == ("east", 40.0, 2)
    assert browse.materialize(catalog, "sales", "copy") == 3
    assert spark.read.parquet(browse.export(catalog, "sales", new_folder(spark, "x"), "parquet")).count() == 3
    url = f"jdbc:derby:memory:b{uuid.uuid4().hex};create=true"
    jdbc.write_rows(sales.toDF("REGION", "AMOUNT"), url, "SALES", options={"createTableColumnTypes": "REGION VARCHAR(20)"})
    catalog.register("db", "sql", {"url": url, "table": "SALES"})
    assert rows(browse.aggregate(catalog, "db", "max", "AMOUNT")) == [("all", 30.0, 3)]
    assert browse.rows(catalog, "db", 1)["total"] == 3


# ---- federation and the SQL gate


def test_federated_join(spark, catalog, store):
    store.append("regions", spark.createDataFrame([("east", "ana"), ("west", "bo")], "region string, manager string"))
    folder = new_folder(spark, "orders")
    spark.createDataFrame([("east", 10.0), ("east", 30.0), ("west", 5.0)], "region string, total double").write.parquet(folder)
    catalog.register("Orders", "file", {"path": folder})
    sql = "SELECT manager, sum(total) AS revenue FROM r JOIN o USING (region) GROUP BY manager ORDER BY revenue DESC"
    found = federate(catalog, sql, {"r": "dataset:regions", "o": "orders"})
    assert rows(found) == [("ana", 40.0), ("bo", 5.0)]
    nested = catalog.register("joined", "federated", {"sql": sql, "sources": {"r": "dataset:regions", "o": "orders"}})
    assert catalog.load("joined").count() == 2
    with pytest.raises(ValueError):
        federate(catalog, "SELECT * FROM j", {"j": nested.id})
    with pytest.raises(LookupError):
        federate(catalog, "SELECT * FROM x", {"x": "nowhere"})
    with pytest.raises(ValueError):
        federate(catalog, "SELECT 1", {"bad alias": "orders"})


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE t",
        "INSERT INTO t VALUES (1)",
        "SELECT 1; SELECT 2",
        "WITH x AS (SELECT 1) INSERT INTO t SELECT * FROM x",
        "",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "CREATE TABLE t AS SELECT 1",
    ],
)
def test_gate_refuses(spark, sql):
    with pytest.raises(ValueError):
        readonly_sql(spark, sql)


def test_gate_accepts(spark):
    assert readonly_sql(spark, " SELECT ';' AS x; ") == "SELECT ';' AS x"
    assert readonly_sql(spark, "WITH a AS (SELECT 1 AS v) SELECT * FROM a").startswith("WITH")


def test_files_are_not_tables(catalog):
    with pytest.raises(Exception, match="(?i)not supported|cannot be found|runSQLOnFiles|unknown table"):
        federate(catalog, "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`", {}).collect()


def test_registry_survives(spark, store, catalog):
    from gristmill.sources.catalog import Catalog

    source = catalog.register("kept", "file", {"path": "/nowhere"})
    again = Catalog(spark, store)
    assert again.resolve(source.id).name == "kept" and again.resolve("KEPT").id == source.id
    assert again.remove(source.id) and not again.remove(source.id)


# ---- rows


def test_conditions(spark):
    df = spark.createDataFrame(
        [("10", ["a", "b"]), ("9", ["c"]), ("x", []), ("", None), (None, None)], "v string, a array<string>"
    )

    def kept(field, operator, value=None, keep=True):
        return row_ops.filter_rows(df, field, operator, value, keep).count()

    assert kept("v", "greater_than", "9") == 2  # "10" as a number, "x" as text
    assert kept("v", "equals", "10") == 1 and kept("v", "not_equals", "10") == 3
    assert kept("v", "equals", "10", keep=False) == 4
    assert kept("v", "is_empty") == 2 and kept("v", "is_not_empty") == 3
    assert kept("a", "contains", "a") == 1 and kept("a", "is_empty") == 3
    assert kept("v", "greater_than", None) == 0
    with pytest.raises(ValueError):
        kept("v", "like", "x")
    assert len(conditions.OPERATORS) == 14


def test_numeric_filter_reaches_the_scan(spark):
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet")
    plan = row_ops.filter_rows(part, "p_size", "greater_than", "10")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(p_size,10)" in plan


def test_templates(spark):
    df = spark.range(1).select(F.struct(F.lit(6).alias("n"), F.lit("Ann").alias("name")).alias("u"))
    found = df.select(
        templates.interpolate("{{ u.n }}").alias("a"), templates.interpolate("Hi {{ u.name }}!").alias("b"), templates.interpolate(3).alias("c")
    )
    assert found.dtypes[0][1] == "int" and rows(found) == [(6, "Hi Ann!", 3)]
    with pytest.raises(Exception, match="(?i)u.*missing|cannot|No such"):
        df.select(templates.interpolate("{{ u.missing }}")).collect()


def test_validation(spark):
    df = spark.createDataFrame([("ann", "4"), (" ", "x"), ("bo", "")], "name string, age string")
    checked = row_ops.validate_records(df, [{"name": "name", "label": "Name", "required": True}, {"name": "age", "type": "number"}])
    good, bad = row_ops.split_valid(checked)
    assert rows(good, "name") == [("ann", 4.0), ("bo", None)]
    assert rows(bad.select("_messages")) == [(["Name", "age (must be a number)"],)]


def test_map_items(spark):
    df = spark.createDataFrame([([5, 6],)], "items array<long>")
    found = row_ops.map_items(df, "items", lambda item, index: item * 2.0, "out")
    assert rows(found.select("out", "count")) == [([10.0, 12.0], 2)]


def test_cap_and_stringify(spark):
    df = spark.createDataFrame([("abcdef", {"k": 1})], "t string, m map<string,long>")
    assert rows(df.select(values.capped(F.col("t"), 4).alias("c")).select("c.*")) == [(True, "abcd", 6)]
    assert rows(values.stringify_nested(df)) == [("abcdef", '{"k":1}')]


def test_date_patterns():
    assert dates.spark_pattern("%d/%m") == "dd'/'MM"
    with pytest.raises(ValueError):
        dates.spark_pattern("%Q")


def test_versions(spark):
    history = spark.createDataFrame([("w", i, f"V{i}") for i in range(1, 31)], "w string, version int, name string")
    kept = merge.retain_last_n(history, ["w"], [("version", "desc")], 25)
    assert kept.count() == 25 and kept.agg(F.min("version")).first()[0] == 6
    wanted = spark.createDataFrame([("w", 7)], "w string, version int")
    restored = merge.restore_version(kept, ["w"], "version", wanted)
    assert restored.orderBy(F.desc("version")).first()["name"] == "V7"


def test_routes_are_disjoint_and_complete(spark):
    df = spark.range(100).withColumn("v", F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id")))
    parts = row_ops.route_rows(df, {"low": F.col("v") < 30, "even": F.col("v") % 2 == 0})
    ids = [r["id"] for part in parts.values() for r in part.collect()]
    assert sorted(ids) == list(range(100)) and set(parts) == {"low", "even", "else"}


# ---- profile, cleaning, charts


def test_profile(spark):
    df = spark.createDataFrame([("east", 10), ("east", 30), ("west", None)], "region string, total long")
    numeric = profile.profile_numeric(df).first()
    assert (numeric["nulls"], numeric["min"], numeric["max"], numeric["mean"]) == (1, 10.0, 30.0, 20.0)
    top = profile.profile_categorical(df).orderBy(F.desc("count")).first()
    assert (top["value"], top["count"]) == ("east", 2)
    assert rows(profile.infer_schema(df)) == [("region", "string"), ("total", "number")]


def test_sample(spark):
    df = spark.range(50).toDF("n")
    first = sorted(r[0] for r in row_ops.sample_rows(df, "n", 10, "s").collect())
    again = sorted(r[0] for r in row_ops.sample_rows(df.repartition(7), "n", 10, "s").collect())
    assert first == again and len(first) == 10
    assert row_ops.sample_rows(df, "n", 0).count() == 1


def test_cleaning(spark):
    dirty = spark.createDataFrame([("east", 10), ("east", 10), ("west", None), ("west", 5)], "region string, total long")
    cleaned = prep.clean_nulls(dirty.distinct(), {"total": "drop"})
    assert rows(cleaned, "total") == [("west", 5), ("east", 10)]
    with pytest.raises(ValueError):
        prep.require_rows(cleaned.filter("total > 99"))
    filled = prep.clean_nulls(dirty, {"total": ("constant", 0)})
    assert filled.filter("total = 0").count() == 1
    with pytest.raises(ValueError):
        prep.check_target(dirty, cleaned, "total")
    with pytest.raises(ValueError):
        prep.feature_table(dirty, {"total": F.lit(1)}, "total", [])


def test_charts(sales):
    assert charts.check_chart({"type": "pie", "x": "region", "y": "amount"}, sales.columns) is None
    assert charts.check_chart({"type": "bar", "x": "region", "y": "amount"}, sales.columns)
    hist = rows(charts.chart_hist(sales, "amount", 5), "bin")
    assert [n for _, n in hist] == [1, 1, 0, 0, 1]


def test_gate_looks_at_the_plan(spark):
    from gristmill.plans.sqlgate import readonly_sql

    for sql in (
        "SELECT `reflect`('java.lang.Math', 'abs', 1)",
        "SELECT reflect/**/('java.lang.Math', 'abs', 1)",
        "SELECT * FROM t WHERE x = (SELECT max(java_method('java.lang.Math', 'abs', 1)) FROM t)",
        "WITH c AS (SELECT try_reflect('java.lang.Math', 'abs', 1) AS a) SELECT * FROM c",
        "SELECT * FROM t WHERE EXISTS (SELECT 1 FROM t WHERE reflect('java.lang.Math', 'abs', 1) > 0)",
    ):
        with pytest.raises(ValueError, match="JVM"):
            readonly_sql(spark, sql, {"t"})
    for sql in ("SELECT * FROM global_temp.secret", "SELECT * FROM u", "SELECT * FROM t WHERE x IN (SELECT x FROM u)"):
        with pytest.raises(ValueError, match="unknown table"):
            readonly_sql(spark, sql, {"t"})
    allowed = "WITH c AS (SELECT 'call reflect(x)' AS a FROM T) SELECT * FROM c JOIN t ON EXISTS (SELECT 1 FROM c)"
    assert readonly_sql(spark, allowed, {"t"}) == allowed


def test_csv_round_trip_and_wide_numbers(spark, tmp_path):
    from gristmill.operators.profile import infer_load_types
    from gristmill.sources.files import read_csv
    from gristmill.sources.sinks import export

    data = [(1, 'line one\nline "two", and three', "99999999999999999999", "9" * 60), (2, "plain", "1", "2")]
    df = spark.createDataFrame(data, "id long, text string, wide string, huge string")
    back = read_csv(spark, export(df, str(tmp_path), "x", "csv"))
    assert dict(back.dtypes) == {"id": "bigint", "text": "string", "wide": "decimal(38,0)", "huge": "string"}
    assert sorted((r.id, r.text, str(r.wide), r.huge) for r in back.collect()) == data
    types = {r.name: r.load_type for r in infer_load_types(df, ["wide", "text"]).collect()}
    assert types == {"wide": "DECIMAL(38,0)", "text": "VARCHAR"}


def test_comparands_keep_every_digit(spark):
    from gristmill.operators.rows import filter_rows

    near = spark.createDataFrame([(9007199254740992,), (9007199254740993,)], "n long")
    assert [r.n for r in filter_rows(near, "n", "equals", "9007199254740993").collect()] == [9007199254740993]
    assert filter_rows(near, "n", "less_than", "9007199254740992.5").count() == 1
    exact = near.selectExpr("CAST(n AS DECIMAL(30,2)) + 0.01BD AS d")
    assert filter_rows(exact, "d", "equals", "9007199254740993.01").count() == 1
    assert filter_rows(near, "n", "less_than", "1e30").count() == 2
    assert filter_rows(near, "n", "greater_than", "-inf").count() == 2


def test_written_rows_are_counted_as_they_pass(spark):
    from gristmill.sources import jdbc

    url = "jdbc:derby:memory:counted;create=true"
    assert jdbc.write_rows(spark.range(25), url, "counted_rows") == 25
    assert jdbc.write_rows(spark.range(5), url, "counted_rows") == 5


def test_widening_loses_nothing(spark, store):
    def append(name, value, kind):
        store.append(name, spark.createDataFrame([(value,)], f"x {kind}"))
        return dict(store.read(name).dtypes)["x"], sorted(str(r.x) for r in store.read(name).collect())

    from datetime import date, datetime
    from decimal import Decimal

    append("a", 7, "long")
    assert append("a", 2.5, "double") == ("double", ["2.5", "7.0"])
    assert append("a", 9007199254740993, "long") == ("string", ["2.5", "7", "9007199254740993"])
    append("b", 9007199254740993, "long")
    assert append("b", Decimal("0.25"), "decimal(10,2)") == ("decimal(21,2)", ["0.25", "9007199254740993.00"])
    append("c", date(2024, 1, 2), "date")
    assert append("c", datetime(2024, 1, 2, 3), "timestamp")[0] == "timestamp"
