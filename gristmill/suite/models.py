"""Training tables, metrics, diagnostics, and MLlib training."""

from __future__ import annotations

from pyspark.sql import functions as F

from gristmill.models import metrics, training
from gristmill.models.frame import holdout_split, model_frame
from gristmill.plans.experiment import run_experiment
from gristmill.scratch import new_folder
from gristmill.sources.catalog import Catalog
from gristmill.sources.datasets import DatasetStore
from gristmill.suite.registry import Tables, query, r

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_FEATURES = ["l_quantity", "l_discount", "l_tax"]
NULLED = """SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity, l_discount, l_tax,
    l_returnflag, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem"""


@query(
    "model_frame",
    f"""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS rows, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS target
    FROM ({NULLED}) WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1""",
)
def _(t: Tables):
    holed = t.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_quantity END AS l_quantity",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_extendedprice END AS l_extendedprice",
    )
    frame, _ = model_frame(holed, "l_extendedprice", None, [*LINE_KEY, "l_returnflag"])
    return frame.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("rows"),
        r(F.sum("l_quantity"), 2).alias("quantity"),
        r(F.sum("l_extendedprice"), 2).alias("target"),
    )


BUCKET = "('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 7))::BIGINT % 100"


@query(
    "holdout_split",
    f"""SELECT CASE WHEN {BUCKET.format('o_orderkey')} < 80 THEN 'train' ELSE 'test' END AS side, CAST(count(*) AS BIGINT) AS rows,
        CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""",
)
def _(t: Tables):
    train, test = holdout_split(t.orders.select("o_orderkey"), ["o_orderkey"])
    sides = train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))
    return sides.groupBy("side").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("keys")
    )


PRICED = "SELECT o_orderkey, o_totalprice AS y, o_totalprice * 0.9 + o_custkey AS p, 200000.0::DOUBLE + o_orderkey % 1000 AS q FROM orders"


def _priced(t: Tables):
    return t.orders.selectExpr(
        "o_orderkey", "o_totalprice AS y", "o_totalprice * 0.9D + o_custkey AS p", "200000.0D + o_orderkey % 1000 AS q"
    )


GUESS = "SELECT l_orderkey, l_linenumber, l_extendedprice AS y, 1500 * l_quantity - 10000 * l_discount AS p FROM lineitem"


def _guesses(t: Tables):
    return t.lineitem.selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice AS y",
        "1500 * l_quantity - 10000 * l_discount AS p",
    )


@query(
    "eval_regression",
    f"""SELECT round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) AS r2, round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) * (y - p)), 1) AS mse,
        round(sqrt(avg((y - p) * (y - p))), 4) AS rmse, CAST(count(*) AS BIGINT) AS test_rows FROM ({GUESS})""",
)
def _(t: Tables):
    scored = metrics.eval_regression(_guesses(t), "y", "p").drop("train_rows")
    return scored.withColumn("mse", r("mse", 1))


SCORED = """SELECT d.doc_id, CAST(quality AS VARCHAR) AS actual, n_chars / (n_chars + 1500.0::DOUBLE) AS score,
    CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS predicted FROM labels l JOIN documents d USING (doc_id)"""


def _scored(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "n_chars"), ["doc_id"]).selectExpr(
        "doc_id",
        "cast(quality AS string) AS actual",
        "n_chars / (n_chars + 1500.0D) AS score",
        "CASE WHEN n_chars > 1500 THEN '1' ELSE '0' END AS predicted",
    )


@query(
    "eval_classification",
    f"""WITH s AS ({SCORED}), c AS (SELECT actual AS class, count(*) AS support FROM s GROUP BY 1), h AS (SELECT predicted AS class, count(*) AS chosen FROM s GROUP BY 1),
    k AS (SELECT actual AS class, count(*) AS hit FROM s WHERE actual = predicted GROUP BY 1),
    m AS (SELECT support, coalesce(hit, 0) AS hit, coalesce(hit / nullif(chosen, 0), 0) AS p, coalesce(hit, 0) / support AS rec,
          2.0::DOUBLE * coalesce(hit, 0) / (support + coalesce(chosen, 0)) AS f FROM c LEFT JOIN h USING (class) LEFT JOIN k USING (class))
    SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(sum(p * support) / sum(support), 4) AS precision_weighted,
        round(sum(rec * support) / sum(support), 4) AS recall_weighted, round(sum(f * support) / sum(support), 4) AS f1_weighted, CAST(sum(support) AS BIGINT) AS test_rows FROM m""",
)
def _(t: Tables):
    return metrics.eval_classification(_scored(t), "actual", "predicted")


@query(
    "eval_roc_auc",
    f"""WITH s AS ({SCORED}), ranked AS (SELECT actual, (rank() OVER (ORDER BY score) + rank() OVER (ORDER BY score) + count(*) OVER (PARTITION BY score) - 1) / 2 AS avg_rank FROM s)
    SELECT round((sum(avg_rank) FILTER (WHERE actual = '1') - n1 * (n1 + 1) / 2) / (n1 * n0), 4) AS roc_auc
    FROM ranked, (SELECT count(*) FILTER (WHERE actual = '1') AS n1, count(*) FILTER (WHERE actual = '0') AS n0 FROM s) GROUP BY n1, n0""",
)
def _(t: Tables):
    flipped = _scored(t).withColumn("other", 1 - F.col("score"))
    asked = metrics.one_vs_rest(flipped, "actual", {"0": "other", "1": "score"})
    return metrics.weighted_auc(asked)


@query(
    "diag_pred_vs_actual",
    f"""SELECT o_orderkey, y AS actual, p AS predicted, round(y - p, 4) AS residual FROM ({PRICED})
    ORDER BY md5('0' || o_orderkey), o_orderkey LIMIT 500""",
)
def _(t: Tables):
    points = metrics.diag_pred_vs_actual(_priced(t), "o_orderkey", "y", "p")
    return points.withColumn("residual", r("residual"))


@query(
    "diag_roc_curve",
    f"""WITH s AS ({SCORED}), g AS (SELECT score, count(*) FILTER (WHERE actual = '1') AS h, count(*) FILTER (WHERE actual = '0') AS m FROM s GROUP BY score)
    SELECT '1' AS class, round(score, 8) AS threshold, round(sum(m) OVER (ORDER BY score DESC) / sum(m) OVER (), 8) AS fpr, round(sum(h) OVER (ORDER BY score DESC) / sum(h) OVER (), 8) AS tpr FROM g""",
)
def _(t: Tables):
    flipped = _scored(t).withColumn("other", 1 - F.col("score"))
    curve = metrics.diag_roc_curve(
        metrics.one_vs_rest(flipped, "actual", {"0": "other", "1": "score"})
    )
    return curve.withColumns({c: r(c, 8) for c in ("threshold", "fpr", "tpr")})


@query(
    "diag_confusion",
    f"""WITH s AS ({SCORED}), k AS (SELECT DISTINCT unnest([actual, predicted]) AS c FROM s), n AS (SELECT actual, predicted, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT a.c AS actual, p.c AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS count FROM k a CROSS JOIN k p LEFT JOIN n ON n.actual = a.c AND n.predicted = p.c""",
)
def _(t: Tables):
    return metrics.diag_confusion(_scored(t), "actual", "predicted")


@query(
    "compare_scores",
    f"""WITH m AS (SELECT count(*) AS rows, avg(abs(p - y)) AS pa, avg(abs(q - y)) AS qa, avg((p - y) * (p - y)) AS pm, avg((q - y) * (q - y)) AS qm, var_pop(y) AS s FROM ({PRICED})),
    l AS (SELECT rows, 'mae' AS metric, pa AS a, qa AS b FROM m UNION ALL SELECT rows, 'rmse', sqrt(pm), sqrt(qm) FROM m UNION ALL SELECT rows, 'r2', 1 - pm / s, 1 - qm / s FROM m)
    SELECT CAST(rows AS BIGINT) AS rows, metric, round(a, 4) AS a, round(b, 4) AS b, round(b - a, 4) AS difference FROM l""",
)
def _(t: Tables):
    first = _priced(t).select("o_orderkey", "y", F.col("p").alias("guess"))
    second = _priced(t).select("o_orderkey", "y", F.col("q").alias("guess"))
    return metrics.compare_scores(first, second, ["o_orderkey"], "y", "guess")


# ---- training: least squares has a closed form; of the others the tests assert the quality


def _least_squares(rows: str, per: str = "1") -> str:
    """Coefficients b0..b3 of y on x1, x2, x3 per group: the normal equations by Cramer's rule.

    ``rows`` has y, x1, x2, x3, fit (whether the row is learnt from) and the column ``per``.
    """
    names = ["x1", "x2", "x3"]
    sums = [f"avg({x}) AS m{x}" for x in [*names, "y"]]
    sums += [f"covar_pop({a}, {b}) AS c{a}{b}" for i, a in enumerate(names) for b in [*names[i:], "y"]]
    c = {(a, b): f"c{min(a, b)}{max(a, b)}" for a in names for b in names}

    def det(columns: list[str]) -> str:
        m = [[c[a, b] if b in names else f"c{a}y" for b in columns] for a in names]
        return " + ".join(
            f"{m[0][i]} * ({m[1][(i + 1) % 3]} * {m[2][(i + 2) % 3]} - {m[1][(i + 2) % 3]} * {m[2][(i + 1) % 3]})"
            for i in range(3)
        )

    slopes = ", ".join(
        f"({det([b if i == j else a for j, a in enumerate(names)])}) / ({det(names)}) AS b{i + 1}"
        for i, b in enumerate(["y"] * 3)
    )
    return f"""SELECT g, b1, b2, b3, my - b1 * mx1 - b2 * mx2 - b3 * mx3 AS b0 FROM (
        SELECT *, {slopes} FROM (SELECT {per} AS g, {', '.join(sums)} FROM ({rows}) WHERE fit GROUP BY 1))"""


GUESS = "b0 + b1 * x1 + b2 * x2 + b3 * x3"
LINES = f"""SELECT *, {BUCKET.format("(l_orderkey || '-' || l_linenumber)")} < 80 AS fit,
    l_extendedprice AS y, l_quantity AS x1, l_discount AS x2, l_tax AS x3 FROM lineitem"""


def _metric_rows(t: Tables, model: training.Model):
    rows = [(model.model_type, n, float(v)) for n, v in model.metrics.items() if v is not None]
    return t.spark.createDataFrame(rows, "model_type string, metric string, value double")


def _quality(t: Tables):
    """Document length and word count against the quality label."""
    measured = t.documents.select(
        "doc_id", "n_chars", F.size(F.split("text", r"\s+")).alias("n_words")
    )
    named = F.when(F.col("quality") == 1, "good").otherwise("poor")
    return t.labels.join(measured, ["doc_id"]).select("doc_id", "n_chars", "n_words", named.alias("quality"))


def _parts(t: Tables):
    return t.part.select(
        "p_partkey", "p_size", F.length("p_name").alias("name_length"), (F.col("p_partkey") % 1000).alias("series"), "p_retailprice"
    )


PART_FEATURES = ["p_size", "name_length", "series"]


@query(
    "train_linear_regression",
    f"""WITH r AS ({LINES}), b AS ({_least_squares("SELECT * FROM r")}), p AS (SELECT *, {GUESS} AS p FROM r, b),
    m AS (SELECT avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, var_pop(y) AS v, count(*) AS n FROM p WHERE NOT fit)
    SELECT 'linear_regression' AS model_type, metric, value FROM (
        SELECT 'r2' AS metric, round(1 - mse / v, 4) AS value FROM m UNION ALL SELECT 'mae', round(mae, 1) FROM m
        UNION ALL SELECT 'mse', round(mse, -3) FROM m UNION ALL SELECT 'rmse', round(sqrt(mse), 1) FROM m
        UNION ALL SELECT 'test_rows', CAST(n AS DOUBLE) FROM m
        UNION ALL SELECT 'train_rows', CAST(count(*) AS DOUBLE) FROM r WHERE fit)""",
)
def _(t: Tables):
    lines = t.lineitem.select(*LINE_KEY, *LINE_FEATURES, "l_extendedprice")
    found = _metric_rows(
        t, training.train(lines, "price", "l_extendedprice", "linear_regression", LINE_FEATURES, LINE_KEY)
    )
    value, metric = F.col("value"), F.col("metric")
    shown = F.when(metric == "mse", F.round(value, -3)).when(metric == "r2", F.round(value, 4))
    return found.withColumn("value", shown.otherwise(F.round(value, 1)))


@query("train_logistic_regression")
def _(t: Tables):
    return _metric_rows(
        t, training.train(_quality(t), "quality", "quality", "logistic_regression", ["n_chars", "n_words"], ["doc_id"])
    )


@query("train_rf_regression")
def _(t: Tables):
    return _metric_rows(
        t, training.train(_parts(t), "retail", "p_retailprice", "random_forest_regression", PART_FEATURES, ["p_partkey"])
    )


@query("train_rf_classification")
def _(t: Tables):
    return _metric_rows(
        t, training.train(_quality(t), "quality", "quality", "random_forest_classification", ["n_chars", "n_words"], ["doc_id"])
    )


@query(
    "predict",
    f"""WITH r AS ({LINES}), b AS ({_least_squares("SELECT * FROM r")})
    SELECT l_orderkey, l_linenumber, l_extendedprice, round({GUESS}, 0) AS predicted_l_extendedprice FROM r, b""",
)
def _(t: Tables):
    store = DatasetStore(t.spark, new_folder(t.spark, "predictions"))
    lines = t.lineitem.select(*LINE_KEY, *LINE_FEATURES, "l_extendedprice")
    model = training.train(lines, "price", "l_extendedprice", "linear_regression", LINE_FEATURES, LINE_KEY)
    registry = training.ModelRegistry(t.spark, new_folder(t.spark, "models"))
    registry.save(model)
    training.predict_into(registry.get("PRICE"), lines, store, "prices")
    guess = F.round("predicted_l_extendedprice", 0).alias("predicted_l_extendedprice")
    return store.read("prices").select(*LINE_KEY, "l_extendedprice", guess)


FOLD = "('0x' || substr(md5('fold' || p_partkey), 1, 7))::BIGINT % 5"


@query(
    "cross_validate",
    f"""WITH k AS (SELECT {FOLD} AS fold, p_retailprice AS y, CAST(p_size AS DOUBLE) AS x1,
                     CAST(length(p_name) AS DOUBLE) AS x2, CAST(p_partkey % 1000 AS DOUBLE) AS x3 FROM part),
    r AS (SELECT k.*, f.fold AS held, k.fold <> f.fold AS fit FROM k, (SELECT DISTINCT fold FROM k) f),
    b AS ({_least_squares("SELECT * FROM r", "held")}),
    s AS (SELECT g, fit, 1 - avg((y - ({GUESS})) * (y - ({GUESS}))) / var_pop(y) AS score FROM r JOIN b ON held = g GROUP BY 1, 2)
    SELECT CAST(h.g AS INTEGER) AS fold, round(h.score, 4) AS score, round(avg(h.score) OVER (), 4) AS mean,
           round(stddev_pop(h.score) OVER (), 4) AS std, round(avg(o.score) OVER (), 4) AS train_mean
    FROM s h JOIN s o ON h.g = o.g AND o.fit WHERE NOT h.fit""",
)
def _(t: Tables):
    found = training.cross_validate(_parts(t), "p_retailprice", "linear_regression", PART_FEATURES, 5, ["p_partkey"])
    rows = [(i, s, found["mean"], found["std"], found["train_mean"]) for i, s in enumerate(found["scores"])]
    return t.spark.createDataFrame(rows, "fold int, score double, mean double, std double, train_mean double")


@query("feature_importance")
def _(t: Tables):
    ranked = training.feature_importance(_parts(t), "p_retailprice", "linear_regression", PART_FEATURES, ["p_partkey"])
    return t.spark.createDataFrame(ranked, "feature string, importance double")


@query("experiment")
def _(t: Tables):
    catalog = Catalog(t.spark, DatasetStore(t.spark, new_folder(t.spark, "experiment")))
    catalog.register("parts", "file", {"path": t.path("part")})
    result = run_experiment(
        catalog,
        "parts",
        "p_retailprice",
        "SELECT DISTINCT p_partkey, p_name, p_size, p_retailprice FROM data WHERE p_size IS NOT NULL",
        "SELECT p_partkey, p_size, length(p_name) AS name_length, p_partkey % 1000 AS series, p_retailprice FROM data",
        ["linear_regression", "random_forest_regression"],
        ["p_partkey"],
    )
    return result.table()
