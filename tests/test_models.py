"""Model quality by threshold, metrics by exact value."""

import random

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from gristmill.models import metrics, training
from gristmill.models.frame import holdout_split, model_frame, resolve_target, with_fold
from gristmill.plans.experiment import run_experiment
from gristmill.scratch import new_folder


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, (7 * i) % 5, 2 * i + 1) for i in range(60)], "x long, noise long, y long")


@pytest.fixture(scope="module")
def labeled(spark):
    return spark.createDataFrame(
        [(i, 60 - i, "high" if i >= 30 else "low") for i in range(60)], "a long, b long, label string"
    )


def test_linear(spark, points, store):
    model = training.train(points, "line", "y", "linear_regression")
    assert model.features == ["x", "noise"] and model.metrics["r2"] > 0.99
    assert model.metrics["rmse"] ** 2 == pytest.approx(model.metrics["mse"], abs=0.01)
    assert model.metrics["train_rows"] + model.metrics["test_rows"] == 60
    registry = training.ModelRegistry(spark, new_folder(spark, "models"))
    registry.save(model)
    assert [m["name"] for m in registry.list()] == ["line"]
    again = registry.get("LINE")
    assert training.predict_into(again, points.withColumn("_id", F.lit(1)), store, "predictions") == 60
    for row in store.read("predictions").collect():
        assert abs(row["predicted_y"] - row["y"]) < 1.0
    assert len(training.preview(training.predict(again, points))) == 50
    assert registry.delete(model.id) and not registry.delete(model.id)
    with pytest.raises(LookupError):
        registry.get("line")


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest_classification"])
def test_classifiers(labeled, kind):
    model = training.train(labeled, "c", "label", kind)
    assert model.metrics["accuracy"] >= 0.9
    for name in ("precision_weighted", "recall_weighted", "f1_weighted", "roc_auc"):
        assert 0 <= model.metrics[name] <= 1
    assert {r["predicted_label"] for r in training.predict(model, labeled.drop("label")).collect()} == {"high", "low"}


@pytest.mark.parametrize("kind", ["logistic_regression", "random_forest_classification"])
def test_classifiers_after_an_observation(spark, labeled, kind):
    seen = Observation()
    assert spark.range(5).observe(seen, F.count(F.lit(1)).alias("rows")).count() == 5 and seen.get["rows"] == 5
    model = training.train(labeled, "c", "label", kind)
    assert not model.pipeline.stages[1].hasSummary
    assert {r["predicted_label"] for r in training.predict(model, labeled).collect()} == {"high", "low"}


def test_importance_order(spark):
    chance = random.Random(1)
    data = []
    for _ in range(200):
        a, b, junk = chance.random(), chance.random(), chance.random()
        data.append((a, b, junk, 2 * a + 3 * b))
    df = spark.createDataFrame(data, "a double, b double, junk double, y double")
    ranked = training.feature_importance(df, "y", "linear_regression")
    assert [name for name, _ in ranked] == ["b", "a", "junk"] and ranked[2][1] < 0.05


def test_cross_validation(points):
    found = training.cross_validate(points, "y", "linear_regression", folds=50)
    assert found["folds"] == 10 and found["mean"] > 0.99 and not found["overfit_warning"]
    assert training.cross_validate(points, "y", "linear_regression", folds=1)["folds"] == 2


def test_frame_rules(spark, points):
    with pytest.raises(ValueError, match="noise, x, y"):
        model_frame(points, "z")
    with pytest.raises(ValueError, match="at least 10"):
        model_frame(points.limit(9), "y")
    with pytest.raises(ValueError, match="no numeric"):
        model_frame(points.select(F.lit("a").alias("t"), "y"), "y")
    with pytest.raises(ValueError, match="numeric for regression"):
        training.train(points.withColumn("y", F.lit("word")), "t", "y", "linear_regression")
    with pytest.raises(ValueError):
        training.train(points, "t", "y", "svm")


def test_split_is_stable_and_complete(spark):
    df = spark.range(1000)
    train, test = holdout_split(df, ["id"])
    again, _ = holdout_split(df.repartition(9), ["id"])
    assert train.count() + test.count() == 1000 and 700 < train.count() < 900
    assert sorted(r[0] for r in train.collect()) == sorted(r[0] for r in again.collect())


def test_classes_are_dealt_evenly_over_folds(spark):
    rare = spark.range(1000).selectExpr("id", "CASE WHEN id % 100 = 0 THEN 1.0D ELSE 0.0D END AS y")
    dealt = with_fold(rare, 5, ["id"], "y").groupBy("_fold", "y").count().collect()
    assert sorted((r["y"], r["count"]) for r in dealt) == [(0.0, 198)] * 5 + [(1.0, 2)] * 5


def test_targets():
    assert resolve_target(["CHURNED", "churned"], "churned") == "churned"
    assert resolve_target(["churned_flag", "churned_enc"], "churned") == "churned_enc"
    assert resolve_target(["a", "Churned"], "churned") == "Churned"
    assert resolve_target(["churned_encoded"], "churned") == "churned_encoded"
    assert resolve_target(["churned_flag"], "churned") == "churned_flag"
    assert resolve_target(["x"], "churned") is None


def test_selection_rules(spark):
    def chosen(*rows):
        return training.select_model(spark.createDataFrame(rows, "candidate string, mean double, std double"))

    forest, line = "random_forest_regression", "linear_regression"
    assert chosen((forest, 0.9, 0.1), (line, 0.85, 0.0)) == line
    assert chosen((forest, 0.9, 0.01), (line, 0.85, 0.0)) == forest
    assert chosen((line, 0.9, 0.1), ("logistic_regression", 0.95, 0.1)) == "logistic_regression"
    assert len(training.valid_candidates([*training.MODEL_TYPES, "x", forest])) == len(training.MODEL_TYPES)
    with pytest.raises(ValueError):
        training.valid_candidates(["x"])


def test_multiclass_metrics(spark):
    data = [("a", "a", 0.8, 0.1, 0.1), ("a", "b", 0.3, 0.5, 0.2), ("b", "b", 0.1, 0.8, 0.1), ("c", "c", 0.1, 0.2, 0.7), ("c", "a", 0.5, 0.1, 0.4)]
    df = spark.createDataFrame(data, "y string, p string, pa double, pb double, pc double")
    row = metrics.eval_classification(df, "y", "p").first()
    assert row["accuracy"] == 0.6 and row["test_rows"] == 5
    assert row["precision_weighted"] == pytest.approx(0.7) and row["recall_weighted"] == pytest.approx(0.6)
    asked = metrics.one_vs_rest(df, "y", {"a": "pa", "b": "pb", "c": "pc"})
    auc = {r["class"]: r["auc"] for r in metrics.eval_roc_auc(asked).collect()}
    assert auc == {"a": pytest.approx(5 / 6), "b": pytest.approx(1.0), "c": pytest.approx(1.0)}
    one = df.filter("y = 'a'").select("y", F.lit(0.5).alias("s"))
    assert metrics.weighted_auc(metrics.one_vs_rest(one, "y", {"a": "s", "b": "s"})).first()[0] is None
    assert metrics.diag_confusion(df, "y", "p").count() == 9


def test_experiment_prefers_the_simple_model(catalog, store, points):
    store.append("points", points)
    result = run_experiment(
        catalog,
        "dataset:points",
        "y",
        "SELECT DISTINCT x, noise, y FROM data",
        "SELECT x, noise, y FROM data",
        ["random_forest_regression", "linear_regression", "nonsense"],
        name="t",
    )
    assert result.chosen == "linear_regression" and result.results.count() == 2
    assert store.read("exp_t_predictions").count() == 60
