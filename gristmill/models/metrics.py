"""Metrics and diagnostic tables computed from a predictions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.joins import small_product
from gristmill.operators.ordered import sequence
from gristmill.operators.rows import sample_rows
from gristmill.operators.skew import DEFAULT, Skew
from gristmill.scratch import cut_lineage

DIGITS = 4


def eval_regression(
    predictions: DataFrame, actual: str, predicted: str, train_rows: int | None = None
) -> DataFrame:
    """r2, mae, mse, rmse and the number of rows, in one pass."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    sums = predictions.agg(
        F.count(y).alias("n"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.var_pop(y).alias("spread"),
    )
    return sums.select(
        F.round(1 - F.try_divide(F.col("mse"), F.col("spread")), DIGITS).alias("r2"),
        F.round("mae", DIGITS).alias("mae"),
        F.round("mse", DIGITS).alias("mse"),
        F.round(F.sqrt("mse"), DIGITS).alias("rmse"),
        F.lit(train_rows).cast("long").alias("train_rows"),
        F.col("n").alias("test_rows"),
    )


def _class_counts(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Per class: support, how often it was predicted, how often rightly."""
    pairs = predictions.groupBy(
        F.col(actual).cast("string").alias("a"), F.col(predicted).cast("string").alias("p")
    ).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col("a").alias("class"), F.col("n").alias("support"), F.lit(0).alias("chosen")),
        F.struct(F.col("p").alias("class"), F.lit(0).alias("support"), F.col("n").alias("chosen")),
    )
    right = F.when((F.col("a") == F.col("p")) & (F.col("s.support") > 0), F.col("n"))
    return (
        pairs.select("a", "p", "n", F.explode(sides).alias("s"))
        .groupBy("s.class")
        .agg(
            F.sum("s.support").alias("support"),
            F.sum("s.chosen").alias("chosen"),
            F.coalesce(F.sum(right), F.lit(0)).alias("right"),
        )
    )


def eval_classification(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; undefined ratios are 0."""
    zero = F.lit(0.0)
    scored = _class_counts(predictions, actual, predicted).withColumns(
        {
            "precision": F.coalesce(F.try_divide(F.col("right"), F.col("chosen")), zero),
            "recall": F.coalesce(F.try_divide(F.col("right"), F.col("support")), zero),
            "f1": F.coalesce(
                F.try_divide(2 * F.col("right"), F.col("support") + F.col("chosen")), zero
            ),
        }
    )

    def weighted(name: str) -> Column:
        mean = F.try_divide(F.sum(F.col(name) * F.col("support")), F.sum("support"))
        return F.round(mean, DIGITS)

    return scored.agg(
        F.round(F.try_divide(F.sum("right"), F.sum("support")), DIGITS).alias("accuracy"),
        weighted("precision").alias("precision_weighted"),
        weighted("recall").alias("recall_weighted"),
        weighted("f1").alias("f1_weighted"),
        F.sum("support").alias("test_rows"),
    )


def one_vs_rest(
    predictions: DataFrame, actual: str, scores: dict[str, str]
) -> DataFrame:
    """(class, score, hit) rows; ``scores`` maps a class to its score column.

    Two classes are one question about the second class, more are one per class.
    """
    names = sorted(scores)
    asked = names[1:] if len(names) == 2 else names
    rows = [
        F.struct(
            F.lit(c).alias("class"),
            F.col(scores[c]).cast("double").alias("score"),
            (F.col(actual).cast("string") == c).alias("hit"),
        )
        for c in asked
    ]
    return predictions.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def _by_score(asked: DataFrame) -> DataFrame:
    """Hits and misses per class and distinct score: ties become one row."""
    return asked.groupBy("class", "score").agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses")
    )


def eval_roc_auc(asked: DataFrame, skew: Skew = DEFAULT) -> DataFrame:
    """(class, auc, hits): ties count half; null with one outcome only."""
    placed = sequence(
        _by_score(asked),
        ["class"],
        [("score", "asc")],
        {"below": ("running_sum", "misses")},
        skew,
        derived=True,
    )
    won = F.col("hits") * (F.col("below") - F.col("misses") + F.col("misses") / 2)
    return placed.groupBy("class").agg(
        F.try_divide(F.sum(won), (F.sum("hits") * F.sum("misses")).cast("double")).alias("auc"),
        F.sum("hits").alias("hits"),
    )


def weighted_auc(asked: DataFrame, skew: Skew = DEFAULT) -> DataFrame:
    """One row: the support-weighted mean over the classes that have an AUC."""
    scored = eval_roc_auc(asked, skew).filter(F.col("auc").isNotNull())
    mean = F.try_divide(F.sum(F.col("auc") * F.col("hits")), F.sum("hits"))
    return scored.agg(F.round(mean, DIGITS).alias("roc_auc"))


def diag_roc_curve(asked: DataFrame, skew: Skew = DEFAULT) -> DataFrame:
    """(class, threshold, fpr, tpr): one point per distinct score."""
    placed = sequence(
        _by_score(asked),
        ["class"],
        [("score", "desc")],
        {
            "hits_upto": ("running_sum", "hits"),
            "misses_upto": ("running_sum", "misses"),
            "hits_all": ("total_sum", "hits"),
            "misses_all": ("total_sum", "misses"),
        },
        skew,
        derived=True,
    )
    return placed.select(
        "class",
        F.col("score").alias("threshold"),
        F.try_divide(F.col("misses_upto"), F.col("misses_all")).alias("fpr"),
        F.try_divide(F.col("hits_upto"), F.col("hits_all")).alias("tpr"),
    )


def diag_confusion(predictions: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Counts for every (actual, predicted) pair of known classes, zeros included."""
    a, p = F.col(actual).cast("string"), F.col(predicted).cast("string")
    # A few rows that are read several times: computed once.
    counts = cut_lineage(
        predictions.groupBy(a.alias("actual"), p.alias("predicted")).agg(
            F.count(F.lit(1)).alias("count")
        )
    )
    classes = (
        counts.select(F.explode(F.array("actual", "predicted")).alias("c"))
        .filter("c IS NOT NULL")
        .distinct()
    )
    pairs = small_product(
        classes.withColumnRenamed("c", "actual"), classes.withColumnRenamed("c", "predicted")
    )
    return pairs.join(counts, ["actual", "predicted"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )


def diag_pred_vs_actual(
    predictions: DataFrame, key: str, actual: str, predicted: str, n: int = 500
) -> DataFrame:
    """A repeatable sample of (actual, predicted, residual) points."""
    points = predictions.select(
        key,
        F.col(actual).alias("actual"),
        F.col(predicted).alias("predicted"),
        (F.col(actual) - F.col(predicted)).alias("residual"),
    )
    return sample_rows(points, key, n)


def compare_scores(
    a: DataFrame, b: DataFrame, key: list[str], actual: str, predicted: str
) -> DataFrame:
    """Two predictions of the same rows side by side: metric per model, difference."""
    joined = a.select(*key, F.col(actual).alias("_y"), F.col(predicted).alias("_a")).join(
        b.select(*key, F.col(predicted).alias("_b")), key
    )
    y = F.col("_y").cast("double")
    errors = {n: F.col(c).cast("double") - y for n, c in (("a", "_a"), ("b", "_b"))}
    sums = joined.agg(
        F.count(F.lit(1)).alias("rows"),
        F.var_pop(y).alias("spread"),
        *[F.avg(F.abs(e)).alias(f"mae_{n}") for n, e in errors.items()],
        *[F.avg(e * e).alias(f"mse_{n}") for n, e in errors.items()],
    )
    r2 = {n: 1 - F.try_divide(F.col(f"mse_{n}"), F.col("spread")) for n in "ab"}
    rows = [
        ("mae", F.col("mae_a"), F.col("mae_b")),
        ("rmse", F.sqrt("mse_a"), F.sqrt("mse_b")),
        ("r2", r2["a"], r2["b"]),
    ]
    listed = F.array(
        *[
            F.struct(
                F.lit(name).alias("metric"),
                F.round(left, DIGITS).alias("a"),
                F.round(right, DIGITS).alias("b"),
                F.round(right - left, DIGITS).alias("difference"),
            )
            for name, left, right in rows
        ]
    )
    return sums.select("rows", F.explode(listed).alias("m")).select("rows", "m.*")
