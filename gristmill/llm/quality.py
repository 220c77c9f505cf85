"""Quality rules: simple limits, then robust outliers among statistic vectors.

Every document is described by counts over its whole text. Per language and source a
minimum-covariance-determinant estimate (the mean and covariance of the three quarters
of the documents that lie closest together) is found by concentration steps, and
documents far from it by Mahalanobis distance are rejected. Steps go on from three starts
(medians, modes, and the moments of all documents) until the determinant falls no more; of
what they reach the smallest determinant counts, the first of equal ones.

All sums are over integers, so the estimates do not depend on the order of the rows.
A step groups the documents of a group by distance class before it sums, so no group is
gathered anywhere: what is shuffled is at most ``CLASSES`` rows per group and task.

Defined results: a null or empty text has no words and fails the base rules; null
language or source is a group of its own; groups with fewer than ``min_docs`` documents
that pass the base rules are judged by the estimate of their language, or else by that
of all documents, or, below that, by the base rules alone. Repeated rows each count and
each get the same verdict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.texts import SPACES, nullable, stored, words

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = r"[#*$%&|<>]"

# The transformed statistics, in thousandths, and the least standard deviation a group
# is taken to have in each: documents must differ visibly to be called outliers.
FLOORS = {"length": 300, "word_length": 100, "symbols": 30, "dup_lines": 120, "repeats": 100}
VECTOR = list(FLOORS)
DIMENSIONS = len(VECTOR)
CLASSES = 1024
# Median of the chi-squared law with five degrees of freedom.
CHI2_MEDIAN = 4.351
# Its 0.999999 quantile: about one clean document in a million is rejected by chance.
CUTOFF = 35.9
# An estimate: whose it is, where it started, and the logarithm of its determinant.
OWNER = ["level", "start"]
ESTIMATE = ["logdet", "mean", "white"]
# A start has settled once a step lowers the logarithm by no more than this.
SETTLED = 1e-9


def _layers(docs: DataFrame, text: Column, keep: list[Column]) -> DataFrame:
    """The counts of each text, beside ``keep``.

    Arrays that later expressions index are projected first, so each is built once.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACES}]"))
    parts = docs.select(
        *keep,
        words(text).alias("_w"),
        lines.alias("_l"),
        F.length(F.regexp_replace(text, f"[{SPACES}]+", "")).alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS.replace("[", "[^") + "+", "")).alias("n_symbols"),
    )
    kept = [c for c in parts.columns if not c.startswith("_")]
    # Windows of three words by hash, sorted with their places: equal ones are neighbours.
    hashed = parts.select(
        *kept,
        F.size("_w").alias("n_words"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
    )
    kept = [c for c in hashed.columns if not c.startswith("_")]
    sorted_windows = hashed.select(
        *kept,
        F.when(
            F.col("n_words") >= 3,
            F.sort_array(
                F.transform(
                    F.slice("_h", 1, F.greatest(F.col("n_words") - 2, F.lit(0))),
                    lambda h, i: F.struct(
                        F.xxhash64(h, F.get("_h", i + 1), F.get("_h", i + 2)).alias("h"), i.alias("i")
                    ),
                )
            ),
        ).alias("_s"),
    )
    # Places of windows whose hash equals that of a neighbour, in text order.
    places = sorted_windows.select(
        *kept,
        F.sort_array(
            F.transform(
                F.filter(
                    F.coalesce("_s", F.array()),
                    lambda s, i: F.coalesce(s["h"] == F.get("_s", i - 1)["h"], F.lit(False))
                    | F.coalesce(s["h"] == F.get("_s", i + 1)["h"], F.lit(False)),
                ),
                lambda s: s["i"],
            )
        ).alias("_p"),
    )
    # A repeated window covers three words, less what the next one covers too.
    covered = F.aggregate(
        F.transform("_p", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_p", i + 1) - p, F.lit(3)))),
        F.lit(0),
        lambda total, part: total + part,
    )
    return places.select(*[c for c in kept if c not in COUNTS], *_counts(covered))


def _counts(covered: Column) -> list[Column]:
    plain = [c for c in COUNTS if c != "n_repeat_words"]
    return [F.col(c).cast("long").alias(c) for c in plain] + [covered.cast("long").alias("n_repeat_words")]


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(max_repeat_percent) * F.col("n_words")
    )


def _vector() -> Column:
    """The statistics of a document, in whole thousandths."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.lit(1000) * F.col("n_dup_lines") / F.greatest(F.floor(n / 10), F.lit(1))
    parts = {
        "length": F.lit(1000) * F.log1p(F.col("n_words")),
        "word_length": F.lit(1000) * F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        "symbols": F.lit(1000) * F.col("n_symbols") / n,
        "dup_lines": F.least(lines, F.lit(1000)),
        "repeats": F.lit(1000) * F.col("n_repeat_words") / n,
    }
    return F.array(*[F.round(parts[name]).cast("long") for name in VECTOR])


def _levels() -> Column:
    """The groups a document is counted in: its own, its language's, and all."""
    lang, source = nullable("lang"), nullable("source")
    return F.array(
        F.concat_ws("\x00", F.lit("2"), lang, source),
        F.concat_ws("\x00", F.lit("1"), lang),
        F.lit("0"),
    )


def _distance(x: Column, model: Column) -> Column:
    """Squared Mahalanobis distance: the sum of squares of the whitened vector."""
    centred = [x[i] - model["mean"][i] for i in range(DIMENSIONS)]
    total = F.lit(0.0)
    for i in range(DIMENSIONS):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + model["white"][i * DIMENSIONS + j] * centred[j]
        total = total + row * row
    return total


def _class(distance: Column) -> Column:
    """Distances in classes of about two per cent, fewer than ``CLASSES``."""
    return F.least(F.lit(CLASSES - 1), F.floor(F.lit(24) * F.log2(F.lit(1.0) + distance))).cast("int")


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i + 1)]


def _sums() -> list[Column]:
    x = F.col("x")
    exact = [F.sum(x[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(DIMENSIONS)]
    return exact + [F.sum((x[i] * x[j]).cast("decimal(20,0)")).alias(f"s{i}_{j}") for i, j in PAIRS]


def _whiten(sums: DataFrame) -> DataFrame:
    """Mean, and the inverse of the covariance's Cholesky factor, of each group.

    The factor is found column by column in plain expressions; the squared floors on the
    diagonal keep it defined where a statistic does not vary.
    """
    d, floors = range(DIMENSIONS), list(FLOORS.values())
    terms = {f"m{i}": f"cast(s{i} as double) / taken" for i in d}
    terms |= {f"c{i}_{j}": f"cast(s{i}_{j} as double) / taken - m{i} * m{j}" for i, j in PAIRS}
    for i, j in PAIRS:
        rest = " - ".join([f"c{i}_{j}", *[f"l{i}_{k} * l{j}_{k}" for k in range(j)]])
        below = f"sqrt(greatest({rest}, 0D) + {float(floors[i] ** 2)}D)"
        terms[f"l{i}_{j}"] = below if i == j else f"({rest}) / l{j}_{j}"
    for i in d:
        for j in reversed(range(i)):
            inner = " + ".join(f"l{i}_{k} * w{k}_{j}" for k in range(j, i))
            terms[f"w{i}_{j}"] = f"-({inner}) / l{i}_{i}"
        terms[f"w{i}_{i}"] = f"1D / l{i}_{i}"
    white = ", ".join(f"w{i}_{j}" if j <= i else "0D" for i in d for j in d)
    # Each term may use those before it.
    found = sums.selectExpr("*", *[f"{term} as {name}" for name, term in terms.items()])
    logdet = " + ".join(f"2D * ln(l{i}_{i})" for i in d)
    mean = ", ".join(f"m{i}" for i in d)
    return found.selectExpr(*OWNER, "n as docs", f"{logdet} as logdet", f"array({mean}) as mean", f"array({white}) as white")


def _closest(rows: DataFrame, share: float) -> DataFrame:
    """Estimates from the classes of each owner that hold its ``share`` closest documents.

    rows: level, start, class, x. Whole classes are taken, up to the one that reaches the share.
    """
    classes = rows.groupBy(*OWNER, "class").agg(F.count(F.lit(1)).alias("k"), *_sums())
    by_distance = Window.partitionBy(*OWNER).orderBy("class")
    before = F.coalesce(F.sum("k").over(by_distance.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = classes.select(
        "*", before.alias("before"), F.sum("k").over(Window.partitionBy(*OWNER)).alias("n")
    ).where(F.col("before") < F.col("n") * share)
    names = [f"s{i}" for i in range(DIMENSIONS)] + [f"s{i}_{j}" for i, j in PAIRS]
    return _whiten(
        chosen.groupBy(*OWNER).agg(
            F.max("n").alias("n"), F.sum("k").alias("taken"), *[F.sum(c).alias(c) for c in names]
        )
    )


def _starts(rows: DataFrame) -> DataFrame:
    """Three starts of each level: coordinatewise medians (0) and modes (1) with the floors as
    scales, and the mean and covariance of all its documents (2)."""
    values = rows.select("level", F.posexplode("x").alias("i", "v"))
    # Values in classes of 20 thousandths: a bounded number per level and statistic.
    counted = values.groupBy("level", "i", F.floor(F.col("v") / 20).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    along = Window.partitionBy("level", "i").orderBy("c")
    upto = F.sum("k").over(along.rowsBetween(Window.unboundedPreceding, 0))
    middle = (
        counted.select("level", "i", "c", "k", upto.alias("upto"), F.sum("k").over(Window.partitionBy("level", "i")).alias("n"))
        .groupBy("level", "i")
        .agg(
            F.min(F.when(F.lit(2) * F.col("upto") >= F.col("n"), F.col("c"))).alias("median"),
            F.min_by("c", F.struct(-F.col("k"), "c")).alias("mode"),
            F.max("n").alias("docs"),
        )
    )
    scales = [0.0] * DIMENSIONS**2
    for i, floor in enumerate(FLOORS.values()):
        scales[i * DIMENSIONS + i] = 1.0 / (2 * floor)

    def centre(name: str) -> Column:
        at = (F.col(name) * 20 + 10).cast("double").alias("m")
        return F.transform(F.array_sort(F.collect_list(F.struct("i", at))), lambda s: s["m"])

    centres = middle.groupBy("level").agg(F.max("docs").alias("docs"), F.array(centre("median"), centre("mode")).alias("both"))
    plain = centres.select("level", "docs", F.posexplode("both").alias("start", "mean")).select(
        *OWNER, "docs", "mean", F.array(*map(F.lit, scales)).alias("white")
    )
    taken = [F.count(F.lit(1)).alias("n"), F.count(F.lit(1)).alias("taken")]
    moments = _whiten(rows.groupBy("level", F.lit(2).alias("start")).agg(*taken, *_sums()))
    # A start is no estimate of a share of the documents: any step is better.
    return plain.unionByName(moments.drop("logdet")).withColumn("logdet", F.lit(float("inf")))


def estimates(counts: DataFrame, share: float = 0.75, steps: int = 100, min_docs: int = 30) -> DataFrame:
    """One estimate per language and source, per language, and over all documents.

    counts: lang, source and the counts of ``document_counts``. Returns level, docs, logdet, mean,
    white (row-major inverse Cholesky factor, scaled so that the median distance is that
    of the chi-squared law). Levels with fewer than ``min_docs`` documents have none. Starts
    settle after a few steps each; ``steps`` is only a bound.
    """
    # Written once: every step plans and reads it again.
    usable = stored(counts.where(~base_failed()).select(F.explode(_levels()).alias("level"), _vector().alias("x")), "vectors")

    def classed(model: DataFrame) -> DataFrame:
        # Written tables: the planner broadcasts an estimate table only while it is small.
        joined = usable.join(model.select(*OWNER, F.struct("mean", "white").alias("model")), "level")
        return joined.select(*OWNER, "x", _class(_distance(F.col("x"), F.col("model"))).alias("class"))

    columns = [*OWNER, "docs", *ESTIMATE]
    model = stored(_starts(usable).where(F.col("docs") >= min_docs).select(*columns), "mcd")
    settled = []
    for _ in range(steps):
        reached = _closest(classed(model), share).select(*OWNER, "docs", F.struct(*ESTIMATE).alias("new"))
        both = reached.join(model.select(*OWNER, F.struct(*ESTIMATE).alias("old")), OWNER)
        better = F.when(F.col("new.logdet") < F.col("old.logdet"), F.col("new")).otherwise(F.col("old"))
        falls = F.col("new.logdet") < F.col("old.logdet") - SETTLED
        step = stored(both.select(*OWNER, "docs", better.alias("best"), falls.alias("falls")), "mcd")
        settled.append(step.where("not falls").select(*OWNER, "docs", "best.*"))
        model = step.where("falls").select(*OWNER, "docs", "best.*")
        if model.isEmpty():
            break
    # One row per level and start.
    ends = reduce(DataFrame.unionByName, settled, model)
    chosen = F.min_by(F.struct("start", "docs", *ESTIMATE), F.struct("logdet", "start"))
    model = stored(ends.groupBy("level").agg(chosen.alias("best")).select("level", "best.*"), "mcd")
    # Consistency: the median distance of a group is brought to that of the law.
    along = Window.partitionBy("level").orderBy("class").rowsBetween(Window.unboundedPreceding, 0)
    counted = classed(model).groupBy("level", "class").agg(F.count(F.lit(1)).alias("k"))
    middle = (
        counted.select("level", "class", F.sum("k").over(along).alias("upto"), F.sum("k").over(Window.partitionBy("level")).alias("n"))
        .where(F.lit(2) * F.col("upto") >= F.col("n"))
        .groupBy("level")
        .agg(F.min("class").alias("class"))
    )
    median = F.pow(F.lit(2.0), (F.col("class") + 1) / 24.0) - 1
    scale = F.sqrt(F.lit(CHI2_MEDIAN) / F.greatest(median, F.lit(CHI2_MEDIAN)))
    scaled = model.join(middle, "level").select(
        "level", "docs", "logdet", "mean", F.transform("white", lambda w: w * scale).alias("white")
    )
    return stored(scaled, "mcd")


def document_counts(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """``keep`` and the counts over each whole text: words, their characters, symbols,
    lines equal to an earlier one, words in repeated windows of three words.

    Windows are compared by 64-bit hash within a document.
    """
    return _layers(docs, F.col(text), keep or [])


def verdicts(counts: DataFrame, model: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Add base_failed, distance (null where no estimate applies) and kept.

    counts may carry further columns. The estimate tables are joined one level at a time,
    the most specific that exists counts.
    """
    levels = _levels()
    found = counts
    for depth in range(3):
        table = model.select(
            F.col("level").alias(f"_at{depth}"), F.struct("mean", "white").alias(f"_model{depth}")
        )
        found = found.withColumn("_key", levels[depth]).join(table, F.col("_key") == F.col(f"_at{depth}"), "left")
        found = found.drop("_key", f"_at{depth}")
    chosen = F.coalesce(*[F.col(f"_model{depth}") for depth in range(3)])
    found = found.withColumn("_model", chosen).withColumn("_x", _vector())
    found = found.withColumn("distance", _distance(F.col("_x"), F.col("_model")))
    failed = base_failed()
    kept = ~failed & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    hidden = ["_model", "_x", *[f"_model{depth}" for depth in range(3)]]
    return found.withColumns({"base_failed": failed, "kept": kept}).drop(*hidden)


def quality_report(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance of every row of ``docs``."""
    keep = [F.col("doc_id"), F.col("lang"), F.col("source")]
    counts = stored(document_counts(docs, keep=keep), "counts")
    judged = verdicts(counts, estimates(counts), cutoff)
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", F.round("distance", 3).alias("distance"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns unchanged.

    The counts are made twice, so that texts are never shuffled.
    """
    keep = [F.col("lang"), F.col("source")]
    counts = stored(document_counts(docs, keep=keep), "counts")
    whole = docs.select(F.struct("*").alias("row"))
    again = document_counts(
        whole, "row.text", [F.col("row"), F.col("row.lang").alias("lang"), F.col("row.source").alias("source")]
    )
    judged = verdicts(again, estimates(counts), cutoff)
    # A generator, not a filter: the optimizer would copy the verdict's expressions, once
    # for each use of a column, into a filter below the joins.
    return judged.select(F.inline(F.slice(F.array("row"), 1, F.col("kept").cast("int"))))
