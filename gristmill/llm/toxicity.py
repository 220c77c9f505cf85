"""Toxicity scores by a small convolutional text classifier, trained here in numpy.

Words are hashed to embeddings twice, whole and by their first letters, so that unseen
endings are recognised. Filters of several widths slide over the words of a text, each
keeps its largest response (zero if none is positive or the text is shorter than the
filter), and a logistic layer turns these into a score.

Training uses at most ``max_docs`` labelled documents per class of at most ``max_words``
words, chosen by hash of the id; only these are collected. Scoring reads every whole text
once; since a convolution is linear in the embeddings, each word's share in every filter
is looked up in one table. Language, source and id are never inputs of a score. The id
chooses the documents trained on, and the language the calibrated threshold: beside the
fixed one, ``flagged`` uses the threshold that is best over all labelled rows of the
language that may be learnt from, each counted, and one for all languages where a row's
is unknown or has too few of either class.

Defined results: null, empty and wordless texts get the score of a text without any
response; labels that are null or whose document is missing are not used, of repeated
labels of an id the largest counts; without labels of both classes every score is the
share of label 1 among those there are (0 without any); repeated rows are each scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower, portions, stored

BUCKETS = 1 << 16
HEAD = 4
WIDTHS = (1, 2, 3)
SLOTS = sum(WIDTHS)
BINS = 1 << 14  # of scores, for the thresholds; a power of two, so edges are exact


def _hashed(text: Column) -> list[Column]:
    """Buckets of the words of a text, and of their first letters."""
    clean = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    words = F.split(clean, " ")

    def bucket(word):
        return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")

    none = F.array().cast("array<int>")
    return [
        F.when(clean == "", none).otherwise(F.transform(words, bucket)).alias("words"),
        F.when(clean == "", none).otherwise(F.transform(words, lambda w: bucket(F.substring(w, 1, HEAD)))).alias("heads"),
    ]


@dataclass
class Model:
    """Embeddings of words and heads, filters per width, and the logistic layer."""

    STEP: ClassVar[int] = 1 << 15  # words scored at a time
    prior: float
    words: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    heads: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 1), np.float32))
    filters: list[np.ndarray] = field(default_factory=list)
    biases: list[np.ndarray] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0

    def tables(self) -> list[np.ndarray]:
        """For each embedding, a word's share in each slot of each filter."""
        stacked = np.concatenate([f for width in self.filters for f in width], axis=1)
        return [self.words @ stacked, self.heads @ stacked]

    def scores(self, tables: list[np.ndarray], words: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One score per text. ends: where each text ends in the word arrays."""
        if self.weights is None:
            return np.full(len(ends), self.prior)
        starts = np.concatenate([[0], ends[:-1]])
        best = np.full((len(ends), len(self.weights)), -np.inf, np.float32)
        text = np.repeat(np.arange(len(ends)), ends - starts)
        for first in range(0, len(words), self.STEP):
            # Windows that begin in this stretch; it reads on as far as they reach.
            last = min(first + self.STEP, len(words))
            reach = min(last + max(WIDTHS) - 1, len(words))
            shares = tables[0][words[first:reach]] + tables[1][heads[first:reach]]
            left = ends[text[first:last]] - np.arange(first, last)  # words to the text's end
            begins = np.flatnonzero(np.diff(text[first:last], prepend=-1))
            into = text[first:last][begins]
            n, slot = self.filters[0].shape[2], 0
            for k, width in enumerate(WIDTHS):
                response = np.full((last - first, n), -np.inf, np.float32)
                whole = min(last - first, len(shares) - width + 1)
                if whole > 0:
                    response[:whole] = sum(
                        shares[j : j + whole, (slot + j) * n : (slot + j + 1) * n] for j in range(width)
                    )
                response[left < width] = -np.inf
                columns = slice(k * n, (k + 1) * n)
                best[into, columns] = np.maximum(best[into, columns], np.maximum.reduceat(response, begins, axis=0))
                slot += width
        pooled = np.maximum(best + np.concatenate(self.biases), 0)
        return 1 / (1 + np.exp(-(pooled @ self.weights + self.bias)))


def _log_odds(ids: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Smoothed log odds of the classes by bucket, over documents."""
    counts = np.zeros((2, BUCKETS))
    for doc, label in zip(ids, toxic, strict=True):
        counts[int(label), np.unique(doc)] += 1
    totals = np.array([(toxic == 0).sum(), (toxic == 1).sum()])[:, None]
    rates = (counts + 1) / (totals + 2)
    seen = counts.sum(axis=0)
    return (np.log(rates[1] / rates[0]) * seen / (seen + 3)).clip(-4, 4).astype(np.float32)


def fit(
    words: list[np.ndarray],
    heads: list[np.ndarray],
    toxic: np.ndarray,
    prior: float,
    size: int = 8,
    per_width: int = 8,
    epochs: int = 6,
    rate: float = 0.05,
    seed: int = 7,
) -> Model:
    """Train on documents given as bucket arrays. prior: the true share of label 1.

    The first embedding coordinate starts as the log odds of the bucket. Classes are
    weighted back to the prior. Only the winning windows of the max pooling have a
    gradient, so a step touches few embeddings (Adagrad).
    """
    toxic = np.asarray(toxic)
    if len(set(toxic.tolist())) < 2:
        return Model(prior=prior)
    rng = np.random.default_rng(seed)
    tables = []
    for ids in (words, heads):
        table = rng.normal(0, 0.02, (BUCKETS, size)).astype(np.float32)
        table[:, 0] = _log_odds(ids, toxic) / 2
        tables.append(table)
    # filters[k]: width x size x number of filters
    filters = [rng.normal(0, 0.1, (w, size, per_width)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : per_width // 2] += 1.0 / len(f)
    biases = [np.full(per_width, -0.25, np.float32) for _ in WIDTHS]
    weights = rng.normal(0.3, 0.1, len(WIDTHS) * per_width).astype(np.float32)
    share = toxic.mean()
    by_class = np.array([(1 - prior) / (1 - share), prior / share])
    bias = float(np.log(prior / (1 - prior)))
    seen = [np.full_like(t, 1e-3) for t in tables]
    seen_f = [np.full_like(f, 1e-3) for f in filters]
    seen_b = [np.full_like(b, 1e-3) for b in biases]
    seen_w, seen_bias = np.full_like(weights, 1e-3), 1e-3
    order = [i for i in range(len(toxic)) if len(words[i])]
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(order), max(1, len(order) // 32)):
            pooled = np.zeros((len(batch), len(weights)), np.float32)
            places = np.zeros(pooled.shape, np.int64)
            for row, i in enumerate(batch):
                vectors = tables[0][words[i]] + tables[1][heads[i]]
                for k, width in enumerate(WIDTHS):
                    if len(vectors) < width:
                        continue
                    n = len(vectors) - width + 1
                    response = sum(vectors[j : j + n] @ filters[k][j] for j in range(width)) + biases[k]
                    at = response.argmax(axis=0)
                    columns = slice(k * per_width, (k + 1) * per_width)
                    places[row, columns] = at
                    pooled[row, columns] = np.maximum(response[at, np.arange(per_width)], 0)
            score = 1 / (1 + np.exp(-(pooled @ weights + bias)))
            slope = (score - toxic[batch]) * by_class[toxic[batch]] / len(batch)
            back = np.where(pooled > 0, slope[:, None] * weights, 0)
            step = pooled.T @ slope
            seen_w += step**2
            weights = (weights - rate * step / np.sqrt(seen_w)).astype(np.float32)
            seen_bias += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(seen_bias)
            for k, width in enumerate(WIDTHS):
                columns = slice(k * per_width, (k + 1) * per_width)
                row, col = np.nonzero(back[:, columns])
                if not len(row):
                    continue
                g = back[:, columns][row, col]
                at = places[:, columns][row, col]
                for j in range(width):
                    ids = [np.array([source[batch[r]][p + j] for r, p in zip(row, at, strict=True)]) for source in (words, heads)]
                    vectors = tables[0][ids[0]] + tables[1][ids[1]]
                    inward = g[:, None] * filters[k][j][:, col].T
                    grad = np.zeros_like(filters[k][j])
                    np.add.at(grad.T, col, g[:, None] * vectors)
                    seen_f[k][j] += grad**2
                    filters[k][j] -= rate * grad / np.sqrt(seen_f[k][j])
                    for t in range(2):
                        touched, inverse = np.unique(ids[t], return_inverse=True)
                        grad_t = np.zeros((len(touched), size), np.float32)
                        np.add.at(grad_t, inverse, inward)
                        seen[t][touched] += grad_t**2
                        tables[t][touched] -= rate * grad_t / np.sqrt(seen[t][touched])
                grad_b = np.zeros(per_width, np.float32)
                np.add.at(grad_b, col, g)
                seen_b[k] += grad_b**2
                biases[k] -= rate * grad_b / np.sqrt(seen_b[k])
    return Model(prior, tables[0], tables[1], filters, biases, weights, float(bias))


def _marked(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of every labelled id, the largest label of repeated ones."""
    known = labels.where("doc_id is not null and toxic is not null")
    return known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def limits(scored: DataFrame, labels: DataFrame, least: int = 20) -> DataFrame:
    """lang (null: all languages) and the threshold of the best F1 over every labelled row.

    scored: doc_id, lang and score. Rows are counted by language, label and bin of scores;
    thresholds are lower edges of bins, of equal ones the highest. A language needs ``least``
    rows of either class, all languages together one.
    """
    edge = F.floor(F.col("score") * BINS)
    rows = scored.where("doc_id is not null").groupBy("doc_id", "lang", edge.alias("bin")).count()
    counts = (
        rows.join(_marked(labels), "doc_id")
        .groupBy("lang", "bin")
        .agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("toxic")).alias("hits"))
    )
    # The whole, then the language: at most BINS + 1 rows of either.
    alone = F.when(F.col("lang").isNotNull(), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    grouped = (
        counts.withColumn("own", F.explode(alone))
        .groupBy("own", F.when(F.col("own"), F.col("lang")).alias("lang"), "bin")
        .agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    )
    group = Window.partitionBy("own", "lang")
    down = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    summed = grouped.select(
        "own",
        "lang",
        "bin",
        F.sum("n").over(down).alias("flagged"),
        F.sum("hits").over(down).alias("found"),
        F.sum("n").over(group).alias("n"),
        F.sum("hits").over(group).alias("hits"),
    )
    need = F.when(F.col("own"), least).otherwise(1)
    enough = summed.where((F.col("hits") >= need) & (F.col("n") - F.col("hits") >= need))
    f1 = 2 * F.col("found") / (F.col("flagged") + F.col("hits"))
    best = F.max(F.struct(f1.alias("f1"), "bin"))["bin"]
    return enough.groupBy("own", "lang").agg((best / BINS).alias("threshold")).select("lang", "threshold")


def flag(scored: DataFrame, found: DataFrame, default: float = 0.3) -> DataFrame:
    """scored with the threshold of each row's language, or that of all, and flagged."""
    whole = found.where("lang is null").first()  # one row, or none without labels of both classes
    known = found.where("lang is not null")
    limit = F.coalesce("threshold", F.lit(whole.threshold if whole else default))
    return scored.join(known, "lang", "left").withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))


def train(
    docs: DataFrame,
    labels: DataFrame,
    max_docs: int = 5000,
    max_words: int = 20_000,
    seed: int = 7,
    **options,
) -> Model:
    """A model of ``labels.toxic`` (doc_id, toxic) on the texts of ``docs``."""
    marked = _marked(labels)
    shares = {row.toxic: row["count"] for row in marked.groupBy("toxic").count().collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.0
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = [marked.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(max_docs) for c in (0, 1)]
    sample = chosen[0].unionAll(chosen[1])
    # Broadcast: at most 2 * max_docs rows of two numbers.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    hashed = found.select("doc_id", "toxic", *_hashed(F.col("text")))
    rows = hashed.where(F.size("words") <= max_words).orderBy("doc_id").toPandas()
    words = [np.asarray(w, np.int32) for w in rows.words]
    heads = [np.asarray(h, np.int32) for h in rows.heads]
    toxic = rows.toxic.to_numpy(dtype=np.int64)
    return fit(words, heads, toxic, prior, seed=seed, **options)


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, lang, score and predicted (score >= cut) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.tables() if model.weights is not None else []
        for batch in portions(batches, 2):
            words, heads = batch.column(2), batch.column(3)
            ends = words.offsets.to_numpy()[1:] - words.offsets[0].as_py()
            found = model.scores(tables, words.flatten().to_numpy(), heads.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["doc_id", "lang", "score"]
            )

    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), *_hashed(F.col("text"))
    )
    scored = hashed.mapInArrow(score_all, "doc_id bigint, lang string, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def held_out() -> Column:
    """Whether a document's id is in the fold that labels are never learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of every row of ``docs`` by a model that never saw the held-out fold."""
    learnt = labels.where(~held_out())
    scored = stored(score(docs, train(docs, learnt)), "scores")
    flagged = flag(scored, stored(limits(scored, learnt), "limits"))
    return flagged.select("doc_id", held_out().alias("held_out"), "score", "predicted", "threshold", "flagged")
