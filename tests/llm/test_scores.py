import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gristmill.llm import lm_score, toxicity
from gristmill.llm.texts import portions

from .helpers import DOCUMENTS, ascii_lower, awkward, prose, word_list

FOLDER = "/root/testdata/sf0.1"


@pytest.mark.parametrize("block, part", [(1 << 19, 1 << 22), (50, 16), (1, 1)])
def test_losses_against_plain_counts(spark, monkeypatch, block, part):
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "PART", part)
    rng = np.random.default_rng(4)
    texts = {i: prose(rng, int(rng.integers(1, 40)), 30) for i in range(40)}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCUMENTS)
    marked = docs.where("doc_id % 3 = 0").select("doc_id")
    found = {r.doc_id: r for r in lm_score.cross_entropy_difference(docs, marked).collect()}
    vocabulary = len({w for t in texts.values() for w in t.split()})

    def pairs(words):
        return list(zip([None] + words[:-1], words))

    def loss(own, corpus, scale):
        """Mean loss of a text in a model of the other texts of a corpus."""
        single, pair_counts, total = {}, {}, 0
        for i, text in corpus.items():
            if i == own:
                continue
            for pair in pairs(text.split()):
                single[pair[1]] = single.get(pair[1], 0) + scale
                pair_counts[pair] = pair_counts.get(pair, 0) + scale
                total += scale
            single[None] = single.get(None, 0) + scale
        total_loss, at = 0, pairs(texts[own].split())
        for before, w in at:
            alone = (single.get(w, 0) + lm_score.ALPHA) / (total + lm_score.ALPHA * vocabulary)
            pair = pair_counts.get((before, w), 0)
            total_loss -= math.log((pair + lm_score.MU * alone) / (single.get(before, 0) + lm_score.MU))
        return total_loss / len(at)

    target = {i: t for i, t in texts.items() if i % 3 == 0}
    n_target, n_all = (sum(len(t.split()) for t in c.values()) for c in (target, texts))
    for i in texts:
        r = found[i]
        assert r.n_tokens == len(texts[i].split())
        assert r.target_loss == pytest.approx(loss(i, target, 1), rel=1e-9)
        assert r.background_loss == pytest.approx(loss(i, texts, n_target / n_all), rel=1e-9)
        assert r.score == pytest.approx(r.target_loss - r.background_loss)


def test_counts_of_many_bigrams_stay_apart(spark, monkeypatch):
    """Many more bigrams than one part holds: every total is that of its own bigram."""
    monkeypatch.setattr(lm_score, "BLOCK", 10_000)
    monkeypatch.setattr(lm_score, "PART", 30_000)
    rng = np.random.default_rng(5)
    texts = [prose(rng, 2_000, 100_000) + f" often {i % 3}" * i for i in range(100)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCUMENTS)
    blocks = lm_score.word_blocks(docs, docs.where("doc_id < 50")).cache()
    partial = lm_score.block_counts(blocks, 4).cache()
    assert partial.select("part").distinct().count() == 16
    answers = lm_score.total_counts(partial).collect()
    keys = {(r.part, r.block): r.keys for r in partial.collect()}

    def counts(r, name):
        large = iter(r[f"{name}_large"])
        return [b if b < 255 else next(large) for b in r[name]]

    found = {k: t for r in answers for k, t in zip(keys[r.part, r.block], zip(counts(r, "target"), counts(r, "everything")))}
    plain = {}
    for i, text in enumerate(texts):
        its = text.split()
        for entry in [(w,) for w in its] + list(zip([None] + its[:-1], its)):
            target, everything = plain.get(entry, (0, 0))
            plain[entry] = (target + (i < 50), everything + 1)
    assert len(found) == len(plain) and sorted(found.values()) == sorted(plain.values())
    assert sum(r.n_words for r in answers) == sum(len(entry) == 1 for entry in plain)


def test_scores_of_awkward_rows(spark):
    docs = awkward(spark)
    marked = spark.createDataFrame([(7,), (None,), (99,), (7,)], "doc_id long")
    found = lm_score.cross_entropy_difference(docs, marked).collect()
    assert len(found) == docs.count()
    assert all((r.score is None) == (r.n_tokens == 0) for r in found)
    assert {r.n_tokens for r in found if r.doc_id == 7} == {7}
    none = lm_score.cross_entropy_difference(docs, marked.limit(0)).where("n_tokens > 0").first()
    vocabulary = {w for r in docs.collect() for w in word_list(ascii_lower(r.text))}
    assert none.target_loss == pytest.approx(math.log(len(vocabulary)))
    assert lm_score.cross_entropy_difference(docs.limit(0), marked).count() == 0


def test_target_documents_score_lower_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = lm_score.cross_entropy_difference(docs, labels.where("quality = 1"))
    means = {r.quality: r.m for r in scored.join(labels, "doc_id").groupBy("quality").agg(F.avg("score").alias("m")).collect()}
    assert means[1] < means[0]


def area(scores, labels):
    order = np.argsort(scores)
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    positive = labels == 1
    n = positive.sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity_report(docs, labels)
    assert found.count() == docs.count()
    rows = found.where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    assert area(rows.score.to_numpy(), rows.toxic.to_numpy()) > 0.95
    assert ((rows.predicted == rows.toxic).mean()) > 0.95
    assert rows[rows.toxic == 0].predicted.mean() < 0.03


def plain_score(model, words, heads):
    """The forward pass, one window at a time."""
    responses = []
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(model.filters[k].shape[2]):
            best = 0.0
            for at in range(len(words) - width + 1):
                total = model.biases[k][f]
                for j in range(width):
                    total += (model.words[words[at + j]] + model.heads[heads[at + j]]) @ model.filters[k][j][:, f]
                best = max(best, total)
            responses.append(best)
    return 1 / (1 + math.exp(-(np.array(responses) @ model.weights + model.bias)))


@pytest.mark.parametrize("step", [1 << 15, 1, 2, 7])
def test_scores_against_a_plain_forward_pass(monkeypatch, step):
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 50, int(n)) for n in rng.integers(1, 12, 40)]
    toxic = np.array([int(7 in w) for w in words])
    toxic[:2] = [0, 1]
    model = toxicity.fit(words, words, toxic, prior=0.3)
    words[5] = words[5][:0]
    monkeypatch.setattr(toxicity.Model, "STEP", step)
    ends = np.cumsum([len(w) for w in words])
    flat = np.concatenate(words).astype(int)
    found = model.scores(model.tables(), flat, flat, ends)
    for w, score in zip(words, found):
        assert score == pytest.approx(plain_score(model, w, w), rel=1e-4)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(7, 1), (7, 0), (6, 0), (None, 1), (99, 1), (5, None)], "doc_id long, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    one_class = toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 1"))).collect()
    assert {r.score for r in one_class} == {1.0}
    none = toxicity.toxicity_report(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == docs.count()
    assert toxicity.toxicity_report(docs.limit(0), labels).count() == 0
    ids = {r.doc_id: r.held_out for r in none}
    import zlib

    assert all(held == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, held in ids.items())


def test_thresholds_count_every_labelled_row(spark):
    rng = np.random.default_rng(11)
    rows = [(i, ["en", "fr", "xx", None][int(rng.integers(0, 4))] if i >= 15 else "rare", float(rng.random())) for i in range(3000)]
    rows += rows[:500] + [(None, "en", 0.9), (5000, "en", 0.1)]  # repeated rows count again; no id, no label: not
    labels = [(i, int(score + rng.normal(0, 0.3) > 0.6)) for i, _, score in rows[:3000]] + [(0, None), (7000, 1)]
    toxic = {i: t for i, t in labels if t is not None}
    scored = spark.createDataFrame(rows, "doc_id long, lang string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    found = {r.lang: r.threshold for r in toxicity.limits(scored, marks).collect()}

    def best(lang):
        own = [(s, toxic[i]) for i, name, s in rows if i in toxic and lang in (None, name)]
        edges = sorted({math.floor(s * toxicity.BINS) / toxicity.BINS for s, _ in own}, reverse=True)
        positives = sum(t for _, t in own)
        f1 = [2 * sum(t for s, t in own if s >= e) / (sum(s >= e for s, _ in own) + positives) for e in edges]
        return edges[f1.index(max(f1))]

    assert found == {lang: best(lang) for lang in (None, "en", "fr", "xx")}  # "rare" has too few rows of a class
    flagged = toxicity.flag(scored, toxicity.limits(scored, marks)).collect()
    assert len(flagged) == len(rows)
    assert all(r.threshold == found.get(r.lang, found[None]) and r.flagged == (r.score >= r.threshold) for r in flagged)
    none = toxicity.flag(scored, toxicity.limits(scored, marks.where("toxic = 1")))
    assert {r.threshold for r in none.collect()} == {0.3}


def test_portions_cut_batches_between_rows():
    lists = [[1, 2], [], [3], [4, 5, 6, 7], [8], [], [9, 10, 11]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.int32()))], names=["i", "l"])
    for most in (1, 3, 4, 100):
        parts = list(portions(iter([batch, batch.slice(2, 3)]), 1, most))
        assert [x for p in parts for x in p.column(1).to_pylist()] == lists + lists[2:5]
        for part in parts:
            entries = part.column(1).flatten()
            assert entries.to_pylist() == [x for row in part.column(1).to_pylist() for x in row]
            assert len(entries) <= most or part.num_rows == 1
    assert list(portions(iter([batch.slice(0, 0)]), 1, 3)) == []
