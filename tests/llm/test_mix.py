import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gristmill.llm import mix

from .helpers import DOCUMENTS, awkward, prose, word_list


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_sources, target = sum(sizes.values()), set(order), {}
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        full = {s for s in open_sources if most * sizes[s] <= rest * weight[s] / total}
        if not full:
            target |= {s: rest * weight[s] / total for s in open_sources}
            break
        target |= {s: float(most * sizes[s]) for s in full}
        rest -= sum(most * sizes[s] for s in full)
        open_sources -= full
    return target


def sample(spark):
    rng = np.random.default_rng(5)
    rows = []
    for source, n in (("a", 3), ("b", 40), ("c", 60), ("é", 5), (None, 20), ("Z", 30)):
        rows += [(len(rows) + i, prose(rng, int(rng.integers(1, 900))), "en", source, 0) for i in range(n)]
    return spark.createDataFrame(rows, DOCUMENTS), rows


def test_targets_and_taken(spark):
    docs, rows = sample(spark)
    found = mix.mix_report(docs).collect()
    assert len(found) == len(rows)
    size, source = {r[0]: len(word_list(r[1])) for r in rows}, {r[0]: r[3] for r in rows}
    sizes = {s: sum(size[i] for i in size if source[i] == s) for s in set(source.values())}
    target = fill(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in found:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(target[source[r.doc_id]], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    assert taken == {s: round(t) for s, t in target.items()}
    again = {r.doc_id: r.taken for r in mix.mix_report(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in found}


def test_shards_share_disjoint_draws(spark):
    docs, _ = sample(spark)
    _, draws = mix.mix(docs, shard_words=5000, block_words=64)
    shards = draws.groupBy("shard").agg(F.count("*").alias("n"), F.sum("words").alias("words")).collect()
    total = draws.agg(F.sum("words")).first()[0]
    assert len(shards) == math.ceil(total / 5000)
    assert max(s.n for s in shards) - min(s.n for s in shards) <= 1
    each = draws.groupBy("doc_id", "copy", "start", "round").count()
    assert each.where("count > 1").isEmpty()


def test_hypergeometric_is_the_inverse_distribution(spark):
    cases = [(20, 7, 9), (50, 50, 10), (10, 1, 10), (300, 120, 40), (5, 2, 0)]
    for n, k, m in cases:
        if not m:
            continue
        grid = spark.range(400).select(((F.col("id") + 0.5) / 400).alias("u"))
        draw = mix.hypergeometric(F.lit(n), F.lit(k), F.lit(m), F.col("u"))
        seen = np.bincount([r[0] for r in grid.select(draw).collect()], minlength=m + 1) / 400
        p = np.array([math.comb(k, x) * math.comb(n - k, m - x) / math.comb(n, m) for x in range(m + 1)])
        assert abs(seen[: m + 1] - p).max() < 0.006


def test_awkward(spark):
    docs = awkward(spark)
    found = mix.mix_report(docs).collect()
    assert len(found) == docs.count()
    assert all(r.taken == 0 for r in found if r.size == 0)
    whole = mix.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() > 0
    assert mix.mix_report(docs.limit(0)).count() == 0
    assert mix.mixed_documents(docs.limit(0)).count() == 0


def test_whole_documents_come_near_the_target(spark):
    docs, rows = sample(spark)
    taken = {r[0]: r[1] for r in mix.mixed_documents(docs).groupBy("source").agg(F.sum(mix.word_count(F.col("text")))).collect()}
    sizes = {s: sum(len(word_list(r[1])) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    for s, target in fill(sizes).items():
        assert abs(taken[s] - target) <= 900 / 2
