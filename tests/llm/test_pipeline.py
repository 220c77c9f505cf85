"""Each stage against brute force on its own input."""

import numpy as np
import pytest

import corpus_pipeline
from gristmill.llm import packing, quality
from gristmill.llm.texts import stored

from .helpers import DOCUMENTS, awkward, jaccard_components, leaked, word_list
from .test_mix import fill

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, items = docs.columns, [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    report = {r.doc_id: r.kept for r in quality.quality_report(docs).collect()}
    for name, stage in corpus_pipeline.STAGES:
        frame = stored(stage(spark, docs, FOLDER), name)
        if name == "packed_tokens":
            break
        assert frame.columns == columns
        rows = frame.collect()
        assert all(r == before[r.doc_id] for r in rows)
        after = {r.doc_id: r for r in rows}
        if name == "quality_rules":
            assert set(after) == {i for i in before if report[i]}
        if name == "near_copies":
            assert set(after) == set(jaccard_components({i: r.text for i, r in before.items()}, 5, 80)[0].values())
        if name == "benchmark_leaks":
            assert set(after) == {i for i, r in before.items() if not leaked(r.text, items)}
        if name == "source_mix":
            size = {i: len(word_list(r.text)) for i, r in before.items()}
            sizes = {}
            for i, r in before.items():
                sizes[r.source] = sizes.get(r.source, 0) + size[i]
            taken = dict.fromkeys(sizes, 0)
            for r in rows:
                taken[r.source] += size[r.doc_id]
            for source, target in fill(sizes).items():
                assert abs(taken[source] - target) <= max(size[i] for i in before if before[i].source == source) / 2 + 1
        docs, before = frame, after
    encoding = packing._encoding(tuple(packing.load_ranks().items()))
    total = sum(len(encoding.encode_ordinary(r.text or "")) for r in docs.collect())
    assert frame.agg({"used": "sum"}).first()[0] == total
    assert all(len(np.frombuffer(r.ids, "<u2")) == 2048 for r in frame.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_awkward_rows_pass_all_stages(spark, empty):
    docs = awkward(spark)
    docs = docs.limit(0) if empty else docs
    assert stored(corpus_pipeline.STAGES[0][1](spark, docs, FOLDER), "kept").isEmpty()
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, FOLDER), name)
    assert stored(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER), "packed").isEmpty() == empty


def test_near_copies_share_four_fifths_of_their_five_word_runs(spark):
    words = [f"w{i}" for i in range(150)]
    for at in (30, 75, 120):
        words[at] = f"other{at}"
    rows = [(1, " ".join(f"w{i}" for i in range(150))), (2, " ".join(words)), (None, " ".join(words))]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCUMENTS)
    kept = corpus_pipeline.near_copies(spark, docs, FOLDER)
    assert [r.doc_id for r in kept.collect()] == [1]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()}
    assert kept == set(jaccard_components(texts, 5, 80)[0].values())
