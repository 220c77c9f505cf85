"""The Merkle manifest against plain trees of lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from gristmill.llm import merkle

from .helpers import DOCUMENTS, ascii_lower, awkward


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    told = [row.doc_id, row.source, row.lang, row.n_chars, text]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in told))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        first = i // 8 * 8
        yield nodes[first:i], nodes[i + 1 : first + 8]
        i //= 8


def plain_report(rows):
    langs = sorted({r.lang for r in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    members = {lang: sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r, r.text))) for lang in langs}
    trees = {lang: tree([leaf(r, r.text) for r in members[lang]]) for lang in langs}
    upper, found = tree([trees[lang][-1][0] for lang in langs]), []
    for place, lang in enumerate(langs):
        for i, r in enumerate(members[lang]):
            steps = [*path(trees[lang], i), *path(upper, place)]
            altered = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = leaf(r, ascii_lower(r.text) if altered else r.text)
            for before, after in steps:
                folded = sha(*before, folded, *after)
            proof = sha(*(s for before, after in steps for s in before + after))
            root = upper[-1][0]
            found.append((r.doc_id, leaf(r, r.text), trees[lang][-1][0], root, proof, folded, folded == root))
    return found


@pytest.mark.parametrize("counts", [(1,), (8, 1), (9, 64, 65), (3, 130, 2, 1, 1, 7, 8, 16, 17)])
def test_against_plain_trees(spark, counts):
    rows = []
    for k, n in enumerate(counts):
        lang = None if k == 1 else f"l{k}é"
        rows += [(1000 * k + 7 * i % 997, f"Text {i} ÄB", lang, "s" if i % 3 else None, i) for i in range(n)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(5)
    found = sorted(map(tuple, merkle.tamper_report(docs).collect()))
    assert found == sorted(plain_report(docs.collect()))


def test_awkward(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "text", "lang", "source", "n_chars").collect()
    key = lambda r: (r[0] or 0, *r[1:])
    assert sorted(map(tuple, merkle.tamper_report(docs).collect()), key=key) == sorted(plain_report(rows), key=key)
    assert merkle.tamper_report(docs.limit(0)).count() == 0


def test_a_manifest_proves_rows_and_shows_changed_ones(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"l{i % 3}", "s", i) for i in range(100)], DOCUMENTS)
    kept = merkle.manifest(merkle.document_leaves(docs), ["doc_id"]).select("tree", "doc_id", "root", "path")
    later = docs.withColumn("text", F.when(F.col("doc_id") == 41, "changed").otherwise(F.col("text")))
    told = merkle.verify(merkle.document_leaves(later).join(kept, ["tree", "doc_id"]))
    assert [r.doc_id for r in told.where("not verified").collect()] == [41]
    assert told.count() == 100
