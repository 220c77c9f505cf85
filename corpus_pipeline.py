"""A corpus pipeline: what a training run reads, from raw documents.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept and
returns a DataFrame; ``run`` writes each result as Parquet and reads it again. All but the
last return the columns of ``documents``. The benchmark is read from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import decontaminate, mix, ngram_join, packing, quality
from gristmill.llm.texts import stored
from gristmill.suite.registry import Tables

# Texts whose sets of five words have a Jaccard similarity of 0.8 or more are near copies.
NEAR = ngram_join.Rule(words=5, percent=80)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id."""
    return ngram_join.one_of_each(docs, NEAR, repeats=False)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a passage of a benchmark item go."""
    return decontaminate.drop_contaminated(docs, Tables(spark, sf_dir).benchmark, by_row=True)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix to the target weights takes them."""
    return mix.mixed_documents(docs)


def packed_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of token ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("benchmark_leaks", benchmark_leaks),
    ("source_mix", source_mix),
    ("packed_tokens", packed_tokens),
]

# Robust estimates, hashed draws and packing have no SQL form: the stages are tested
# against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
