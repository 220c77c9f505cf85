"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gristmill.llm import (
    bisectors,
    decontaminate,
    licenses,
    lm_score,
    merkle,
    mix,
    ngram_join,
    oracles,
    packing,
    quality,
    token_rollup,
    toxicity,
    transducer,
    url_rules,
)
from gristmill.llm.texts import stored
from gristmill.scratch import new_folder
from gristmill.suite.registry import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: run(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return run

    return add


@query("op8_quality_rules")
def op8(t: Tables) -> DataFrame:
    return quality.quality_report(t.documents)


@query("op2_mix_sources")
def op2(t: Tables) -> DataFrame:
    return mix.mix_report(t.documents)


@query("op4_token_rollup", oracles.TOKEN_ROLLUP)
def op4(t: Tables) -> DataFrame:
    """Load all documents, take back those labelled as poor, revise those that lose
    repeated lines; the load and the revision are sent twice."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(whole, "\n")
    once = F.array_distinct(lines)
    fewer = F.size(once) < F.size(lines)
    counted = t.documents.select(
        "doc_id",
        "source",
        "lang",
        F.array(
            *[
                F.struct(
                    F.lit(version).alias("version"),
                    token_rollup.token_count(whole, version).alias("old_tokens"),
                    F.when(fewer, token_rollup.token_count(F.array_join(once, "\n"), version)).alias("tokens"),
                )
                for version in token_rollup.VERSIONS
            ]
        ).alias("v"),
    )
    counts = stored(counted.select("doc_id", "source", "lang", F.explode("v").alias("v")), "tokens")
    counts = counts.select("doc_id", "source", "lang", "v.*")
    poor = t.labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 0").select("doc_id")
    first = counts.select("doc_id", *token_rollup.GROUP, F.col("old_tokens").alias("tokens"))
    gone = first.join(poor, "doc_id", "left_semi")
    revised = counts.join(poor, "doc_id", "left_anti").where("tokens <> old_tokens")
    rollup = token_rollup.TokenRollup(t.spark, new_folder(t.spark, "rollup"))
    rollup.commit("load", token_rollup.changes(first, "insert"))
    rollup.commit("poor", token_rollup.changes(gone, "delete"))
    rollup.commit("lines", token_rollup.changes(revised, "revise"))
    rollup.commit("load", token_rollup.changes(first, "insert"))
    rollup.compact()
    rollup.commit("lines", token_rollup.changes(revised, "revise"))
    return rollup.totals()


@query("op6_license_scan", oracles.LICENSE_SCAN)
def op6(t: Tables) -> DataFrame:
    return licenses.scan_licenses(t.documents)


@query("op10_pack_tokens")
def op10(t: Tables) -> DataFrame:
    return packing.pack_documents(t.documents)


@query("op5_toxicity")
def op5(t: Tables) -> DataFrame:
    return toxicity.toxicity_report(t.documents, t.labels)


@query("op9_url_rules", oracles.URL_RULES)
def op9(t: Tables) -> DataFrame:
    return url_rules.judge_urls(t.pages)


@query("op1_lm_score")
def op1(t: Tables) -> DataFrame:
    return lm_score.cross_entropy_difference(t.documents, t.labels.where("quality = 1"))


@query("op7_decontaminate", oracles.DECONTAMINATE)
def op7(t: Tables) -> DataFrame:
    return decontaminate.contaminated(t.documents, t.benchmark)


@query("op3_ngram_join", oracles.NGRAM_JOIN)
def op3(t: Tables) -> DataFrame:
    return ngram_join.similar_documents(t.documents)


@query("op11_merkle_manifest", oracles.MERKLE)
def op11(t: Tables) -> DataFrame:
    return merkle.tamper_report(t.documents)


@query("op12_bisector_clusters", oracles.CLUSTERS)
def op12(t: Tables) -> DataFrame:
    return bisectors.cluster_report(t.embeddings)


@query("op13_bpe_coding")
def op13(t: Tables) -> DataFrame:
    return transducer.coding_report(t.documents)


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(t: Tables) -> DataFrame:
    return corpus_pipeline.run(t.spark, t.folder)
