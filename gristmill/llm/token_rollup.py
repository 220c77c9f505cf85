"""Token totals by source, language and tokenizer version, kept by signed changes.

A batch of changes is summed to one row per source, language and version before it is
stored, so a store holds small tables only and totals are sums of sums. A batch is
written once under its id and counts when its success marker is there: a batch that was
cut short is written anew, one that is sent again adds nothing. ``compact`` folds the
batches so far into one table that lists their ids. Snapshots are numbered, and each is made
from the one before it and published by a marker that only one writer can create; of two
compactions at once, the second has no effect.

Changes are rows (op, source, lang, version, tokens, old_tokens):

- ``insert``: one more document with ``tokens``;
- ``delete``: one document with ``tokens`` less;
- ``revise``: a document that counted ``old_tokens`` now counts ``tokens``.

Defined results: null source, language or version is a group of its own; null counts are
0; an unknown op is an error; an empty batch is a valid batch; repeated rows each count;
groups whose documents and tokens are both back at zero are not listed.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.texts import SPACES
from gristmill.sources.storage import SharedFiles

GROUP = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"
# Tokenizer versions that plain expressions can count: what one token is.
VERSIONS = {
    "words-1": f"[^{SPACES}]+",
    "pieces-1": rf"\p{{L}}+|\p{{N}}+|[^\p{{L}}\p{{N}}{SPACES}]",
}


def token_count(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(VERSIONS[version])).cast("long")


def deltas(rows: DataFrame) -> DataFrame:
    """Signed sums of a batch, at most one row per group."""
    op = F.col("op")
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(op, F.lit("null"))))
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(op == "insert", new).when(op == "delete", -new).when(op == "revise", new - old)
    return rows.groupBy(*[F.col(c).cast("string").alias(c) for c in GROUP]).agg(
        F.sum(docs).cast("long").alias("docs"), F.sum(tokens).cast("long").alias("tokens")
    )


class TokenRollup:
    """Totals below ``folder``, which every executor must reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder, self._files = spark, folder.rstrip("/"), SharedFiles(spark)

    def _tables(self, kind: str) -> dict[str, str]:
        """Finished tables of a kind by name."""
        base = f"{self._folder}/{kind}"
        found = {name: f"{base}/{name}" for name in self._files.names(base)}
        return {name: path for name, path in found.items() if self._files.exists(f"{path}/_SUCCESS")}

    def _snapshot(self) -> tuple[int, str | None, set[str]]:
        """Number and folder of the newest snapshot, and the batches that it holds."""
        tables = self._tables("snapshots")
        if not tables:
            return 0, None, set()
        name = max(tables)
        newest = f"{tables[name]}/{self._files.read_text(f'{tables[name]}/_SUCCESS')}"
        folded = self._spark.read.text(f"{newest}/folded")
        return int(name), newest, {row[0] for row in folded.collect()}

    def _sum(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self._spark.createDataFrame([], SCHEMA)
        rows = self._spark.read.schema(SCHEMA).parquet(*paths)
        sums = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add a batch; False if it counts already. Batch ids: letters, digits, ``_.-``."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch):
            raise ValueError(f"not a batch id: {batch!r}")
        if batch in self._tables("batches") or batch in self._snapshot()[2]:
            return False
        deltas(rows).write.mode("overwrite").parquet(f"{self._folder}/batches/{batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens over all batches."""
        # Batches first: one that is folded and removed meanwhile is in the snapshot read later.
        batches = self._tables("batches")
        _, newest, folded = self._snapshot()
        paths = [path for name, path in batches.items() if name not in folded]
        return self._sum([*paths, f"{newest}/totals"] if newest else paths)

    def compact(self) -> int:
        """Fold all finished batches into a new snapshot; how many it holds, or 0 when
        another compaction was first.

        The sum is of the very batches that the snapshot names: one that is committed
        meanwhile stays outside. A snapshot counts from the moment its marker is written, so
        readers see each batch once, before and after. Batches are removed by the next
        compaction, when no reader of an older snapshot needs them.
        """
        number, newest, folded = self._snapshot()
        batches = self._tables("batches")
        fresh = {name: path for name, path in batches.items() if name not in folded}
        held = sorted(folded | set(fresh))
        target = f"{self._folder}/snapshots/{number + 1:08d}"
        own = uuid.uuid4().hex
        self._sum([*fresh.values(), *([f"{newest}/totals"] if newest else [])]).write.parquet(f"{target}/{own}/totals")
        names = self._spark.createDataFrame([(name,) for name in held], "value string")
        names.write.text(f"{target}/{own}/folded")
        if not self._files.write_new(f"{target}/_SUCCESS", own):
            self._files.delete(f"{target}/{own}")
            return 0
        for name in set(batches) - set(fresh):
            self._files.delete(batches[name])
        return len(held)


def changes(counts: DataFrame, op: str) -> DataFrame:
    """Changes of one kind. counts: source, lang, version, tokens (and old_tokens)."""
    old = F.col("old_tokens") if "old_tokens" in counts.columns else F.lit(None).cast("bigint")
    return counts.select(F.lit(op).alias("op"), *GROUP, "tokens", old.alias("old_tokens"))
