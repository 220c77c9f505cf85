"""Merkle manifest of a table: a tree of digests for each group, and one over the groups.

Every row is hashed to a leaf. The leaves of a group stand in order; while several nodes
remain, every eight consecutive ones become their digest. What remains is the group's
subroot, and the subroots, ordered by group, become the root in the same way.

*Places.* Rows are dealt out by ranges of (group, order) and numbered within their
partition; the counts of the partitions, a table of one row per group and partition, turn
these numbers into places. No group is ever in one task.

*Levels.* In a window of one run of eight places, lag and lead columns of fixed offsets 1
to 7, masked by a node's slot in its run and by the run's length, are its siblings, and the
row in the first slot hashes its own digest and those after it to the parent. Each level
is written to the shared folder and is an eighth of the one below it.

*Paths.* From the top down, each level's siblings are joined to the path of the run's
parent, so a leaf's path lists what stands before and after it on every level up to the
root. A path and the content of a row are enough to compute the root again.

Defined results: null values are hashed as ``-``; rows without a group (null) form a group
of their own, which comes first; rows without an order value come first, equal ones by
their digest, so repeated rows have neighbouring places; a lone leaf is its own subroot; an
empty table has no rows in its manifest. Other columns are neither hashed nor kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.texts import ascii_lower, nullable, stored

ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest(*texts: Column) -> Column:
    """Lowercase hex sha256 of the texts, one after the other."""
    return F.sha2(F.concat(*texts), 256)


def leaf(fields: list[Column]) -> Column:
    """The digest of a row's values, each told apart by its length in bytes."""
    told = []
    for value in fields:
        text = value.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*told)


def _placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The nodes with pos, their place in their tree, and size, the tree's number of nodes;
    the largest size.

    nodes: tree, digest and any others; the order's columns are among them.
    """
    by = ["tree", *order, "digest"]
    ordered = nodes.repartitionByRange(*by).sortWithinPartitions(*by)
    # The number of the partition, and 33 bits of the number within it.
    listed = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "merkle-order")
    part = F.shiftright("at", 33)
    runs = listed.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    # At most one row per partition for each tree.
    tree = Window.partitionBy("tree")
    earlier = F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shift = F.col("first") - F.coalesce(earlier, F.lit(0))
    shifts = stored(runs.select("tree", "part", shift.alias("shift"), F.sum("held").over(tree).alias("size")), "merkle-shifts")
    placed = listed.withColumn("part", part).join(shifts, ["tree", "part"])
    most = shifts.agg(F.max("size")).first()[0] or 0
    return placed.withColumn("pos", F.col("at") - F.col("shift")).drop("part", "at", "shift"), most


def _sided(level: DataFrame) -> DataFrame:
    """A level with run, slot and what stands before and after a node in its run."""
    numbered = level.selectExpr("*", f"pos div {ARITY} AS run", f"pos % {ARITY} AS slot")
    run, length = "OVER (PARTITION BY tree, run ORDER BY pos)", f"least({ARITY}, size - run * {ARITY})"
    before = [f"if(slot >= {k}, lag(digest, {k}) {run}, '')" for k in range(ARITY - 1, 0, -1)]
    after = [f"if(slot + {k} < {length}, lead(digest, {k}) {run}, '')" for k in range(1, ARITY)]
    return numbered.selectExpr("*", f"concat({', '.join(before)}) AS before", f"concat({', '.join(after)}) AS after")


def _parents(level: DataFrame) -> DataFrame:
    """The next level. A tree's last node stays as it is."""
    first = _sided(level).where("slot = 0")
    hashed = F.when(F.col("size") > 1, digest(F.col("digest"), F.col("after"))).otherwise(F.col("digest"))
    above = F.expr(f"(size + {ARITY - 1}) div {ARITY}")
    return first.select("tree", F.col("run").alias("pos"), above.alias("size"), hashed.alias("digest"))


def _levels(nodes: DataFrame, order: list[str]) -> list[DataFrame]:
    """All levels of the trees; the last has one node for each."""
    level, most = _placed(nodes, order)
    levels = [level]
    while most > 1:
        levels.append(stored(_parents(levels[-1]), "merkle-level"))
        most = -(-most // ARITY)
    return levels


def _with_paths(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest level with what ``top`` (tree, path and others) says of its tree, the
    nodes' own siblings put before the path."""
    found = top.withColumn("pos", F.lit(0).cast("long"))
    carried = [c for c in top.columns if c not in ("tree", "path")]
    own = F.array(F.struct("before", "after")).cast(PATH)
    path = F.when(F.col("size") > 1, F.concat(own, F.col("path"))).otherwise(F.col("path"))
    if len(levels) == 1:
        return levels[0].join(top, "tree")
    for level in reversed(levels[:-1]):
        kept = [c for c in level.columns if c not in ("size", "pos", "digest")]
        joined = _sided(level).join(found.withColumnRenamed("pos", "run"), ["tree", "run"])
        found = joined.select(*kept, "pos", "digest", *carried, path.alias("path"))
        if level is not levels[0]:
            found = stored(found.drop("digest"), "merkle-paths")
    return found


def manifest(leaves: DataFrame, order: list[str]) -> DataFrame:
    """digest, subroot, root and path of each leaf, with its other columns.

    leaves: tree (text), digest, the columns of ``order`` and any others but ``size``,
    ``pos`` and names that begin with these of the result.
    """
    levels = _levels(leaves, order)
    roots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = _levels(roots, ["name"])
    none = F.array().cast(PATH)
    root = upper[-1].select("tree", F.col("digest").alias("root"), none.alias("path"))
    tops = _with_paths(upper, root).select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return _with_paths(levels, stored(tops, "merkle-roots"))


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its path give."""
    return F.aggregate(path, start, lambda acc, side: digest(side["before"], acc, side["after"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["before"], side["after"])), ""), 256)


def document_leaves(docs: DataFrame, other: Column | None = None, where: Column | None = None) -> DataFrame:
    """tree, doc_id, digest of documents, grouped by language; claim is the digest with
    the text ``other`` where that is asked for, else null."""
    fields = [F.col(c) for c in FIELDS]
    claim = F.lit(None).cast("string")
    if other is not None:
        claim = F.when(where, leaf([*fields[:-1], other]))
    return docs.select(
        nullable("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(fields).alias("digest"), claim.alias("claim")
    )


def verify(told: DataFrame) -> DataFrame:
    """A manifest with folded_root, from the claimed digest (if any) and the path, and
    whether that is the root."""
    folded = told.withColumn("folded_root", fold(F.coalesce("claim", "digest"), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_report(docs: DataFrame) -> DataFrame:
    """Which documents verify after the capitals of every third text are lower-cased."""
    third = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = document_leaves(docs, ascii_lower(F.col("text").cast("string")), third)
    told = verify(manifest(leaves, ["doc_id"]))
    return told.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        "verified",
    )
