"""Checks and depths over whole tables of workflow graphs.

Nodes are (graph_id, node_id, type); edges are (graph_id, source, target, attach),
where ``attach`` is null for an ordinary step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators.skew import DEFAULT, Skew, heavy_keys, skew_join
from gristmill.scratch import cut_lineage

# Node types, attachment kinds, and which types an attachment joins.
NODE_TYPES = (
    "trigger",
    "input",
    "output",
    "human",
    "agent",
    "tool",
    "connector",
    "mcp",
    "filter",
    "set_fields",
    "datetime",
    "decision",
    "loop",
    "model",
    "memory",
    "subworkflow",
    "flow",
)
CAPABILITIES = ("model", "memory")
ATTACH_SOURCES = {
    "model": ("model",),
    "memory": ("memory",),
    "tools": ("tool", "mcp"),
    "agents": ("agent",),
}

def _with_types(nodes: DataFrame, edges: DataFrame, skew: Skew) -> DataFrame:
    """Edges with the type of both ends; null where the node is missing."""
    types = nodes.groupBy("graph_id", "node_id").agg(F.min("type").alias("type"))
    ends = edges.select("graph_id", "source", "target", "attach")
    heavy = {end: heavy_keys(edges, ["graph_id", end], skew) for end in ("source", "target")}
    for end in ("source", "target"):
        named = types.select(
            "graph_id", F.col("node_id").alias(end), F.col("type").alias(f"{end}_type")
        )
        ends = skew_join(ends, named, ["graph_id", end], "left", skew, heavy=heavy[end])
    return ends


def _edge_issues(ends: DataFrame) -> DataFrame:
    """Every rule that one edge and the types of its ends can break, in one pass."""
    source, target, attach = F.col("source"), F.col("target"), F.col("attach")
    source_type = F.coalesce("source_type", F.lit(""))
    target_type = F.coalesce("target_type", F.lit(""))
    step, known = attach.isNull(), F.coalesce(attach.isin(*ATTACH_SOURCES), F.lit(False))
    fits = F.lit(False)
    for kind, sources in ATTACH_SOURCES.items():
        fits = fits | ((attach == kind) & source_type.isin(*sources))
    wanted = F.when(attach == "agents", "flow").otherwise("agent")
    rules = [
        ("missing_node", F.col("source_type").isNull(), source),
        ("missing_node", F.col("target_type").isNull(), target),
        ("edge_into_trigger", step & (target_type == "trigger"), target),
        ("unknown_attachment", ~step & ~known, target),
        ("attachment_target", known & (target_type != wanted), target),
        ("attachment_source", known & ~fits, source),
        ("capability_in_flow", step & source_type.isin(*CAPABILITIES), source),
        ("capability_in_flow", step & target_type.isin(*CAPABILITIES), target),
    ]
    broken = F.array(
        *[
            F.when(test, F.struct(F.lit(name).alias("issue"), node.cast("string").alias("node_id")))
            for name, test, node in rules
        ]
    )
    listed = F.explode(F.filter(broken, lambda i: i.isNotNull())).alias("i")
    return ends.select("graph_id", listed).select("graph_id", "i.*")


def graph_issues(nodes: DataFrame, edges: DataFrame, skew: Skew = DEFAULT) -> DataFrame:
    """(graph_id, issue, node_id) for every structural fault in every graph."""

    def issue(df: DataFrame, name: str, node: str | None) -> DataFrame:
        where = F.col(node).cast("string") if node else F.lit(None).cast("string")
        return df.select("graph_id", F.lit(name).alias("issue"), where.alias("node_id"))

    known = nodes.groupBy("graph_id", "node_id").agg(
        F.count(F.lit(1)).alias("_copies"), F.min("type").alias("type")
    )
    steps = edges.filter(F.col("attach").isNull())
    attached = edges.filter(F.col("attach").isNotNull())
    repeated = (
        attached.filter(F.col("attach").isin(*CAPABILITIES))
        .groupBy("graph_id", "target", "attach")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # One summary row per node: is it pointed at, is it used in the flow, is it attached?
    roles = steps.select(
        "graph_id", F.col("source").alias("node_id"), F.lit(0).alias("_in"), F.lit(1).alias("_uses"), F.lit(0).alias("_held")
    )
    roles = roles.unionByName(
        steps.select(
            "graph_id", F.col("target").alias("node_id"), F.lit(1).alias("_in"), F.lit(1).alias("_uses"), F.lit(0).alias("_held")
        )
    ).unionByName(
        attached.select(
            "graph_id", F.col("source").alias("node_id"), F.lit(0).alias("_in"), F.lit(0).alias("_uses"), F.lit(1).alias("_held")
        )
    )
    summed = roles.groupBy("graph_id", "node_id").agg(
        F.max("_in").alias("_in"), F.sum("_uses").alias("_uses"), F.max("_held").alias("_held")
    )
    placed = known.join(summed, ["graph_id", "node_id"], "left").na.fill(
        0, ["_in", "_uses", "_held"]
    )
    ordinary = ~F.col("type").isin(*CAPABILITIES)
    both = placed.filter(ordinary & (F.col("_held") == 1) & (F.col("_uses") > 0))
    flow = placed.filter(ordinary & (F.col("_held") == 0))
    entry = (F.col("_in") == 0) | (F.col("type") == "input")
    closed = flow.groupBy("graph_id").agg(F.bool_or(entry).alias("_open")).filter(~F.col("_open"))
    parts = [
        issue(known.filter(F.col("_copies") > 1), "duplicate_node", "node_id"),
        issue(nodes.filter(~F.col("type").isin(*NODE_TYPES)), "unknown_type", "node_id"),
        _edge_issues(_with_types(nodes, edges, skew)),
        issue(repeated.filter(F.col("_n") > 1), "repeated_attachment", "target"),
        issue(both, "attached_in_flow", "node_id"),
        issue(closed, "no_entry_point", None),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _kinds(nodes: DataFrame, links: DataFrame, skew: Skew) -> DataFrame:
    """The open nodes with what a round does with them.

    ``done``: nothing open leads into the node, or it is known to have no depth; ``single``:
    all its links come from one node, ``parent``, that is not done; else ``open``.
    """
    into = links.groupBy("graph_id", F.col("target").alias("node_id")).agg(
        F.min("source").alias("parent"), F.max("source").alias("_last"), F.max("steps").alias("from_parent")
    )
    found = nodes.join(into, ["graph_id", "node_id"], "left")
    own = (F.col("parent") == F.col("node_id")) & (F.col("_last") == F.col("node_id"))
    closed = F.col("closed") | F.coalesce(own, F.lit(False))
    kind = F.when(closed | F.col("parent").isNull(), "done").when(F.col("parent") == F.col("_last"), "single").otherwise("open")
    told = cut_lineage(
        found.select("graph_id", "node_id", "size", "depth", closed.alias("closed"), "parent", "from_parent", kind.alias("kind"))
    )
    gone = told.where("kind = 'done'").select("graph_id", F.col("node_id").alias("parent"), F.lit(True).alias("gone"))
    single = told.where("kind = 'single'")
    held = skew_join(single, gone, ["graph_id", "parent"], "left", skew, heavy=heavy_keys(single, ["graph_id", "parent"], skew))
    waiting = held.withColumn("kind", F.when(F.col("gone"), "open").otherwise("single")).select(*told.columns)
    return told.where("kind <> 'single'").unionByName(waiting)


def graph_depth(edges: DataFrame, skew: Skew = DEFAULT) -> DataFrame:
    """Longest-path depth per node; nodes on or behind a cycle have none (null).

    A link counts the steps between its ends; at first each edge is one of one step. In a
    round, all links of nodes that nothing leads into hand on depths and go. A node whose
    links come from one parent only is passed over at the same time: its links start at the
    parent instead and count the steps to it. So chains, trees and branches that meet again
    shrink to half their length, a graph of them ends after a logarithmic number of rounds,
    and the number of links never grows. A link of as many steps as its graph has nodes has
    gone round a cycle. What no round can change is on or behind cycles.
    """
    steps = edges.select("graph_id", "source", "target").distinct()
    names = steps.select("graph_id", F.col("source").alias("node_id")).unionByName(
        steps.select("graph_id", F.col("target").alias("node_id"))
    ).distinct()
    sizes = names.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size"))
    sized = skew_join(names, sizes, ["graph_id"], heavy=heavy_keys(edges, ["graph_id"], skew))
    nodes = sized.select("graph_id", "node_id", "size", F.lit(0).cast("long").alias("depth"), F.lit(False).alias("closed"))
    links = cut_lineage(steps.withColumn("steps", F.lit(1).cast("long")))
    done = []
    while True:
        state = cut_lineage(_kinds(nodes, links, skew))
        counts = {row["kind"]: row["count"] for row in state.groupBy("kind").count().collect()}
        if counts.get("done"):
            ended = state.where("kind = 'done'")
            done.append(ended.select("graph_id", "node_id", F.when(~F.col("closed"), F.col("depth")).alias("depth")))
        if not counts.get("done") and not counts.get("single"):
            break
        source = state.select("graph_id", F.col("node_id").alias("source"), "size", "depth", "closed", "parent", "from_parent", "kind")
        heavy = heavy_keys(links, ["graph_id", "source"], skew)
        # Links whose source went as closed are dropped with it.
        moved = cut_lineage(skew_join(links, source, ["graph_id", "source"], "inner", skew, heavy=heavy))
        if not counts.get("done") and moved.where("kind = 'single'").isEmpty():
            break
        passed = F.col("kind") == "single"
        length = F.when(passed, F.col("steps") + F.col("from_parent")).otherwise(F.col("steps"))
        given = moved.where("kind <> 'open'").groupBy("graph_id", F.col("target").alias("node_id")).agg(
            F.max(F.col("depth") + F.col("steps")).alias("given"),
            F.bool_or(F.col("closed") | (passed & (length >= F.col("size")))).alias("ends"),
        )
        links = moved.where("kind <> 'done'").select(
            "graph_id", F.when(passed, F.col("parent")).otherwise(F.col("source")).alias("source"), "target", length.alias("steps")
        )
        left = state.where("kind <> 'done'").select("graph_id", "node_id", "size", "depth", "closed")
        nodes = left.join(given, ["graph_id", "node_id"], "left").select(
            "graph_id",
            "node_id",
            "size",
            F.greatest("depth", "given").alias("depth"),
            F.coalesce("ends", F.lit(False)).alias("closed"),
        )
    result = state.where("kind <> 'done'").select("graph_id", "node_id", F.lit(None).cast("long").alias("depth"))
    for part in done:
        result = result.unionByName(part)
    return result.withColumn("depth", F.col("depth").cast("int"))


def iterate_until(df: DataFrame, step, done: Column | None = None, max_rounds: int = 5) -> DataFrame:
    """Repeat ``step(df)`` until no row fails ``done``, at most 1..100 rounds.

    Each round is checkpointed to the shared folder, so the plan stays short and a lost
    executor costs one round at most.
    """
    rounds = max(1, min(int(max_rounds), 100))
    for _ in range(rounds):
        df = cut_lineage(step(df))
        if done is not None and df.filter(~F.coalesce(done, F.lit(False))).isEmpty():
            break
    return df
