"""Node documents: a small graph of data steps folded into one lazy DataFrame.

The document is ``{"nodes": [{"id", "type", "config"}], "edges": [{"source",
"target", "branch"?}]}``. Every node transforms the DataFrames of its parents; Spark
plans and schedules the whole thing.
"""

from __future__ import annotations

from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import dates
from gristmill.operators import rows
from gristmill.operators.graph import iterate_until


def _datetime(df: DataFrame, config: dict, now: str | None) -> DataFrame:
    operation, out = config.get("operation") or "format", config.get("output") or "result"
    value = F.col(config["value"]) if config.get("value") else F.lit(now).cast("timestamp")
    if operation in ("format", "now"):
        made = dates.dt_format(value, config.get("format") or "iso")
    elif operation in ("add", "subtract"):
        shift = dates.dt_add if operation == "add" else dates.dt_subtract
        made = shift(value, config["amount"], config.get("unit") or "days")
    elif operation == "diff":
        made = dates.dt_diff(value, F.col(config["to"]), config.get("unit") or "days")
    else:
        raise ValueError(f"unknown date operation: {operation}")
    return df.withColumn(out, made)


def _step(node: dict, parents: list[DataFrame], flows: dict, now: str | None) -> DataFrame:
    kind, config = node["type"], node.get("config") or {}
    df = parents[0]
    if kind == "filter":
        return rows.filter_rows(
            df,
            config["field"],
            config.get("operator") or "is_not_empty",
            config.get("value"),
            config.get("keep", True),
        )
    if kind == "set_fields":
        return rows.set_fields(df, config.get("fields") or {}, config.get("include_input", False))
    if kind == "datetime":
        return _datetime(df, config, now)
    if kind == "route":
        tests = {name: F.expr(text) for name, text in config["branches"].items()}
        return rows.tag_route(df, tests, "_route")
    if kind == "map":
        step = config["expr"]
        column = config["column"]
        return df.withColumn(column, F.expr(f"transform(`{column}`, (item, item_index) -> {step})"))
    if kind == "union":
        for other in parents[1:]:
            df = df.unionByName(other, allowMissingColumns=True)
        return df
    if kind == "join":
        # A look for heavy keys would run all steps before this one again, so the split of
        # skewed keys is left to adaptive execution here.
        return df.join(parents[1], list(config["on"]), config.get("how", "inner"))
    if kind == "loop":
        # The body is a document of its own; without a condition it runs as often as told.
        done = F.expr(config["condition"]) if config.get("condition") else None
        return iterate_until(
            df,
            lambda state: run_flow(config["body"], {"input": state}, flows, now),
            done,
            config.get("max_iterations", 5),
        )
    if kind == "subworkflow":
        inner = flows.get(config["workflow_id"])
        if inner is None:
            raise LookupError(f"workflow '{config['workflow_id']}' not found")
        # One level deep: an inner document sees no further documents.
        return run_flow(inner, {"input": df}, {}, now)
    if kind == "output":
        return df
    raise ValueError(f"unknown node type: {kind}")


def run_flow(
    document: dict,
    inputs: dict[str, DataFrame],
    flows: dict[str, dict] | None = None,
    now: str | None = None,
) -> DataFrame:
    """The DataFrame of the last node in edge order (the ``output`` node if there is one)."""
    nodes = {node["id"]: node for node in document["nodes"]}
    parents: dict[str, list[tuple[str, str | None]]] = {name: [] for name in nodes}
    for edge in document.get("edges", []):
        for end in ("source", "target"):
            if edge[end] not in nodes:
                raise ValueError(f"edge references missing node '{edge[end]}'")
        parents[edge["target"]].append((edge["source"], edge.get("branch")))
    order = TopologicalSorter({n: [p for p, _ in ps] for n, ps in parents.items()}).static_order()
    made: dict[str, DataFrame] = {}
    last = None
    for name in order:
        node = nodes[name]
        if node["type"] == "input":
            made[name] = inputs[(node.get("config") or {}).get("name", "input")]
        else:
            feeds = []
            for parent, branch in parents[name]:
                feed = made[parent]
                if branch is not None:
                    feed = feed.filter(F.col("_route") == branch)
                feeds.append(feed.drop("_route"))
            made[name] = _step(node, feeds, flows or {}, now)
        last = name
    outputs = [n for n, node in nodes.items() if node["type"] == "output"]
    return made[outputs[0] if outputs else last].drop("_route")
