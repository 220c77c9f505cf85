"""Saved SQL cells and claim checks over catalog sources."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.charts import check_chart
from gristmill.operators.skew import skew_join
from gristmill.plans.federation import federate
from gristmill.plans.sqlgate import readonly_sql
from gristmill.sources.catalog import Catalog
from gristmill.sources.sinks import materialize

SNAPSHOT_ROWS = 200
TOLERANCE = 1e-6


@dataclass
class Cell:
    """A saved query and its last result: a bounded preview and the full count."""

    sql: str
    title: str = ""
    chart: dict | None = None
    status: str = "new"
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    error: str | None = None


@dataclass
class Analysis:
    """Aliases of sources plus an ordered list of cells; cells store SQL, not data."""

    name: str
    sources: dict[str, str]
    cells: list[Cell] = field(default_factory=list)


def cell_frame(catalog: Catalog, analysis: Analysis, cell: Cell) -> DataFrame:
    return federate(catalog, cell.sql, analysis.sources)


def rerun_cell(catalog: Catalog, analysis: Analysis, cell: Cell) -> Cell:
    """Run again over the current data; an error becomes part of the cell."""
    try:
        frame = cell_frame(catalog, analysis, cell)
        cell.columns = frame.columns
        cell.rows = [row.asDict(recursive=True) for row in frame.limit(SNAPSHOT_ROWS).collect()]
        small = len(cell.rows) < SNAPSHOT_ROWS
        cell.row_count = len(cell.rows) if small else frame.count()
        cell.chart = check_chart(cell.chart, cell.columns)
        cell.status, cell.error = "ok", None
    except Exception as problem:  # a failing cell is a result, not a crash
        cell.status, cell.error = "error", str(problem)
        cell.rows, cell.row_count = [], 0
    return cell


def run_cell(
    catalog: Catalog, analysis: Analysis, sql: str, title: str = "", chart: dict | None = None
) -> Cell:
    """Check, run and save a new cell. SQL that may write is refused outright."""
    cell = Cell(readonly_sql(catalog.spark, sql), title, chart)
    analysis.cells.append(rerun_cell(catalog, analysis, cell))
    return cell


def rerun_all(catalog: Catalog, analysis: Analysis) -> dict[str, int]:
    states = [rerun_cell(catalog, analysis, cell).status for cell in analysis.cells]
    return {"ok": states.count("ok"), "failed": states.count("error")}


def materialize_cell(
    catalog: Catalog, analysis: Analysis, cell: Cell, dataset: str, mode: str = "replace"
) -> int:
    """Run the cell in full, without its preview limit, and write a dataset."""
    return materialize(cell_frame(catalog, analysis, cell), catalog.store, dataset, mode)


def report(analysis: Analysis) -> str:
    """Totals and the first rows of every cell, as text."""
    good = sum(cell.status == "ok" for cell in analysis.cells)
    lines = [f"# {analysis.name}", f"{good} of {len(analysis.cells)} cells ok"]
    for cell in analysis.cells:
        lines.append(f"## {cell.title or cell.sql}")
        lines.append(f"{cell.row_count} rows" if cell.status == "ok" else f"failed: {cell.error}")
        lines += [str(row) for row in cell.rows[:5]]
    return "\n".join(lines)


# ---- claims


def _agrees(actual: object, expected: float) -> bool:
    if actual is None or isinstance(actual, bool):
        return False
    try:
        return math.isclose(float(actual), expected, rel_tol=TOLERANCE, abs_tol=TOLERANCE)
    except (TypeError, ValueError):
        return False


def _checked(catalog: Catalog, claim: str, sql: str, expected: float, sources: dict) -> tuple:
    try:
        found = federate(catalog, sql, sources).limit(2).collect()
        if len(found) > 1:
            return (claim, "unverifiable", None, "the query returned several rows")
        actual = found[0][0] if found else None
        if actual is None:
            return (claim, "unverifiable", None, "the query returned no value")
        verdict = "confirmed" if _agrees(actual, expected) else "corrected"
        return (claim, verdict, float(actual), "")
    except Exception as problem:
        return (claim, "unverifiable", None, str(problem).splitlines()[0])


def verify_claims(
    catalog: Catalog, claims: list[tuple[str, str, float]], sources: dict[str, str]
) -> DataFrame:
    """(claim, verdict, actual, note) for (claim, sql, expected) triples.

    Every claim's SQL is one Spark job over the sources; only its first value comes
    back. A failing query, or one with several rows, makes its claim unverifiable and
    stops nothing.
    """
    results = [_checked(catalog, c, sql, expected, sources) for c, sql, expected in claims]
    columns = "claim string, verdict string, actual double, note string"
    return catalog.spark.createDataFrame(results, columns)


def verify_metrics(
    facts: DataFrame, claims: DataFrame, key: str, value: str, expected: str
) -> DataFrame:
    """The same for a whole table of claims about one grouped sum.

    Sums are computed once for all claims; a claim about a missing key is unverifiable.
    """
    sums = facts.groupBy(key).agg(F.sum(value).alias("actual"))
    joined = skew_join(claims, sums, [key], "left")
    close = F.abs(F.col("actual") - F.col(expected)) <= F.greatest(
        F.lit(TOLERANCE), F.abs(F.col(expected)) * TOLERANCE
    )
    verdict = (
        F.when(F.col("actual").isNull(), "unverifiable")
        .when(close, "confirmed")
        .otherwise("corrected")
    )
    return joined.withColumn("verdict", verdict)
