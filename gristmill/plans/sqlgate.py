"""Read-only check for user SQL, made on Spark's own parse of the statement."""

from __future__ import annotations

from collections.abc import Iterator

from py4j.java_gateway import is_instance_of
from pyspark import SparkContext
from pyspark.errors import ParseException
from pyspark.sql import SparkSession

# SQL functions that call arbitrary JVM methods.
ESCAPES = ("java_method", "reflect", "try_reflect")
_WRITES = ("Insert", "Update", "Delete", "Merge", "Create", "Drop", "Alter", "Replace", "Truncate")


_CATALYST = "org.apache.spark.sql.catalyst"


def _is(item, kind: str) -> bool:
    return is_instance_of(SparkContext._gateway, item, f"{_CATALYST}.{kind}")


def _items(group) -> Iterator:
    for index in range(group.size()):
        yield group.apply(index)


def _nodes(plan) -> Iterator:
    """A plan's nodes, those of its common tables, and those of its subqueries."""
    yield plan
    for group in (plan.children(), plan.innerChildren()):
        for child in _items(group):
            if _is(child, "plans.logical.LogicalPlan"):
                yield from _nodes(child)
    for expression in _items(plan.expressions()):
        for part in _parts(expression):
            if _is(part, "expressions.PlanExpression"):
                yield from _nodes(part.plan())


def _parts(expression) -> Iterator:
    yield expression
    for child in _items(expression.children()):
        yield from _parts(child)


def _name(node) -> str:
    return node.getClass().getSimpleName()


def _called(node) -> Iterator[str]:
    """Names of the functions that a node calls itself, without their qualifiers."""
    if _name(node) == "UnresolvedTableValuedFunction":
        yield node.name().last().lower()
    for expression in _items(node.expressions()):
        for part in _parts(expression):
            if _name(part) == "UnresolvedFunction":
                yield part.nameParts().last().lower()


def _common_tables(node) -> set[str]:
    if _name(node) != "UnresolvedWith":
        return set()
    return {relation.productElement(0).lower() for relation in _items(node.cteRelations())}


def readonly_sql(spark: SparkSession, sql: str, tables: set[str] | None = None) -> str:
    """The cleaned text of a single SELECT / WITH statement, or ``ValueError``.

    It may call no JVM methods. With ``tables`` it may read these and its own common
    tables only.
    """
    cleaned = (sql or "").strip().rstrip(";").strip()
    first = cleaned.split(None, 1)[0].lower() if cleaned else ""
    if first.split("(")[0] not in ("select", "with"):
        raise ValueError("SQL must be a SELECT or WITH query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(cleaned)
    except ParseException as problem:
        raise ValueError(f"SQL does not parse: {problem}") from problem
    except Exception as problem:
        if "ParseException" in str(problem):
            raise ValueError(f"SQL does not parse: {problem}") from problem
        raise
    nodes = list(_nodes(plan))
    known = {table.lower() for table in tables or ()}.union(*map(_common_tables, nodes))
    for node in nodes:
        kind = _name(node)
        if kind.endswith(("Command", "Statement")) or kind.startswith(_WRITES):
            raise ValueError(f"SQL must only read ({kind})")
        if any(name in ESCAPES for name in _called(node)):
            raise ValueError("SQL may not call JVM methods")
        if tables is not None and kind == "UnresolvedRelation":
            parts = list(_items(node.multipartIdentifier()))
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ValueError(f"SQL reads an unknown table: {'.'.join(parts)}")
    return cleaned
