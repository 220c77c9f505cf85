"""Row-level operators: filter, reshape, page, route, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.conditions import condition
from gristmill.functions.templates import interpolate
from gristmill.functions.values import number_of
from gristmill.operators.ordered import Order, cut_columns, sort_columns
from gristmill.operators.skew import slice_of, split_points

DEEP_OFFSET = 100_000


def _test(df: DataFrame, field: str, operator: str, value: object) -> Column:
    column = F.col(field)
    return condition(column, df.select(column).schema[0].dataType, operator, value)


def filter_rows(
    df: DataFrame,
    field: str,
    operator: str = "is_not_empty",
    value: object = None,
    keep: bool = True,
) -> DataFrame:
    """Keep (or drop) the rows that match; null never matches a comparison."""
    matched = _test(df, field, operator, value)
    return df.filter(matched if keep else ~F.coalesce(matched, F.lit(False)))


def filter_items(
    df: DataFrame, field: str, operator: str, value: object = None, keep: bool = True
) -> DataFrame:
    """Filter the elements of an array column: the test applies to the item itself."""
    kind = df.schema[field].dataType.elementType

    def matches(item: Column) -> Column:
        matched = condition(item, kind, operator, value)
        return matched if keep else ~F.coalesce(matched, F.lit(False))

    return df.withColumn(field, F.filter(F.col(field), matches))


def set_fields(df: DataFrame, fields: dict[str, object], include_input: bool = False) -> DataFrame:
    """Build output columns from templates, literals or Columns."""
    built = {n: v if isinstance(v, Column) else interpolate(v) for n, v in fields.items()}
    if include_input:
        return df.withColumns(built)
    return df.select(*[c.alias(n) for n, c in built.items()])


def page_rows(df: DataFrame, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """One page of ``limit`` rows (at least one) in a total order.

    A deep offset first counts rows per slice of the leading sort column, so only
    the slices that hold the page are sorted.
    """
    limit, offset = max(1, int(limit)), max(0, int(offset))
    if offset > DEEP_OFFSET:
        cut, descending = cut_columns(order)
        piece = slice_of(df, cut, split_points(df, cut, 256), descending)
        sizes = df.groupBy(piece.alias("piece")).count().orderBy("piece").collect()
        seen, wanted, skipped = 0, [], 0
        for row in sizes:
            if seen + row["count"] <= offset:
                skipped = seen + row["count"]
            elif seen < offset + limit:
                wanted.append(row["piece"])
            seen += row["count"]
        df, offset = df.filter(piece.isin(wanted)), offset - skipped
    return df.orderBy(*sort_columns(order)).offset(offset).limit(limit)


def sample_rows(df: DataFrame, key: str, n: int, seed: str = "0") -> DataFrame:
    """A repeatable random sample of ``n`` rows (at least one) without replacement."""
    n = max(1, int(n))
    ticket = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")))
    return df.withColumn("_ticket", ticket).orderBy("_ticket", key).limit(n).drop("_ticket")


def tag_route(df: DataFrame, branches: dict[str, Column], name: str = "route") -> DataFrame:
    """Name of the first branch whose condition holds, else ``else``."""
    tag = None
    for branch, test in branches.items():
        holds = F.coalesce(test, F.lit(False))
        tag = F.when(holds, branch) if tag is None else tag.when(holds, branch)
    return df.withColumn(name, tag.otherwise("else"))


def route_rows(df: DataFrame, branches: dict[str, Column]) -> dict[str, DataFrame]:
    """One DataFrame per branch plus ``else``; together they are the input."""
    tagged = tag_route(df, branches, "_route")
    return {
        branch: tagged.filter(F.col("_route") == branch).drop("_route")
        for branch in [*branches, "else"]
    }


def event_filter(df: DataFrame, accepted: list[str], event: str, action: str | None = None) -> DataFrame:
    """Accept rows whose ``event`` or ``event.action`` is listed; no list accepts all."""
    if not accepted:
        return df
    matched = F.col(event).isin(accepted)
    if action is not None:
        matched = matched | F.concat_ws(".", event, action).isin(accepted)
    return df.filter(matched)


def validate_records(df: DataFrame, fields: list[dict]) -> DataFrame:
    """Typed values and a list of messages per row.

    A field is ``{name, label?, type: text|number, required?}``. Accepted rows have
    no messages. Blank optional values become null.
    """
    values, messages = {}, []
    for field in fields:
        name, label = field["name"], field.get("label") or field["name"]
        text = F.trim(F.col(name).cast("string"))
        blank = F.coalesce(text == "", F.lit(True))
        if field.get("required"):
            messages.append(F.when(blank, F.lit(label)))
        if field.get("type") == "number":
            number = number_of(text)
            bad = ~blank & number.isNull()
            messages.append(F.when(bad, F.lit(f"{label} (must be a number)")))
            values[name] = number
        else:
            values[name] = F.when(~blank, text)
    listed = F.filter(F.array(*messages), lambda m: m.isNotNull()) if messages else F.array()
    return df.withColumn("_messages", listed).withColumns(values)


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of ``validate_records``."""
    return (
        checked.filter(F.size("_messages") == 0).drop("_messages"),
        checked.filter(F.size("_messages") > 0),
    )


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Pass and fail counts per rule, in one pass over the table."""
    passed = [F.count_if(F.coalesce(rule, F.lit(False))).alias(n) for n, rule in rules.items()]
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *passed)
    return counts.unpivot(["_rows"], list(rules), "rule", "passed").select(
        "rule", "passed", (F.col("_rows") - F.col("passed")).alias("failed")
    )


def map_items(df: DataFrame, column: str, step, collect: str = "items") -> DataFrame:
    """Apply ``step(item, index)`` to every element of an array column, in place.

    The elements of one row never leave it, so no shuffle is needed. ``step`` should
    use ``try_`` functions: a failing item then yields null instead of stopping.
    """
    return df.withColumn(collect, F.transform(F.col(column), step)).withColumn(
        "count", F.size(collect)
    )
