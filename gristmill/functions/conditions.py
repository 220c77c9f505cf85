"""The fourteen row conditions, as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The condition names and the words read as true / false.
OPERATORS = (
    "equals",
    "not_equals",
    "greater_than",
    "less_than",
    "greater_or_equal",
    "less_or_equal",
    "contains",
    "not_contains",
    "starts_with",
    "ends_with",
    "is_empty",
    "is_not_empty",
    "is_true",
    "is_false",
)
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")


def _is_number(value: object) -> bool:
    try:
        float(str(value).strip())
    except ValueError:
        return False
    return True


def _number(kind: T.DataType, text: str) -> int | float | Decimal:
    """The comparand without loss: whole or decimal columns are not compared as doubles."""
    number = float(text)
    if isinstance(kind, (T.FloatType, T.DoubleType)) or number in (float("inf"), float("-inf")) or number != number:
        return number
    exact = Decimal(text.replace("_", ""))
    if isinstance(kind, T.IntegralType) and exact == exact.to_integral_value() and abs(exact) < 1 << 63:
        return int(exact)
    digits, places = len(exact.as_tuple().digits), -int(exact.as_tuple().exponent)
    return exact if max(digits, places) <= 38 and places >= 0 else number


def _compare(column: Column, kind: T.DataType, value: object, test) -> Column:
    """Compare as numbers when both sides are numbers, as text otherwise.

    A typed numeric or temporal column is compared in its own type, so that the
    comparison reaches the file scan as a pushed filter.
    """
    if isinstance(kind, T.NumericType) and _is_number(value):
        return test(column, F.lit(_number(kind, str(value).strip())))
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return test(column, F.lit(str(value)).cast(kind))
    text = column.cast("string")
    if _is_number(value):
        as_number = text.try_cast("double")
        return F.when(as_number.isNotNull(), test(as_number, F.lit(float(str(value))))).otherwise(
            test(text, F.lit(str(value)))
        )
    return test(text, F.lit(str(value)))


def condition(column: Column, kind: T.DataType, operator: str, value: object = None) -> Column:
    """A test to filter by: a null input gives null (no match), except that null is empty.

    The comparison is left bare so that Spark can push it into the file scan.
    """
    if operator not in OPERATORS:
        raise ValueError(f"operator must be one of {', '.join(OPERATORS)}")
    text = column.cast("string") if not isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else None
    if operator in ("is_empty", "is_not_empty"):
        if isinstance(kind, (T.ArrayType, T.MapType)):
            empty = column.isNull() | (F.size(column) == 0)
        elif isinstance(kind, T.StringType):
            empty = column.isNull() | (column == "")
        else:
            empty = column.isNull()
        return empty if operator == "is_empty" else ~empty
    if operator in ("is_true", "is_false"):
        words = TRUE_WORDS if operator == "is_true" else FALSE_WORDS
        return F.lower(text).isin(*words)
    if value is None:
        return F.lit(False)
    if operator in ("contains", "not_contains"):
        if isinstance(kind, T.ArrayType):
            found = F.array_contains(column, F.lit(value))
        else:
            found = text.contains(str(value))
        matched = found if operator == "contains" else ~found
    elif operator == "starts_with":
        matched = text.startswith(str(value))
    elif operator == "ends_with":
        matched = text.endswith(str(value))
    else:
        test = {
            "equals": lambda a, b: a == b,
            "not_equals": lambda a, b: a != b,
            "greater_than": lambda a, b: a > b,
            "less_than": lambda a, b: a < b,
            "greater_or_equal": lambda a, b: a >= b,
            "less_or_equal": lambda a, b: a <= b,
        }[operator]
        matched = _compare(column, kind, value, test)
    return matched
