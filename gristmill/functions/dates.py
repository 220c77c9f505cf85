"""Date formatting and arithmetic on timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Format presets, as Spark datetime patterns.
PRESETS = {
    "iso": "yyyy-MM-dd'T'HH:mm:ss",
    "date": "yyyy-MM-dd",
    "time": "HH:mm:ss",
    "datetime": "yyyy-MM-dd HH:mm:ss",
    "us": "MM/dd/yyyy",
    "human": "MMMM d, yyyy",
}
# Strftime codes and the Spark pattern letters that mean the same.
STRFTIME = {
    "Y": "yyyy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "M": "mm",
    "S": "ss",
    "B": "MMMM",
    "b": "MMM",
    "A": "EEEE",
    "a": "EEE",
    "j": "DDD",
    "y": "yy",
    "I": "hh",
    "p": "a",
}
# Unit lengths in seconds.
UNIT_SECONDS = {
    "seconds": 1,
    "minutes": 60,
    "hours": 3_600,
    "days": 86_400,
    "weeks": 604_800,
}


def spark_pattern(fmt: str) -> str:
    """A preset name or strftime text as a Spark datetime pattern."""
    if fmt in PRESETS:
        return PRESETS[fmt]
    pattern, literal, chars = "", "", iter(fmt)

    def flush() -> str:
        return "'" + literal.replace("'", "''") + "'" if literal else ""

    for char in chars:
        if char != "%":
            literal += char
            continue
        code = next(chars, "")
        if code == "%":
            literal += "%"
        elif code in STRFTIME:
            pattern, literal = pattern + flush() + STRFTIME[code], ""
        else:
            raise ValueError(f"unsupported date code %{code}")
    return pattern + flush()


def _unit(unit: str) -> int:
    if unit not in UNIT_SECONDS:
        raise ValueError(f"unit must be one of {', '.join(UNIT_SECONDS)}")
    return UNIT_SECONDS[unit]


def dt_format(value: Column, fmt: str) -> Column:
    return F.date_format(value, spark_pattern(fmt))


def dt_add(value: Column, amount: Column | int | float, unit: str) -> Column:
    """Shift forward; fractions of a unit are allowed."""
    length = _unit(unit) * 1_000_000
    if isinstance(amount, Column):
        micros = (amount.cast("double") * F.lit(float(length))).cast("long")
    else:
        micros = F.lit(int(amount * length)).cast("long")
    return F.timestamp_micros(F.unix_micros(value.cast("timestamp")) + micros)


def dt_subtract(value: Column, amount: Column | int | float, unit: str) -> Column:
    return dt_add(value, -amount, unit)


def dt_diff(value: Column, to: Column, unit: str) -> Column:
    """``to`` minus ``value`` in the unit, as a double."""
    micros = F.unix_micros(to.cast("timestamp")) - F.unix_micros(value.cast("timestamp"))
    return micros / F.lit(1_000_000.0) / F.lit(float(_unit(unit)))


def dt_parts(value: Column) -> dict[str, Column]:
    return {
        "year": F.year(value),
        "month": F.month(value),
        "weekday": F.dayofweek(value),
        "hour": F.hour(value),
        "day": F.date_trunc("day", value),
        "month_start": F.date_trunc("month", value),
    }
