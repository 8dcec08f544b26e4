"""Scalar helpers (F1-F11): all built-in Column expressions, codegen friendly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT_SECONDS = {"s": 1.0, "sec": 1.0, "second": 1.0, "seconds": 1.0,
                 "m": 60.0, "min": 60.0, "minute": 60.0, "minutes": 60.0,
                 "h": 3600.0, "hour": 3600.0, "hours": 3600.0}


def col(c: str | Column) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c if c.startswith("`") or "." not in c else f"`{c}`")


def to_num(c: str | Column) -> Column:
    """numeric coercion; text that is not a number becomes NULL (no ANSI error)."""
    return (col(c).cast("string")).try_cast("double")


def to_time(c: str | Column) -> Column:
    """datetime coercion to timestamp_ntz; unparsable text becomes NULL."""
    return (col(c).cast("string")).try_cast("timestamp_ntz")


def as_num(df, c: str) -> Column:
    """F1 with the schema known: numeric columns pass through, others are coerced."""
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType)):
        return col(c).cast("double")
    return to_num(c)


def as_time(df, c: str) -> Column:
    """F2 with the schema known: timestamp columns pass through."""
    from pyspark.sql import types as T
    if isinstance(df.schema[c].dataType, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        return col(c)
    return to_time(c)


def unit_seconds(unit: str) -> float:
    u = str(unit).lower().strip()
    if u in _UNIT_SECONDS:
        return _UNIT_SECONDS[u]
    for k, v in (("hour", 3600.0), ("min", 60.0), ("sec", 1.0)):
        if u.startswith(k):
            return v
    raise ValueError(f"unknown time unit {unit!r}")


def time_diff(end: str | Column, start: str | Column, unit: str = "seconds") -> Column:
    """(end - start) in seconds/minutes/hours as double.

    ``timestampdiff`` works on timestamp_ntz (``unix_micros`` does not).
    """
    micros = F.timestamp_diff("MICROSECOND", col(start), col(end))
    return micros.cast("double") / F.lit(1e6 * unit_seconds(unit))


def fill0(c: str | Column) -> Column:
    """missing → 0."""
    return F.coalesce(col(c), F.lit(0))


def rnd(c: str | Column, digits: int = 6) -> Column:
    """F8: half-up rounding (compare engines at 6 digits on unrounded inputs)."""
    return F.round(col(c), digits)


def clip_text(c: str | Column, n: int, marker: str = "…") -> Column:
    """clip long text and append a marker."""
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x)


def bool01(c: str | Column) -> Column:
    """boolean → 0/1."""
    return col(c).cast("int")
