"""Row filters, projections and derived columns.

Predicates are Spark SQL expressions, so Catalyst pushes them into the Parquet
scan and prunes columns; nothing here leaves the JVM.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowscope.functions.scalars import as_time, col, time_diff, unit_seconds

# Pass-through predicates.
ALL_ROWS = ("true", "all", "*")

_CMP = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
        "<": lambda a, b: a < b, "==": lambda a, b: a == b, "=": lambda a, b: a == b,
        "!=": lambda a, b: a != b}
_DURATION = re.compile(
    r"^\s*`?(\w+)`?\s*-\s*`?(\w+)`?\s*(>=|<=|==|!=|=|>|<)\s*([0-9]*\.?[0-9]+)\s*"
    r"(seconds?|secs?|s|minutes?|mins?|m|hours?|h)\s*$", re.IGNORECASE)


# Text literals are matched first, so nothing inside them is rewritten.
_NOT_EQUAL = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`?\b([A-Za-z_]\w*)`?\s*!=\s*"""
                        r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?\b|true\b|false\b)""")


def select_rows(df: DataFrame, query: str, missing_matches_ne: bool = False) -> DataFrame:
    """Keep rows matching a Spark SQL predicate.

    * ``true`` / ``all`` / ``*`` → all rows (P2).
    * ``A - B <op> N unit`` with unit s/min/h → duration predicate on any two time
      columns and any comparator (P3); N may be fractional.
    * anything else is a Spark SQL boolean expression (P1). SQL semantics: a NULL
      comparison drops the row. ``missing_matches_ne=True`` rewrites every
      ``col != literal`` into ``NOT (col <=> literal)`` (pandas keeps missing rows there).
    """
    q = str(query).strip()
    if not q:
        raise ValueError("select_rows needs a query")
    if q.lower() in ALL_ROWS:
        return df
    m = _DURATION.match(q)
    if m and m.group(1) in df.columns and m.group(2) in df.columns:
        a, b, op, n, unit = m.groups()
        d = F.timestamp_diff("MICROSECOND", as_time(df, b), as_time(df, a)).cast("double")
        return df.where(_CMP[op](d, F.lit(float(n) * unit_seconds(unit) * 1e6)))
    if missing_matches_ne:
        q = _NOT_EQUAL.sub(lambda n: f"(NOT `{n[1]}` <=> {n[2]})" if n[1] else n[0], q)
    return df.where(F.expr(q))


def filter_time_between(df: DataFrame, column: str, start: str, end: str,
                        inclusive: str = "both") -> DataFrame:
    """``start <= c <= end`` with bound choice both/neither/left/right."""
    inc = str(inclusive).lower()
    if inc not in ("both", "neither", "left", "right"):
        raise ValueError("inclusive must be both/neither/left/right")
    c = as_time(df, column)
    s = F.lit(start).cast("timestamp_ntz")
    e = F.lit(end).cast("timestamp_ntz")
    lo = c >= s if inc in ("both", "left") else c > s
    hi = c <= e if inc in ("both", "right") else c < e
    return df.where(lo & hi)


def select_columns(df: DataFrame, columns) -> DataFrame:
    """P5: projection/reorder; list or comma separated string."""
    if isinstance(columns, str):
        columns = [c.strip() for c in columns.split(",") if c.strip()]
    columns = list(columns or [])
    if not columns:
        raise ValueError("select_columns needs at least one column")
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"unknown columns {missing}")
    return df.select(*[col(c) for c in columns])


_DIFF = re.compile(r"^\s*`?(\w+)`?\s*-\s*`?(\w+)`?\s*$")


def add_derived_column(df: DataFrame, name: str, formula: str, unit: str = "minutes",
                       safe: bool = False) -> DataFrame:
    """Derived column.

    ``A - B`` of two time columns → difference in ``unit`` (minutes default);
    of two numeric columns → plain subtraction (declared deviation). Any other
    formula is a Spark SQL expression; ``safe=True`` resolves it with ANSI mode off,
    so a zero divisor (of any ``/`` or ``%``, however nested) or a bad cast gives NULL
    instead of an error, and integer overflow wraps.
    """
    m = _DIFF.match(formula)
    if m and m.group(1) in df.columns and m.group(2) in df.columns:
        a, b = m.groups()
        ta, tb = df.schema[a].dataType, df.schema[b].dataType
        if isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType):
            return df.withColumn(name, col(a) - col(b))
        return df.withColumn(name, time_diff(as_time(df, a), as_time(df, b), unit))
    if not safe:
        return df.withColumn(name, F.expr(formula))
    conf = df.sparkSession.conf
    ansi = conf.get("spark.sql.ansi.enabled")
    conf.set("spark.sql.ansi.enabled", "false")  # read where the expression is resolved, which is here
    try:
        return df.withColumn(name, F.expr(formula))
    finally:
        conf.set("spark.sql.ansi.enabled", ansi)


def delay(df: DataFrame, column1: str, column2: str, name: str = "delay",
          group_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """delay = column1 - column2 in minutes, plus its mean as a second frame.

    With ``group_column`` the mean is per group (NULL groups dropped).
    """
    out = df.withColumn(name, time_diff(as_time(df, column1), as_time(df, column2), "minutes"))
    if group_column:
        mean = (out.where(col(group_column).isNotNull()).groupBy(group_column)
                .agg(F.avg(name).alias(f"avg_{name}")))
    else:
        mean = out.agg(F.avg(name).alias(f"avg_{name}"))
    return out, mean


def numeric_features(df: DataFrame, exclude=("anomaly", "changepoint"),
                     ids=()) -> list[str]:
    """P10: numeric and boolean columns minus labels and explicit ids."""
    skip = set(exclude) | set(ids)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in skip]


def align_features(train_cols: list[str], test_cols: list[str]) -> list[str]:
    """Features of the test set that also exist in train, in test order."""
    s = set(train_cols)
    return [c for c in test_cols if c in s]
