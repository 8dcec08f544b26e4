"""Sorts, limits and top-k.

Top-n is ``orderBy(...).limit(n)`` → ``TakeOrderedAndProject`` (each task keeps
n rows, the driver merges n × tasks). Per-group top-n is ``row_number <= n``,
which Spark plans as a partial + final ``WindowGroupLimit``. Missing values sort
last in both directions (pandas ``na_position='last'``); every order takes
tie-break columns so results are reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscope.functions.scalars import col
from rowscope.plans.ordering import row_index

# Words that mean ascending order.
ASC_WORDS = ("asc", "ascending", "升序")
# Words that mean descending order.
DESC_WORDS = ("desc", "descending", "降序")


def is_ascending(order: str | None, default: bool = True) -> bool:
    if order is None:
        return default
    o = str(order).strip().lower()
    if o in ASC_WORDS:
        return True
    return False


def _keys(column: str, ascending: bool, tiebreak: Sequence[str]) -> list[Column]:
    first = F.asc_nulls_last(column) if ascending else F.desc_nulls_last(column)
    return [first] + [F.asc_nulls_last(t) for t in tiebreak]


def sort_rows(df: DataFrame, column: str, order: str = "asc",
              tiebreak: Sequence[str] = (), position: str | None = None) -> DataFrame:
    """O1: sort by one column (NULLs last); ``position`` adds the dense 0-based
    rank computed with range partitioning (no single-task window)."""
    keys = _keys(column, is_ascending(order), tiebreak)
    if position:
        return row_index(df, keys, name=position)
    return df.orderBy(*keys)


def top_n(df: DataFrame, n: int = 5, column: str | None = None,
          columns: Sequence[str] | str | None = None, tiebreak: Sequence[str] = (),
          order_by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """O2/O3: n rows with the largest ``column`` (the smallest with ``order`` ascending: Z9), optional
    projection after the sort; without a column the first n rows of ``order_by``
    (arbitrary n rows when no order is given)."""
    n = int(n)
    if column:
        out = df.orderBy(*_keys(column, is_ascending(order, False), tiebreak)).limit(n)
    elif order_by:
        out = df.orderBy(*[F.asc_nulls_last(c) for c in order_by]).limit(n)
    else:
        out = df.limit(n)
    if columns:
        if isinstance(columns, str):
            columns = [c.strip() for c in columns.split(",")]
        out = out.select(*[col(c) for c in columns])
    return out


def group_top_n(df: DataFrame, group_column: str, sort_column: str, n: int = 1,
                order: str = "desc", keep_all: bool = True,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """First n rows per group; rows with a NULL group are dropped."""
    asc = is_ascending(order, default=False)
    w = Window.partitionBy(col(group_column)).orderBy(*_keys(sort_column, asc, tiebreak))
    out = (df.where(col(group_column).isNotNull())
           .withColumn("_rs_rn", F.row_number().over(w))
           .where(F.col("_rs_rn") <= int(n)).drop("_rs_rn"))
    return out if keep_all else out.select(col(group_column), col(sort_column))


def top_scored(scores: DataFrame, n: int = 5, score: str = "anomaly_score",
               cols: Sequence[str] = ("time_stamp",), tiebreak: Sequence[str] = ("row_id",)) -> DataFrame:
    """N highest-scored rows."""
    keep = [c for c in cols if c in scores.columns]
    return (scores.orderBy(*_keys(score, False, [t for t in tiebreak if t in scores.columns]))
            .limit(n).select(*keep, score))


def best_by(board: DataFrame, metric: str = "pr_auc", key: str = "algo") -> DataFrame:
    """The row key with the largest metric (ties → smallest key)."""
    return board.agg(F.max_by(F.col(key), F.struct(F.col(metric), -F.hash(F.col(key)))
                              ).alias(f"best_{key}"))


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    """O7."""
    return df.limit(n)
