"""Registered queries: one per operator of the inventory, each over whole tables.

Every query takes ``(spark, sf_dir)`` and returns a DataFrame; ``ORACLE`` holds
the DuckDB SQL computing the same result on the same Parquet views. Numeric
results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the given (or all floating) columns to 6 digits."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.select(*[F.round(F.col(c), 6).alias(c) if c in names else F.col(c) for c in df.columns])


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def line_orders(spark: SparkSession, sf: str) -> DataFrame:
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                         "l_shipdate", "l_quantity")
    od = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey")
    return li.join(od, li.l_orderkey == od.o_orderkey)


LINE_ORDERS_SQL = ("(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, "
                   "o_orderkey, o_orderdate, o_orderpriority, o_custkey FROM lineitem "
                   "JOIN orders ON l_orderkey = o_orderkey)")


def load() -> tuple[dict, dict]:
    """Import every query module (each registers its queries) and return the registries."""
    from rowscope.plans import queries_tabular  # noqa: F401
    from rowscope.plans import queries_sequence  # noqa: F401
    from rowscope.plans import queries_detect  # noqa: F401
    from rowscope.plans import queries_text  # noqa: F401
    from rowscope.plans import queries_benchmark  # noqa: F401
    return QUERIES, ORACLE
