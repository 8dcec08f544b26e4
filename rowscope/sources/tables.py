"""Parquet table access and the ingest rule: floating NaN becomes NULL.

pandas treats NaN, NaT and None alike; Spark keeps NaN distinct (it sorts
greatest, ``avg`` over it is NaN, ``NaN = NaN`` is true). The rule is applied
where data enters: the CSV readers apply it, and ``normalize_table`` writes a
Parquet table once with it applied. Reads of Parquet tables do **not** wrap
columns in ``nanvl`` by default: that projection would hide every predicate
on a floating column from the Parquet scan (no ``PushedFilters``, no row-group
skipping). ``read_table(..., nan_to_null=True)`` applies it per read when a
table was never normalised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in float/double columns (a projection: pruning still applies)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str, nan_to_null: bool = False) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _nan_to_null(df) if nan_to_null else df


def normalize_table(spark: SparkSession, src: str, dst: str, partition_by: list[str] | None = None) -> str:
    """Write ``src`` once with NaN → NULL so later reads keep predicate pushdown."""
    w = _nan_to_null(spark.read.parquet(src)).write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(dst)
    return dst


_nan_to_null = nan_to_null
