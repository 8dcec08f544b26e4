"""COPOD: copula-based outlier scores (D3; Li et al., 2020) as pure DataFrame work.

Per feature j and value v (n rows):
  L = −ln(#{x ≤ v} / n)     R = −ln(#{x ≥ v} / n)
  U = L if skew_j < 0, R if skew_j > 0, L + R if skew_j = 0
  O = max(U, (L + R) / 2);   score(row) = Σ_j O_j(v_row,j)

Counts are taken per distinct (j, v), so a value repeated by a third of the rows
is one row; the ECDF is the bucketed running count of that table. The per-value
table joins back to the long rows on (j, v) — a hot value is a skewed join key,
which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.detect.features import to_long
from rowscope.plans.ordering import prefix_sums


def copod_value_table(fm: DataFrame) -> DataFrame:
    """``(j, v, o)``: the contribution of value v of feature j."""
    lg = to_long(fm).where(F.col("v").isNotNull())
    counts = lg.groupBy("j", "v").agg(F.count(F.lit(1)).alias("c"))
    cum = prefix_sums(counts, "v", ["c"], ["j"])
    per_j = lg.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.skewness("v").alias("sk"))
    t = cum.join(F.broadcast(per_j), "j")
    n = F.col("n").cast("double")
    L = -F.log(F.col("cum_c") / n)
    R = -F.log((F.col("n") - F.col("cum_c") + F.col("c")) / n)
    t = t.select("j", "v", L.alias("L"), R.alias("R"), F.signum("sk").alias("s"))
    U = (F.when(F.col("s") < 0, F.col("L")).when(F.col("s") > 0, F.col("R"))
         .otherwise(F.col("L") + F.col("R")))
    return t.select("j", "v", F.greatest(U, (F.col("L") + F.col("R")) / 2).alias("o"))


def copod_scores(fm: DataFrame) -> DataFrame:
    """``(row_id, score)`` — larger is more anomalous."""
    lg = to_long(fm).where(F.col("v").isNotNull())
    o = copod_value_table(fm)
    return lg.join(o, ["j", "v"]).groupBy("row_id").agg(F.sum("o").alias("score"))
