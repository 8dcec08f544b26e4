"""Interval concurrency.

+1 at every start, −1 at every end; the running count after each event; the
mean of those step values per time bucket; empty buckets forward-filled.

Everything is aggregated per distinct time before any ordered step, so a time
shared by a third of the rows is one row. The running count over distinct
times is a bucketed prefix sum; the per-event step values inside one time are
summed in closed form (starts before ends, as the fixed tie order).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscope.functions.scalars import as_time
from rowscope.plans.ordering import prefix_sums
from rowscope.session import reliable_checkpoint

# Pandas offset aliases and their length in seconds.
FREQ_UNITS = {"S": 1, "s": 1, "T": 60, "min": 60, "H": 3600, "h": 3600, "D": 86400, "W": 604800}


def freq_seconds(freq: str) -> int:
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", str(freq))
    if not m or m.group(2) not in FREQ_UNITS:
        raise ValueError(f"unsupported frequency {freq!r}")
    return int(m.group(1) or 1) * FREQ_UNITS[m.group(2)]


def interval_events(df: DataFrame, start: str, end: str) -> DataFrame:
    """One scan → ``(t, delta)`` rows, +1 at start and −1 at end; NULL times dropped."""
    ev = F.explode(F.array(
        F.named_struct(F.lit("t"), as_time(df, start), F.lit("delta"), F.lit(1)),
        F.named_struct(F.lit("t"), as_time(df, end), F.lit("delta"), F.lit(-1))))
    return df.select(ev.alias("_e")).select("_e.t", "_e.delta").where(F.col("t").isNotNull())


def forward_fill(df: DataFrame, idx: str, value: str, block: int = 4096) -> DataFrame:
    """Replace NULL ``value`` by the last non-NULL one at a smaller dense ``idx``.

    Blocks of ``block`` consecutive indexes fill locally; each block's last
    non-NULL value forms a small table whose own fill gives the carry-in.
    """
    b = F.floor(F.col(idx) / block).cast("long")
    d = df.withColumn("_rs_fb", b)
    local = F.last(value, ignorenulls=True).over(
        Window.partitionBy("_rs_fb").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("_rs_local", local)
    tails = (d.where(F.col(value).isNotNull()).groupBy("_rs_fb")
             .agg(F.max_by(value, idx).alias("_rs_tail")))
    # one row per block: the carry-in of block b is the last tail of blocks < b;
    # a single-partition window over this small table is fine.
    blocks = d.select("_rs_fb").distinct().join(tails, "_rs_fb", "left")
    carry_in = blocks.select("_rs_fb", F.last("_rs_tail", ignorenulls=True).over(
        Window.orderBy("_rs_fb").rowsBetween(Window.unboundedPreceding, -1)).alias("_rs_carry"))
    return (d.join(carry_in, "_rs_fb", "left")
            .withColumn(value, F.coalesce(F.col("_rs_local"), F.col("_rs_carry")))
            .drop("_rs_fb", "_rs_local", "_rs_carry"))


def concurrency(df: DataFrame, start: str = "Actual_Start", end: str = "Actual_End",
                freq: str = "10T") -> DataFrame:
    """``(bucket timestamp_ntz, concurrent double)`` for every bucket from the
    first to the last event; bins are left-closed, labelled by their start, and
    aligned to midnight of the first event's day (pandas ``origin='start_day'``).

    The mean is per event (not time-weighted), over the running count right after
    each event, with starts ordered before ends at equal times.
    """
    f_us = freq_seconds(freq) * 1_000_000
    ev = interval_events(df, start, end)
    per_t = ev.groupBy("t").agg(F.count_if(F.col("delta") > 0).alias("s"),
                                F.count_if(F.col("delta") < 0).alias("e"))
    # one row per distinct time: every later step reads this table, not the input
    per_t = reliable_checkpoint(per_t.withColumn("net", F.col("s") - F.col("e")))
    cum = prefix_sums(per_t, "t", ["net"])
    cb = F.col("cum_net") - F.col("net")  # count before this time
    s, e = F.col("s"), F.col("e")
    step_sum = s * cb + s * (s + 1) / 2 + e * (cb + s) - e * (e + 1) / 2
    origin = per_t.agg(F.date_trunc("day", F.min("t")).alias("o")).first()["o"]
    if origin is None:
        return df.sparkSession.createDataFrame([], "bucket timestamp_ntz, concurrent double")
    o_lit = F.lit(str(origin)).cast("timestamp_ntz")  # text form: independent of time zones
    k = F.floor(F.timestamp_diff("MICROSECOND", o_lit, F.col("t")) / F.lit(f_us)).cast("long")
    per_b = (cum.select(k.alias("k"), step_sum.alias("v"), (s + e).alias("c"))
             .groupBy("k").agg((F.sum("v") / F.sum("c")).alias("m")))
    lo, hi = per_b.agg(F.min("k"), F.max("k")).first()
    spark = df.sparkSession
    allb = spark.range(lo, hi + 1).withColumnRenamed("id", "k")
    filled = forward_fill(allb.join(per_b, "k", "left"), "k", "m")
    return filled.select(F.expr(f"timestampadd(MICROSECOND, k * {f_us}, CAST('{origin}' AS TIMESTAMP_NTZ))")
                         .alias("bucket"), F.col("m").cast("double").alias("concurrent"))

