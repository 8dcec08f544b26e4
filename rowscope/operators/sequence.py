"""Ordered-sequence operators.

Rows have no implicit order in Spark: every operator takes an explicit total
order. Frames are evaluated on the block + halo layout of
``rowscope.plans.ordering`` so neither a global order nor a hot group ever lands
in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowscope.functions.scalars import as_num, col
from rowscope.plans.ordering import row_index, with_halo

DEFAULT_BLOCK = 100_000


def rolling_average(df: DataFrame, group_by: str | None, column: str, order_by: Sequence[str],
                    window: int = 3, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Trailing mean over ``window`` rows per group, ``min_periods=1``.

    Adds ``{column}_rollavg_{window}``. Missing values are skipped; rows with a
    NULL group get NULL. Positions are global over ``(group, order_by)``; blocks of
    ``block_rows`` positions carry the ``window-1`` preceding rows as halo, and
    the frame is evaluated per (block, group), so a group holding a third of the
    rows is spread over many tasks.
    """
    w = int(window)
    if w < 1:
        raise ValueError("window must be >= 1")
    name = f"{column}_rollavg_{w}"
    x = as_num(df, column)
    base = df.withColumn("_rs_x", x)
    lead = [F.asc_nulls_first(group_by)] if group_by else []  # None: one global series (Z7)
    idx = row_index(base, [*lead, *[F.asc_nulls_last(c) for c in order_by]], name="_rs_i")
    blk = with_halo(idx, "_rs_i", max(block_rows, w), before=w - 1, after=0)
    parts = ["_rs_blk", group_by] if group_by else ["_rs_blk"]
    frame = Window.partitionBy(*parts).orderBy("_rs_i").rowsBetween(-(w - 1), Window.currentRow)
    keep = col(group_by).isNotNull() if group_by else F.lit(True)
    out = (blk.withColumn(name, F.when(keep, F.avg("_rs_x").over(frame)))
           .where(~F.col("_rs_halo")))
    return out.drop("_rs_x", "_rs_i", "_rs_blk", "_rs_halo")


def smooth(df: DataFrame, column: str, order_by: Sequence[str], k: int = 5,
           name: str | None = None, block_rows: int = DEFAULT_BLOCK) -> DataFrame:
    """Centered moving mean of width k (odd) with edge replication.

    ``(sum of x over [i-h, i+h] ∩ [0, n-1] + missingL·x_0 + missingR·x_{n-1}) / k``,
    h = k // 2. A missing value inside the frame makes the result NULL (NaN
    propagates in the reference). ``k <= 1`` returns the column unchanged.
    """
    name = name or f"{column}_smooth_{k}"
    k = int(k)
    if k <= 1:
        return df.withColumn(name, as_num(df, column))
    if k % 2 == 0:
        raise ValueError("smooth needs an odd width (an even width changes the length)")
    h = k // 2
    base = df.withColumn("_rs_x", as_num(df, column))
    idx = row_index(base, [F.asc_nulls_last(c) for c in order_by], name="_rs_i")
    # three scalars: row count and the two edge values
    n, x0, xl = idx.agg(F.count(F.lit(1)), F.min_by("_rs_x", "_rs_i"), F.max_by("_rs_x", "_rs_i")).first()
    if not n:
        return idx.withColumn(name, F.lit(None).cast("double")).drop("_rs_x", "_rs_i")
    blk = with_halo(idx, "_rs_i", max(block_rows, h), before=h, after=h)
    frame = Window.partitionBy("_rs_blk").orderBy("_rs_i").rowsBetween(-h, h)
    i = F.col("_rs_i")
    miss_l = F.greatest(F.lit(0), F.lit(h) - i)
    miss_r = F.greatest(F.lit(0), i + h - F.lit(n - 1))
    total = (F.sum("_rs_x").over(frame) + miss_l * F.lit(x0) + miss_r * F.lit(xl)) / F.lit(float(k))
    has_null = F.count_if(F.col("_rs_x").isNull()).over(frame) > 0
    edge_null = F.lit(x0 is None or xl is None) & ((miss_l > 0) | (miss_r > 0))
    out = (blk.withColumn(name, F.when(~has_null & ~edge_null, total))
           .where(~F.col("_rs_halo")))
    return out.drop("_rs_x", "_rs_blk", "_rs_halo").withColumnRenamed("_rs_i", "row_idx")


def make_windows(df: DataFrame, features: Sequence[str], order_by: Sequence[str],
                 length: int = 100, stride: int = 1) -> DataFrame | None:
    """Sliding windows ``[T, D] → [N, L·D]`` (row-major: row 1's features, then row 2's…).

    Returns ``(win_start long, window array<double>)`` with starts ``0, s, 2s, …
    <= T-L``, or ``None`` when ``T < L`` (the caller falls back to points). Each
    row is sent to the at most ⌈L/s⌉ windows that contain it and windows are
    assembled by ``groupBy(win_start)``: every group holds exactly L rows.
    """
    L, s = int(length), int(stride)
    idx = row_index(df.select(*order_by, *features), [F.asc_nulls_last(c) for c in order_by], name="_rs_i")
    n = idx.count()
    if n < L:
        return None
    last_start = n - L
    i = F.col("_rs_i")
    # window starts w with w <= i <= w+L-1, w % s == 0, 0 <= w <= T-L
    lo = F.greatest(F.lit(0), i - (L - 1))
    lo = lo + F.pmod(F.lit(s) - F.pmod(lo, F.lit(s)), F.lit(s))
    hi = F.least(i, F.lit(last_start))
    vec = F.array(*[as_num(df, f) for f in features])
    rows = (idx.select(i.alias("_rs_i"), vec.alias("_rs_v"), lo.alias("_lo"), hi.alias("_hi"))
            .where(F.col("_lo") <= F.col("_hi"))
            .select("_rs_i", "_rs_v", F.explode(F.sequence("_lo", "_hi", F.lit(s).cast("long"))).alias("win_start")))
    return (rows.groupBy("win_start")
            .agg(F.array_sort(F.collect_list(F.struct(F.col("_rs_i"), F.col("_rs_v")))).alias("_w"))
            .select("win_start", F.flatten(F.transform("_w", lambda e: e["_rs_v"])).alias("window")))


def windows_to_points(win_scores: DataFrame, n_points: int, length: int,
                      score: str = "score", start: str = "win_start") -> DataFrame:
    """Point score = mean score of the windows covering the point; 0 if none.

    Returns ``(row_idx, score)`` for every position ``0 .. n_points-1``.
    """
    L = int(length)
    cover = (win_scores.select(F.explode(F.sequence(F.col(start), F.least(F.col(start) + L - 1,
                                                                           F.lit(n_points - 1)))).alias("row_idx"),
                               F.col(score).alias("_s"))
             .groupBy("row_idx").agg(F.avg("_s").alias("_m")))
    pts = win_scores.sparkSession.range(0, n_points).withColumnRenamed("id", "row_idx")
    return (pts.join(cover, "row_idx", "left")
            .select("row_idx", F.coalesce(F.col("_m"), F.lit(0.0)).alias(score)))
