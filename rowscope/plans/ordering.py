"""Exact global order without a single task.

Two shared building blocks (used by sequence, interval, evaluation and COPOD code):

* ``prefix_sums`` — running totals per group over a key that is unique within
  the group (callers pre-aggregate per distinct key first, so a hot key value is
  one row). Rows are range-partitioned by (group, key), which cuts a large group
  into as many pieces as its size asks and leaves small ones whole; running sums
  are taken inside the pieces. The pieces' totals are a table of one row per
  (group, piece), at most groups + partitions rows; its own running sum per group
  is the offset of each piece, joined back on (group, piece). One path for every
  number of rows, groups and pieces.

* ``row_index`` — dense 0-based position of every row in a total order.
  ``repartitionByRange`` splits ties of the leading key by the following keys, so
  a value holding a third of the rows still spreads over many tasks. Positions
  inside a range partition come from its sorted order; partition offsets are a
  table with one row per partition.

* ``with_halo`` — block + halo layout for centered/trailing row frames: each
  block of ``block_rows`` consecutive positions also receives the ``before`` rows
  preceding it and the ``after`` rows following it, so a window partitioned by
  block sees every neighbour it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowscope.session import reliable_checkpoint, shuffle_partitions

def prefix_sums(df: DataFrame, key: str, sums: Sequence[str], group: Sequence[str] = (),
                descending: bool = False, partitions: int | None = None, prefix: str = "cum_",
                total_prefix: str | None = None) -> DataFrame:
    """Add ``{prefix}{c}``: inclusive running sum of ``c`` in key order per group and, with
    ``total_prefix``, ``{total_prefix}{c}``: the group's sum.

    ``key`` must be unique within each group. Eager: the range-partitioned rows are
    checkpointed, so that pieces, totals and rows come from one set of range boundaries.
    """
    group = list(group)
    order = F.col(key).desc() if descending else F.col(key).asc()
    ranged = reliable_checkpoint(
        df.repartitionByRange(partitions or shuffle_partitions(df.sparkSession), *[F.col(g) for g in group], order)
        .withColumn("_rs_p", F.spark_partition_id()))
    local = Window.partitionBy(*group, "_rs_p").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranged.select("*", *[F.sum(c).over(local).alias(f"_rs_l_{c}") for c in sums])
    pieces = ranged.groupBy(*group, "_rs_p").agg(*[F.sum(c).alias(f"_rs_t_{c}") for c in sums])
    whole = Window.partitionBy(*group)
    before = whole.orderBy("_rs_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.select(
        *[F.col(g).alias(f"_rs_g{i}") for i, g in enumerate(group)], F.col("_rs_p").alias("_rs_q"),
        *[F.coalesce(F.sum(f"_rs_t_{c}").over(before), F.lit(0)).alias(f"_rs_o_{c}") for c in sums],
        *[F.sum(f"_rs_t_{c}").over(whole).alias(f"_rs_s_{c}") for c in sums if total_prefix])
    same = F.col("_rs_p") == F.col("_rs_q")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_rs_g{i}"))
    return rows.join(offsets, same).select(
        *df.columns, *[(F.col(f"_rs_o_{c}") + F.col(f"_rs_l_{c}")).alias(f"{prefix}{c}") for c in sums],
        *[F.col(f"_rs_s_{c}").alias(f"{total_prefix}{c}") for c in sums if total_prefix])


def row_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_idx",
              partitions: int | None = None) -> DataFrame:
    """Dense 0-based position in ``order`` (which must be a total order).

    Eager: the range-partitioned, sorted rows are checkpointed so that the
    partition offsets and the rows can never come from two different range
    boundaries (the boundaries are sampled per execution).
    """
    p = partitions or shuffle_partitions(df.sparkSession)
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = (df.repartitionByRange(p, *cols).sortWithinPartitions(*cols)
              .withColumn("_rs_pid", F.spark_partition_id())
              .withColumn("_rs_loc", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_rs_pid").cast("long"), 33)))
    ranged = reliable_checkpoint(ranged)
    counts = ranged.groupBy("_rs_pid").agg(F.count(F.lit(1)).alias("_rs_n"))
    # One row per partition: an unpartitioned window over it is trivially small.
    w = Window.orderBy("_rs_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_rs_pid", F.coalesce(F.sum("_rs_n").over(w), F.lit(0)).alias("_rs_off"))
    return (ranged.join(F.broadcast(offs), "_rs_pid")
            .withColumn(name, F.col("_rs_off") + F.col("_rs_loc"))
            .drop("_rs_pid", "_rs_loc", "_rs_off"))


def with_halo(df: DataFrame, idx: str, block_rows: int, before: int, after: int) -> DataFrame:
    """Block + halo layout: adds ``_rs_blk`` and ``_rs_halo`` (true for copies).

    Each row belongs to block ``idx div block_rows``; it is copied into every other
    block whose rows lie within ``before``/``after`` positions of it. Requires
    ``before, after <= block_rows``.
    """
    if before > block_rows or after > block_rows:
        raise ValueError("halo wider than a block")
    i = F.col(idx)
    blk = F.floor(i / block_rows).cast("long")
    off = i - blk * block_rows
    # a row at offset o is needed by the next block if o >= block_rows - before
    # (it precedes that block's first rows) and by the previous block if o < after.
    targets = F.array(
        F.struct(blk.alias("b"), F.lit(False).alias("h")),
        F.when(off >= block_rows - before, F.struct((blk + 1).alias("b"), F.lit(True).alias("h"))),
        F.when((off < after) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("h"))),
    )
    return (df.withColumn("_rs_t", F.explode(F.array_compact(targets)))
            .withColumn("_rs_blk", F.col("_rs_t.b")).withColumn("_rs_halo", F.col("_rs_t.h"))
            .drop("_rs_t"))
