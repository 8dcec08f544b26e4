"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowscope.session import reliable_checkpoint


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files and checkpoints of earlier steps that nothing refers to any
    more. It acts when the driver collects garbage, which a short job may never do by itself."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _pairs(*both) -> Column:
    """One row for each (u, v) pair of columns."""
    return F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in both]))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) with u > v. Minima are grouped sums with map-side
    combination and join back, so a node with very many links is split like any skewed key."""
    if large:
        both = edges.select(_pairs(("u", "v"), ("v", "u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(_pairs(("v", "m"), ("u", "m")))
    return out.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one root that hangs on none: what the star operations leave unchanged."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("hangs")),
                                         F.struct(F.col("v").alias("node"), F.lit(0).alias("hangs")))))
    nodes = ends.groupBy("node").agg(F.sum("hangs").alias("up"), F.count("*").alias("n"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("n") > F.col("up"))))).first()[0] == 0


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of its component for every node that has a link."""
    edges = reliable_checkpoint(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not _are_stars(edges):
        edges = reliable_checkpoint(_star(_star(edges, True), False))
        release(edges.sparkSession)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
