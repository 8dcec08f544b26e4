"""Bipartite machine ↔ job graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowscope.functions.scalars import col

# Node-id prefixes of the two sides.
LEFT_PREFIX = "M::"
RIGHT_PREFIX = "J::"


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs with both members present."""
    return df.select(col(a).alias(a), col(b).alias(b)).dropna().distinct()


def bipartite(df: DataFrame, machine_col: str = "Machine_ID", job_col: str = "Job_ID"
              ) -> tuple[DataFrame, DataFrame]:
    """G1: ``nodes(node_id, side, label, degree)`` and ``edges(src, dst)``.

    Node ids carry the side prefix; degree is the number of distinct partners.
    """
    pairs = distinct_pairs(df, machine_col, job_col)
    m = F.concat(F.lit(LEFT_PREFIX), col(machine_col).cast("string"))
    j = F.concat(F.lit(RIGHT_PREFIX), col(job_col).cast("string"))
    edges = pairs.select(m.alias("src"), j.alias("dst"))
    ends = pairs.select(F.explode(F.array(
        F.named_struct(F.lit("node_id"), m, F.lit("side"), F.lit(0), F.lit("label"), col(machine_col).cast("string")),
        F.named_struct(F.lit("node_id"), j, F.lit("side"), F.lit(1), F.lit("label"), col(job_col).cast("string"))
    )).alias("n")).select("n.*")
    nodes = ends.groupBy("node_id", "side", "label").agg(F.count(F.lit(1)).alias("degree"))
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> str:
    """Node and edge tables as Parquet (the GEXF writer is not built)."""
    nodes.write.mode("overwrite").parquet(f"{path.rstrip('/')}/nodes")
    edges.write.mode("overwrite").parquet(f"{path.rstrip('/')}/edges")
    return path
