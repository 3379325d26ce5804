"""Connected components by alternating large-star and small-star steps.

Edges never leave the executors. Each step is a minimum per node (combined
before the shuffle) and a join that adaptive execution may split, so a node
with very many edges is no single task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow_spark.session import cut_lineage, release_shuffles


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node either has one edge, down to a centre, or is a centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    by_node = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.max("e.up").alias("up"))
    return not by_node.where("down > 1 OR (down > 0 AND up > 0)").head(1)


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the least node of its component) of every node of ``edges`` (u, v)."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = cut_lineage(edges, slim=True)
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct(), slim=True)
        release_shuffles(edges.sparkSession)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
