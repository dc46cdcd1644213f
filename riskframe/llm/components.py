"""Connected components by alternating large and small stars.

Every step is a grouped minimum and a join; no node's neighbours are collected.  Edges are written to the shared folder
after each round.  Rounds end when every edge points at its component's smallest node, which a round would leave as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import discard, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    out = both.join(least, "u").where("v > u and v <> m")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether no node points twice, and none both points and is pointed at; edges (u, v) go from a node to a smaller one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    per = ends.groupBy("node").agg(F.sum("out").alias("_out"), F.count(F.lit(1)).alias("_all"))
    return not per.where("_out > 1 or (_out = 1 and _all > 1)").agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); root is the smallest node of the component."""
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges, "edges")
    while not _settled(edges):
        last, edges = edges, stored(_small_star(_large_star(edges)), "edges")
        discard(last)
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def as_edges(roots: DataFrame) -> DataFrame:
    """Edges (u, v) with the components that ``roots`` has, as few as can be."""
    return roots.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
