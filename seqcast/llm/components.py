"""Connected components of a large graph by alternating large-star and small-star steps, as plain joins and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqcast.llm.common import written


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    """Each upper node with its lowest neighbour, as a table, so that a join with it may be split where a node is hot."""
    return written(edges.groupBy("u").agg(F.min("v").alias("low")), name)


def _starred(edges: DataFrame, name: str) -> DataFrame:
    """One round. Edges (u, v) with u > v come in and go out; both steps keep what is connected connected.

    Large star: the upper node of an edge is tied to the lowest neighbour of the lower one. Small star: the neighbours
    below a node, and the node, are tied to the lowest of them.
    """
    low = _lowest(edges, name).withColumnRenamed("u", "v")
    large = written(edges.join(low, "v", "left").select("u", F.coalesce("low", "v").alias("v")).distinct(), name)
    low = _lowest(large, name)
    tied = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return tied.union(low.select("u", F.col("low").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): the lowest node that is connected with it.

    Every round is written to a table, so lineage stays short and a lost executor costs one round. Rounds end when
    each node has one edge, to a node that has none below it: then the edges are the answer.
    """
    forward = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    now = written(forward, name)
    for _ in range(most_rounds):
        now = written(_starred(now, name), name)
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(now.select("v", F.lit(0), F.lit(1)))
        counts = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        if not counts.where("up > 1 or up > 0 and down > 0").limit(1).count():
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
    raise RuntimeError("components did not settle")
