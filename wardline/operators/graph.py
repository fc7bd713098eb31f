"""Connected components of an undirected graph of pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.storage import HUB, cut, spread_join


def _with_least(edges: DataFrame, least, hub: int) -> DataFrame:
    """Edges with m, the least of `least` over all edges of their node a. Nodes of more than `hub` edges are dealt over tasks."""
    low = edges.groupBy("a").agg(least.alias("m"), F.count("*").alias("degree"))
    return spread_join(edges, cut(low), ["a"], "degree", ["b"], hub)


def _starred(edges: DataFrame) -> DataFrame:
    """One round for nodes of few edges: a node's ends are gathered, so each step is one shuffle."""
    ends = _both(edges).groupBy("a").agg(F.collect_set("b").alias("bs"))
    large = ends.select(F.least("a", F.array_min("bs")).alias("b"), F.explode(F.filter("bs", lambda x: x > F.col("a"))).alias("a"))
    ends = large.groupBy("a").agg(F.collect_set("b").alias("bs")).withColumn("m", F.array_min("bs"))
    return ends.select("a", "m", F.explode("bs").alias("b")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select("b", "a"))


def _shape(edges: DataFrame) -> tuple:
    """Whether some node is not yet in a star, and the greatest number of edges of a node. In a star every node but the least has one
    edge, down to the least."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(edges.select("b", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up"))
    loose = (F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") > 0))
    loose, most = ends.agg(F.coalesce(F.bool_or(loose), F.lit(False)), F.max(F.col("down") + F.col("up"))).collect()[0]
    return loose, most or 0


def components(edges: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the component is its smallest node.

    Large-star and small-star steps on the edges alone. While no node has more than `hub` edges, a node's ends are gathered; else each step
    is a minimum with map-side combining and an equi-join that deals hubs over tasks. A round ends in the checkpoint folder, and the loop stops when all edges form stars. Null ends make no edge."""
    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    loose, most = _shape(edges)
    while loose:
        if most <= hub:
            step = _starred(edges)
        else:
            large = _with_least(_both(edges), F.least(F.min("b"), F.min("a")), hub)
            large = large.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
            step = _with_least(cut(large), F.min("b"), hub)
            step = step.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = cut(step.where("a <> b").distinct())
        loose, most = _shape(edges)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
