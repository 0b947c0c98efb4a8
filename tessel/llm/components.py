"""Connected components of an edge table, with labels that are least node ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each node's greater neighbours to the least of the node and its neighbours; edges: hi, lo."""
    both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("least"))
    return edges.join(least, edges.lo == least.u).select("hi", F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each node and its lesser neighbours to the least of them; edges: hi, lo."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    moved = edges.join(least, "hi").filter("lo != least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.union(least.select("hi", F.col("least").alias("lo"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node that edges (a, b: bigint) names; component: the least node reachable.

    Large stars and small stars in turn (Kiveris and others, 2014) until every
    component is a star around its least node: the number of edges does not
    grow, and rounds grow with the logarithm of the nodes, a shuffled path
    included (10 for one of 5,000 nodes). Edges are written to the shared folder
    each round. An empty table has no rows; loops and repeated edges are
    harmless; rows with a null are ignored.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    edges = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    nodes = edges.select(F.col("hi").alias("node")).union(edges.select("lo")).distinct()
    stars = edges.filter("hi != lo")
    while True:
        # a node is neither linked twice nor itself linked to
        ends = stars.select(F.col("hi").alias("node"), F.lit(1).alias("links"), F.lit(0).alias("centre")).union(stars.select("lo", F.lit(0), F.lit(1)).distinct())
        if not ends.groupBy("node").agg(F.sum("links").alias("links"), F.max("centre").alias("centre")).filter("links + centre > 1").limit(1).count():
            break
        stars = written(_small_star(written(_large_star(stars), "edges")), "edges")
    return written(nodes.join(stars, nodes.node == stars.hi, "left").select("node", F.coalesce("lo", "node").alias("component")), "labels")
