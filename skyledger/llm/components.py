"""Connected components of a graph given as a table of links, without collecting it anywhere.

Alternating large-star and small-star steps (Kiveris and others, "Connected Components in MapReduce and Beyond", 2014):
each step hangs the neighbours of a node on the smallest of them, found by an aggregation with a map side and joined back,
so a node with very many neighbours is never gathered in a task. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def _hang(pairs: DataFrame) -> DataFrame:
    """pairs (node, near) with the smallest of near and the node itself as ``root``."""
    least = pairs.groupBy("node").agg(F.least(F.col("node"), F.min("near")).alias("root")).withColumnRenamed("node", "_node")
    return pairs.join(least, pairs["node"] == least["_node"]).drop("_node")


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node, root for every node of links: root is the smallest node that is reachable. Links are undirected; loops and repeats are allowed."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = written(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.select(F.col("u").alias("node"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("node"), F.col("u").alias("near")))
        large = _hang(both).filter("near > node").select(F.col("near").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct()
        down = _hang(large.select(F.col("u").alias("node"), F.col("v").alias("near")))
        small = down.select(F.col("near").alias("u"), F.col("root").alias("v")).unionByName(down.select(F.col("node").alias("u"), F.col("root").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"no fixed point within {rounds} rounds")
