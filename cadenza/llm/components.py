"""Connected components by alternating large-star and small-star.

Edges are a table (u, v) of node numbers.  Large-star links every larger
neighbour of a node to the smallest of its neighbourhood, small-star every
smaller one and the node itself; both keep the components.  Repeated, they
leave stars around each component's smallest node.  Minima are partial
aggregates, so a node with very many edges is folded before it is shuffled.
Every round is written to the shared folder: lineage stays short, and only a
count and a checksum reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge: the smallest node that it
    reaches.  Edges are pairs of longs ``u`` and ``v`` in any order."""
    current = saved(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
                    .where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        current = saved(_small_star(_large_star(current)).distinct(), "star")
        mark = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if mark == before:
            smallest = current.select(F.col("v").alias("id")).distinct()
            return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                smallest.select("id", F.col("id").alias("component")))
        before = mark
    raise RuntimeError("components did not settle")
