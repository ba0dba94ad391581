"""Connected components of an edge table, each node getting the least node it reaches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges hold the same ones, compared row by row."""
    both = a.select("u", "v", F.lit(1).alias("side")).unionByName(b.select("u", "v", F.lit(-1).alias("side")))
    return not both.groupBy("u", "v").agg(F.sum("side").alias("side")).where("side <> 0").limit(1).count()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (long columns); nulls and loops are left out.

    Large-star and small-star steps alternate: each node links its larger neighbours, then its smaller ones, to the
    least node near it, until no edge changes. A step needs sums by node only, so a hub with any number of edges is
    never gathered. Edges are checkpointed every round; pass checkpointed or written ones.
    """
    e = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    for _ in range(rounds):
        before = e
        # large star: of each node's neighbours, itself included, the least; larger neighbours link to it
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours of a node, and the node, link to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(large.join(low, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x")).select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        if _same(before, e):
            break
    else:
        raise RuntimeError(f"components: not settled after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
