"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges (a, b) -> (id, comp): the smallest id reachable, for every id with an edge.

    Each round links every neighbour to the smallest one it can see; rounds needed grow with the logarithm of the
    longest chain. A vertex's neighbours are never gathered: both steps are a minimum and a join.
    """
    pairs = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "cc")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        small = scratch.keep(small, "small")
        done = small.exceptAll(pairs).isEmpty() and pairs.exceptAll(small).isEmpty()
        scratch.drop(pairs, large)
        pairs = small
        if done:
            break
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("comp"))
    return stars.unionByName(stars.select(F.col("comp").alias("id"), "comp").distinct())
