"""Connected components of a link table, by alternating large and small stars.

Every step is a map-side combined minimum and a join on the node, so a hub with a third of all
links is summed up before the shuffle and its rows can be split by the join's skew handling.
Nothing is collected; each step's links are stored, and the loop ends when they no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwise.llm.scratch import Scratch


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: longs a and b. Returns node and component, the least node reachable, for every
    node of an edge between two nodes. Loops, doubles and nulls are ignored."""
    edges = scratch.save(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = scratch.save(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(edges, large)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
