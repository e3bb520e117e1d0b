"""Connected components of a distributed edge list, by alternating large-star and small-star steps.

Edges stay in tables throughout; the driver sees a count and a checksum for each round. Each
round is checkpointed. The number of rounds grows with the logarithm of a component's size. A hub's
edges, or those of a large component's root, are joined with one row: adaptive execution splits
such a partition, and minima are pre-aggregated by task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(hash(v, u) as long))")).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one orderable type, u <> v. Returns (node, root), root the smallest node of the component; nodes without edges are not in it."""
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = materialize(links.distinct())
        was, state = state, _state(edges)
        if was == state:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
