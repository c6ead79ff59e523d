"""Connected components of an edge table by alternating large and small stars.

Each round is two aggregates and joins on the node, written to the shared
folder; the rounds end when the edge table no longer changes. No node's
neighbours are gathered in one row; once the edges are more than one task
should hold, those of the centre of a large star are joined by a broadcast of
the few such centres. Nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, materialise


FEW = 1 << 16  # edges that any task can hold


def _joined(edges: DataFrame, least: DataFrame, number: int) -> DataFrame:
    """edges with the m of their a."""
    return edges.join(least.select("a", "m"), "a") if number <= FEW else join_hot(edges, least, ["a"], "n", number)


def _stamp(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return got.n, got.x


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) -> (node, root): for every node on an edge the smallest
    node that it can reach. Null ends, loops and repeated edges are ignored."""
    low, high = F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")
    now = materialise(edges.filter("a <> b").select(high, low).distinct(), name)
    stamp = _stamp(now)
    while stamp[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _joined(both.filter("b > a"), least, 2 * stamp[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        tops = least.filter("m < a").select("a", F.col("m").alias("b"))  # keeps each node's own tie to its least neighbour
        large = large.unionByName(tops).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _joined(large, least, 2 * stamp[0]).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        seen, stamp = stamp, _stamp(after)
        discard(now)
        now = after
        if seen == stamp:
            break
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
