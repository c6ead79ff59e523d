"""Sums and maxima over subtrees and paths by doubling.

After round j every node has what the nodes less than 2^j below it (or above
it) hold; the next round adds what stands 2^j away. Rounds grow with the
logarithm of the depth, and each has one row for a node and key that holds
something, and one for the ancestor it is passed to: no row for each pair of a
node and an ancestor.

Forests are tables of nodes with paths (root .. node); an ancestor at a given
distance is read off the path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle


def steps(forest: DataFrame) -> list[int]:
    """1, 2, 4, .. below the greatest depth."""
    depth = forest.agg(F.max(F.size("path"))).first()[0] or 0
    return [1 << j for j in range(max(depth - 1, 0).bit_length())]


def above(forest: DataFrame, step: int, node: str) -> DataFrame:
    """node, __up: the ancestor `step` levels over it, where there is one."""
    return forest.filter(F.size("path") > step).select(node, F.element_at("path", F.size("path") - step).alias("__up"))


def climb(rows: DataFrame, forest: DataFrame, far: list[int], keys: list[str], aggs: list[Column], node: str = "hog_id") -> DataFrame:
    """keys, node and the aggregates (each named like the column it combines)
    over all rows at or below the node. Each round combines before it shuffles,
    so a root under many nodes is no hot key."""
    now = rows.groupBy(*keys, node).agg(*aggs) if aggs else rows.select(*keys, node).distinct()
    for step in far:
        values = [c for c in now.columns if c not in (*keys, node)]
        passed = now.join(above(forest, step, node), node, "left").select(*keys, F.explode(F.array_compact(F.array(node, "__up"))).alias(node), *values)
        now = passed.groupBy(*keys, node).agg(*aggs) if aggs else passed.distinct()
    return now


def gather(rows: DataFrame, forest: DataFrame, far: list[int], keys: list[str], value: str, node: str = "hog_id") -> DataFrame:
    """rows(keys, node, value, ..) with value summed over the path to the node.
    With a node all nodes on its path must have rows."""
    for step in far:
        now = settle(rows, "gathered")
        over = now.select(*keys, F.col(node).alias("__up"), F.col(value).alias("__more"))
        rows = now.join(above(forest, step, node), node, "left").join(over, [*keys, "__up"], "left").withColumn(value, F.col(value) + F.coalesce("__more", F.lit(0))).select(*now.columns)
    return rows
