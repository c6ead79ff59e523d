"""Forests by their Euler tours: every node is entered and left once, and what
depends on the order or the extent of subtrees becomes a sort, a prefix sum or
an interval. No recursion, and no row for each pair of a node and an ancestor:
trees may be as deep as they have nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import number_rows, running_sum, settle


def tour(nodes: DataFrame, node: str = "id", parent: str = "parent", order: str | None = None) -> DataFrame:
    """nodes with tree (the root), enter and leave (from 0 in each tree), n_children
    and first (whether no sibling comes before). Siblings follow `order`, else
    their names.

    The tour is a linked list of two events for each node; its ranks are found
    by pointer doubling, in rounds that grow with the logarithm of its length
    and each have as many rows as there are events. A parent that is not a
    node, a node that stands twice, or a cycle, is an error."""
    by = F.col(order or node)
    rows = nodes.select(F.col(node).alias("__v"), F.col(parent).alias("__p"), by.alias("__o"))
    ranked = settle(number_rows(rows, [F.col("__p").asc_nulls_first(), F.col("__o"), F.col("__v")], "__i"), "ranked")
    n = ranked.count()
    if ranked.select("__v").distinct().count() != n:
        raise ValueError("a node stands more than once")
    # events: 2 i enters, 2 i + 1 leaves
    after = ranked.select((F.col("__i") - 1).alias("__i"), F.col("__i").alias("__next"), F.col("__p").alias("__np"))
    up = ranked.select(F.col("__v").alias("__p"), F.col("__i").alias("__pi"))
    below = ranked.filter("__p is not null").groupBy(F.col("__p").alias("__v")).agg(F.min("__i").alias("__first"), F.count(F.lit(1)).alias("n_children"))
    linked = settle(ranked.join(after, "__i", "left").join(up, "__p", "left").join(below, "__v", "left"), "linked")
    if not linked.filter("__p is not null and __pi is null").isEmpty():
        raise ValueError("a parent is not among the nodes")
    sibling = F.when(F.col("__p").isNotNull() & (F.col("__np") == F.col("__p")), 2 * F.col("__next"))
    links = linked.select((2 * F.col("__i")).alias("e"), F.coalesce(2 * F.col("__first"), 2 * F.col("__i") + 1).alias("to")).unionByName(
        linked.select((2 * F.col("__i") + 1).alias("e"), F.coalesce(sibling, 2 * F.col("__pi") + 1).alias("to"))
    )
    now = settle(links.select("e", "to", F.lit(1).cast("long").alias("left"), F.coalesce("to", "e").alias("end")), "links")
    rounds = 0
    while not now.filter("to is not null").isEmpty():
        rounds += 1
        if 1 << (rounds - 1) > 4 * n:  # by then every list would have been walked
            raise ValueError("the parents form a cycle")
        ahead = now.select(F.col("e").alias("to"), F.col("to").alias("t2"), F.col("left").alias("l2"), F.col("end").alias("e2"))
        now = settle(now.join(ahead, "to", "left").select("e", F.col("t2").alias("to"), (F.col("left") + F.coalesce("l2", F.lit(0))).alias("left"), F.coalesce("e2", "end").alias("end")), "links")
    places = now.groupBy(F.floor(F.col("e") / 2).alias("__i")).agg(F.max("left").alias("__in"), F.min("left").alias("__out"), F.first("end").alias("__end"))
    roots = linked.filter("__p is null").join(places, "__i").select(F.col("__end"), F.col("__v").alias("tree"), F.col("__in").alias("__all"))
    found = linked.join(places, "__i").join(roots, "__end").join(
        below.select(F.col("__v").alias("__p"), F.col("__first").alias("__eldest")), "__p", "left"
    ).select(
        F.col("__v"), "tree", (F.col("__all") - F.col("__in")).alias("enter"), (F.col("__all") - F.col("__out")).alias("leave"),
        F.coalesce("n_children", F.lit(0)).alias("n_children"), (F.col("__p").isNull() | (F.col("__i") == F.col("__eldest"))).alias("first"),
    )
    return nodes.join(settle(found, "tour"), nodes[node] == F.col("__v")).drop("__v")


def events(toured: DataFrame, entering: Column, leaving: Column, name: str = "value") -> DataFrame:
    """tree, at, value: one row for entering and one for leaving each node."""
    return toured.select("tree", F.col("enter").alias("at"), entering.alias(name)).unionByName(toured.select("tree", F.col("leave").alias("at"), leaving.alias(name)))


def traverse(toured: DataFrame, leaf: Column | None = None, prefix: Column | None = None, postfix: Column | None = None) -> DataFrame:
    """tree, at, hook, value in the order of a depth-first visit: prefix before
    and postfix after the nodes below, leaf at nodes without any (a root counts
    as an inner node). Hooks are columns of the node; those not given are left out."""
    inner = (F.col("n_children") > 0) | (F.col("enter") == 0)
    hooks = [("leaf", leaf, ~inner, "enter"), ("prefix", prefix, inner, "enter"), ("postfix", postfix, inner, "leave")]
    parts = [toured.filter(when).select("tree", F.col(at).alias("at"), F.lit(hook).alias("hook"), value.alias("value")) for hook, value, when, at in hooks if value is not None]
    if not parts:
        raise ValueError("no hook is given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def gathered(visits: DataFrame, keys: list[str] = ("tree",)) -> DataFrame:
    """keys, values: what the hooks gave, in order; a list for each tree."""
    return visits.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))


def below_sums(toured: DataFrame, node: str, value: Column, name: str = "total") -> DataFrame:
    """node, total of value at or below every node, by prefix sums."""
    v = F.coalesce(value, F.lit(0))
    steps = events(toured.withColumn("__x", v), F.struct(F.col(node).alias("node"), F.col("__x").alias("x"), F.lit(True).alias("into")), F.struct(F.col(node).alias("node"), F.lit(0).cast(toured.select(v).schema[0].dataType).alias("x"), F.lit(False).alias("into")))
    sums = running_sum(steps.select("tree", "at", "value.*"), ["tree", "at"], "x", "__s")
    upto = F.sum(F.when(F.col("into"), F.col("x") - F.col("__s")).otherwise(F.col("__s")))
    return sums.groupBy(F.col("node").alias(node)).agg(upto.alias(name))


def path_sums(toured: DataFrame, node: str, value: Column, name: str = "total") -> DataFrame:
    """node, total of value on the path from the root to every node."""
    v = F.coalesce(value, F.lit(0))
    steps = events(toured.withColumn("__x", v), F.struct(F.col(node).alias("node"), F.col("__x").alias("x"), F.lit(True).alias("into")), F.struct(F.col(node).alias("node"), (-F.col("__x")).alias("x"), F.lit(False).alias("into")))
    return running_sum(steps.select("tree", "at", "value.*"), ["tree", "at"], "x", name).filter("into").select(F.col("node").alias(node), name)


def leaves_below(toured: DataFrame, node: str, name: str = "n_below") -> DataFrame:
    """node and its number of leaves, at or below."""
    return below_sums(toured, node, (F.col("n_children") == 0).cast("long"), name)


def newick(toured: DataFrame, label: Column, keys: list[str] = ("tree",)) -> DataFrame:
    """keys, newick: each tree as text, all trees in one aggregate."""
    comma = F.when(F.col("first"), F.lit("")).otherwise(F.lit(", "))
    leaf = F.col("n_children") == 0
    entering, leaving = F.concat(comma, F.when(leaf, label).otherwise(F.lit("("))), F.when(leaf, F.lit("")).otherwise(F.concat(F.lit(")"), label))
    steps = toured.select(*keys, F.col("enter").alias("at"), entering.alias("value")).unionByName(toured.select(*keys, F.col("leave").alias("at"), leaving.alias("value")))
    return gathered(steps, keys).select(*keys, F.concat(F.array_join("values", ""), F.lit(";")).alias("newick"))
