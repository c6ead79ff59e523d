"""Forests as tables of (node, parent): paths, relatives, common ancestors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settle


def with_paths(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    """nodes with path (root .. node) and depth (root: 1).

    Pointer doubling: each round joins every partial path to that of its top's
    parent, so the rounds grow with the logarithm of the depth. A parent that
    is not a node, or a cycle, is an error."""
    base = nodes.select(F.col(node).alias("__n"), F.col(parent).alias("__top"), F.array(node).alias("path"))
    total = nodes.count()
    while True:
        now = settle(base, "paths")
        if (now.agg(F.max(F.size("path"))).first()[0] or 0) > total:  # no path is longer than the table
            raise ValueError("the parents form a cycle")
        if now.filter("__top is not null").isEmpty():
            return nodes.join(now.select("__n", "path"), nodes[node] == now["__n"]).drop("__n").withColumn("depth", F.size("path"))
        above = now.select(F.col("__n").alias("__a"), F.col("__top").alias("__next"), F.col("path").alias("__up"))
        if not now.filter("__top is not null").join(above, F.col("__top") == F.col("__a"), "left_anti").isEmpty():
            raise ValueError("a parent is not among the nodes")
        base = now.join(above, F.col("__top") == F.col("__a"), "left").select(
            "__n", F.col("__next").alias("__top"), F.when(F.col("__a").isNull(), F.col("path")).otherwise(F.concat("__up", "path")).alias("path")
        )


def closure(nodes: DataFrame, node: str = "id") -> DataFrame:
    """(ancestor, node) for every node with a path, itself included."""
    return nodes.select(F.explode("path").alias("ancestor"), F.col(node).alias("node"))


def children(nodes: DataFrame, of: Column, parent: str = "parent") -> DataFrame:
    return nodes.filter(F.col(parent) == of)


def descendants(nodes: DataFrame, of: Column, node: str = "id") -> DataFrame:
    """The nodes below `of`, in order of their paths (pre-order)."""
    return nodes.filter(F.array_contains("path", of) & (F.col(node) != of)).orderBy("path")


def all_leaves(nodes: DataFrame, node: str = "id", parent: str = "parent") -> DataFrame:
    inner = nodes.select(F.col(parent).alias("__p")).filter("__p is not null").distinct()
    return nodes.join(inner, F.col(node) == F.col("__p"), "left_anti")


def leaves(nodes: DataFrame, of: Column, node: str = "id", parent: str = "parent") -> DataFrame:
    """The leaves at or below `of`."""
    return all_leaves(nodes, node, parent).filter(F.array_contains("path", of))


def is_ancestor(path: Column, ancestor: Column) -> Column:
    """Reflexive: whether `ancestor` stands on the path."""
    return F.array_contains(path, ancestor)


def common_path(a: Column, b: Column) -> Column:
    """The longest common beginning of two paths."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, x: F.struct(
        F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["on"] & x).alias("on")), lambda s: s["n"])
    return F.slice(a, F.lit(1), n)


def lowest_common(a: Column, b: Column) -> Column:
    """The lowest common ancestor of the ends of two paths; null if none."""
    common = common_path(a, b)
    return F.when(F.size(common) > 0, F.element_at(common, -1))


def lowest_common_of(rows: DataFrame, keys: list[str], path: str = "path", name: str = "lca") -> DataFrame:
    """The lowest common ancestor of each group's paths: that of the least and
    the greatest path, so groups are combined before they are shuffled."""
    return rows.groupBy(*keys).agg(F.min(path).alias("__a"), F.max(path).alias("__b")).select(*keys, lowest_common(F.col("__a"), F.col("__b")).alias(name))


def direct_members(members: DataFrame, of: Column, group: str = "hog_id") -> DataFrame:
    return members.filter(F.col(group) == of)


def subtree_members(members: DataFrame, groups: DataFrame, group: str = "hog_id") -> DataFrame:
    """members once for each group at or above their own, as column ancestor."""
    return members.join(closure(groups, group), members[group] == F.col("node")).drop("node")


def leaf_counts(nodes: DataFrame, node: str = "id", parent: str = "parent", name: str = "n_below") -> DataFrame:
    """Number of leaves at or below every node."""
    own = all_leaves(nodes, node, parent).select(F.explode("path").alias("__at"))
    return own.groupBy(F.col("__at").alias(node)).agg(F.count(F.lit(1)).alias(name))


def group_taxa(groups: DataFrame, members: DataFrame, taxa: DataFrame) -> DataFrame:
    """(hog_id, tax): the taxa that a group spans - lineages of its direct
    members' species and the strict lineages of its children's taxa, less what
    is older than its own taxon.

    groups(hog_id, parent, tax), members(hog_id, tax), taxa(tax, path)."""
    line = taxa.select("tax", F.col("path").alias("__line"))
    own = members.select("hog_id", "tax").distinct().join(line, "tax").select("hog_id", F.explode("__line").alias("tax"))
    below = groups.filter("parent is not null").select(F.col("parent").alias("hog_id"), "tax").distinct().join(line, "tax")
    below = below.filter(F.size("__line") > 1).select("hog_id", F.explode(F.slice("__line", F.lit(1), F.size("__line") - 1)).alias("tax"))
    older = groups.select("hog_id", "tax").join(line, "tax").filter(F.size("__line") > 1).select(
        "hog_id", F.explode(F.slice("__line", F.lit(1), F.size("__line") - 1)).alias("tax"))
    return own.unionByName(below).distinct().join(older, ["hog_id", "tax"], "left_anti")


def taxon_implied(groups: DataFrame, lineage: Column) -> DataFrame:
    """hog_id, implied: the group's taxon is on the lineage and no child's is.
    groups(hog_id, parent, tax)."""
    below = groups.filter("parent is not null").groupBy(F.col("parent").alias("hog_id")).agg(F.collect_set("tax").alias("__below"))
    return groups.join(below, "hog_id", "left").select(
        "hog_id", "tax", (F.array_contains(lineage, F.col("tax")) & ~F.coalesce(F.arrays_overlap("__below", lineage), F.lit(False))).alias("implied"), "__below"
    )


def closest_taxon(groups: DataFrame, lineage: Column) -> DataFrame:
    """hog_id, closest_taxon to the reference taxon that ends `lineage` (root
    first): the reference where implied; where the group's taxon is a strict
    ancestor of it, the parent of the lineage's lowest child-group taxon; else
    the group's own taxon."""
    above = F.slice(lineage, F.lit(1), F.size(lineage) - 1)
    met = F.filter(F.sequence(F.lit(1), F.size(lineage)), lambda i: F.array_contains("__below", F.element_at(lineage, i)))
    return taxon_implied(groups, lineage).select(
        "hog_id",
        F.when(F.col("implied"), F.element_at(lineage, -1))
        .when(F.array_contains(above, F.col("tax")) & (F.size(met) > 0) & (F.array_max(met) > 1), F.get(lineage, F.array_max(met) - 2))
        .otherwise(F.col("tax")).alias("closest_taxon"),
    )
