"""From group levels, entries and a taxonomy to the tables that are searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers as ids
from .climbs import climb, steps
from .hierarchy import all_leaves, with_paths
from .shared import number_rows, running_last, settle

MIN_SIZE = 6
MIN_COMPLETENESS = 0.5


def quality(size: Column, completeness: Column, min_size: int = MIN_SIZE, min_completeness: float = MIN_COMPLETENESS, logic: str = "OR") -> Column:
    if logic not in ("OR", "AND"):
        raise ValueError(f"logic is OR or AND, not {logic}")
    a, b = size >= min_size, completeness >= min_completeness
    return (a | b) if logic == "OR" else (a & b)


def oldest_levels(levels: DataFrame, taxa: DataFrame) -> DataFrame:
    """One row for each group that has a level within the taxonomy: that of
    the oldest taxon, the first such row on ties.
    levels(fam, id, level, completeness, n_genes, ord), taxa(name, level)."""
    scope = taxa.select(F.col("name").alias("tax"), F.col("level").alias("age"))
    rows = levels.withColumnRenamed("level", "tax").join(scope, "tax")
    first = rows.groupBy("fam", "id").agg(F.min(F.struct("age", "ord", "tax", "completeness", "n_genes")).alias("b"))
    return first.select("fam", "id", F.col("b.tax").alias("tax"), F.col("b.completeness").alias("completeness"), F.col("b.n_genes").alias("n_genes"))


def root_of(groups: DataFrame, eligible: Column | None = None) -> DataFrame:
    """groups with root: the shortest prefix of their identifier that is an
    eligible group of the same family. An ordered scan that remembers the
    current root comes to the same, since prefixes sort before what they head."""
    tops = (groups if eligible is None else groups.filter(eligible)).select("fam", F.col("id").alias("root"))
    steps = groups.select("fam", "id", F.posexplode(ids.prefixes(F.col("id"))).alias("n", "root"))
    found = steps.join(tops, ["fam", "root"]).groupBy("fam", "id").agg(F.min_by("root", "n").alias("root"))
    return groups.join(found, ["fam", "id"])


def select_groups(
    levels: DataFrame, taxa: DataFrame, min_size: int = MIN_SIZE, min_completeness: float = MIN_COMPLETENESS, logic: str = "OR",
    root_taxon: str | None = None, include_younger: bool = True,
) -> DataFrame:
    """(fam_id, label, source_id, tax, n_genes, completeness) of the groups
    whose root group passes; families are numbered from 1 in the order of the
    source and of the root's identifier. Sub-groups share their root's fate."""
    inside = settle(oldest_levels(levels, taxa), "levels")
    rooted = root_of(inside, None if include_younger else F.col("tax") == root_taxon)
    good = rooted.filter((F.col("id") == F.col("root")) & quality(F.col("n_genes"), F.col("completeness"), min_size, min_completeness, logic))
    first = levels.groupBy("fam").agg(F.min("ord").alias("fam_ord"))
    numbered = number_rows(good.select("fam", "root").join(first, "fam"), ["fam_ord", "root"], "fam_id", 1).select("fam", "root", "fam_id")
    return rooted.join(numbered, ["fam", "root"]).select(
        F.col("fam_id").cast("int"), ids.relabel(F.col("fam_id"), F.col("id"), F.col("root")).alias("label"), F.col("id").alias("source_id"), "tax", "n_genes", "completeness"
    )


def number_groups(selected: DataFrame) -> DataFrame:
    """selected with hog_id (by family, depth, label, from 1), parent, path,
    depth and pre (rank of the path). A group without its parent is an error."""
    rows = selected.withColumn("d", ids.depth(F.col("label")))
    numbered = number_rows(rows, ["fam_id", "d", "label"], "hog_id", 1).drop("d")
    above = numbered.select(F.col("label").alias("above"), F.col("hog_id").alias("parent"))
    joined = numbered.withColumn("above", ids.parent(F.col("label"))).join(above, "above", "left")
    joined = settle(joined, "groups")
    if not joined.filter("above is not null and parent is null").isEmpty():
        raise ValueError("a group's parent is not among the selected groups")
    placed = with_paths(joined.drop("above"), "hog_id", "parent")
    return number_rows(placed, ["path"], "pre", 1)


def place_members(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """entries(prot_id, species, group) of selected groups, with hog_id."""
    return entries.join(groups.select(F.col("source_id").alias("group"), "hog_id"), "group").drop("group")


def repeated_ids(entries: DataFrame, id_col: str = "prot_id") -> DataFrame:
    return entries.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_entries(entries: DataFrame) -> None:
    bad = repeated_ids(entries).select("prot_id").take(5)
    if bad:
        raise RuntimeError(f"identifiers stand more than once: {[r.prot_id for r in bad]}")


def match_sequences(members: DataFrame, records: DataFrame) -> DataFrame:
    """members with seq, found by the whole header first, then by its first word.
    records(header, id, seq)."""
    whole = records.groupBy("header").agg(F.first("seq").alias("by_header"))
    word = records.groupBy("id").agg(F.first("seq").alias("by_id"))
    got = members.join(whole, members.prot_id == whole.header, "left").join(word, members.prot_id == word.id, "left")
    return got.select(*members.columns, F.coalesce("by_header", "by_id").alias("seq"))


def check_sequences(members: DataFrame) -> None:
    n = members.filter("seq is null").count()
    if n:
        raise ValueError(f"{n} proteins have no sequence")


def median_lengths(members: DataFrame, groups: DataFrame) -> DataFrame:
    """hog_id, median_seqlen of all proteins at or below; halves are cut off.
    Groups above get the groups' length histograms, summed by doubling: rows
    are pairs of a group and a length, not of a protein and an ancestor."""
    forest = groups.select("hog_id", "path")
    own = members.groupBy("hog_id", "seq_len").agg(F.count(F.lit(1)).alias("n"))
    below = climb(own, forest, steps(forest), ["seq_len"], [F.sum("n").alias("n")])
    return below.groupBy("hog_id").agg(F.percentile("seq_len", 0.5, F.col("n")).cast("int").alias("median_seqlen"))


def group_sizes(group_genes: DataFrame, species_below: DataFrame) -> DataFrame:
    """fam, id, level, ord, n_genes, completeness: genes in the group, and its
    species over the species below its taxon; groups of other taxa are left out.
    group_genes(fam, id, level, ord, gene, species), species_below(name, n_below)."""
    sizes = group_genes.groupBy("fam", "id", "level", "ord").agg(F.count("gene").alias("n_genes"), F.count_distinct("species").alias("n_species"))
    return sizes.join(species_below, sizes.level == species_below.name).select(
        "fam", "id", "level", "ord", "n_genes", (F.col("n_species") / F.col("n_below")).alias("completeness")
    )


def gene_levels(genes: DataFrame) -> DataFrame:
    """For every gene a level row of its own: its species, size and completeness 1."""
    return genes.select("fam", "id", F.col("species").alias("level"), "ord", F.lit(1).cast("long").alias("n_genes"), F.lit(1.0).alias("completeness"))


def species_of_genes(genes: DataFrame, species: DataFrame) -> DataFrame:
    """genes(gene, ..) with the species whose range of numbers holds them.
    species(species, min_id, max_id); ranges that overlap are an error.

    Ranges' starts and genes are sorted together once, and each gene takes the
    last start before it, carried over from partition to partition: the widths
    of the ranges and repeated numbers of genes make no difference."""
    start = F.struct("min_id", "max_id", "species")
    starts = species.select(F.col("min_id").cast("long").alias("__key"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__n"), start.alias("__start"), F.lit(None).cast(genes.select(F.struct(*genes.columns)).schema[0].dataType).alias("__gene"))
    width = starts.schema["__start"].dataType
    asked = genes.select(F.col("gene").cast("long").alias("__key"), F.lit(1).alias("__kind"), F.monotonically_increasing_id().alias("__n"), F.lit(None).cast(width).alias("__start"), F.struct(*genes.columns).alias("__gene"))
    inside = starts.filter("__start.min_id <= __start.max_id")
    ends = inside.withColumn("__kind", F.lit(2)).withColumn("__key", F.col("__start.max_id").cast("long"))
    numbered = number_rows(inside.unionByName(ends).select("__key", "__kind", F.col("__start.species").alias("__s")), ["__key", "__kind", "__s"], "__i")
    if not numbered.filter(((F.col("__i") % 2 == 0) & (F.col("__kind") != 0)) | ((F.col("__i") % 2 == 1) & (F.col("__kind") != 2))).isEmpty():
        raise ValueError("ranges of gene numbers overlap")
    found = running_last(inside.unionByName(asked), ["__key", "__kind", "__n"], "__start", "__last")
    return found.filter((F.col("__kind") == 1) & (F.col("__key") <= F.col("__last.max_id"))).select("__gene.*", F.col("__last.species").alias("species"))


def hidden_species(taxa: DataFrame, names: list[str]) -> DataFrame:
    """species at or below the named taxa. taxa(name, parent, path of names).
    A name must stand exactly once."""
    known = {r.name: r.n for r in taxa.filter(F.col("name").isin(names)).groupBy("name").agg(F.count(F.lit(1)).alias("n")).collect()}
    for n in names:
        if known.get(n, 0) != 1:
            raise ValueError(f"{'ambiguous' if n in known else 'unknown'} taxon {n}")
    below = F.exists("path", lambda x: x.isin(names)) if names else F.lit(False)
    return all_leaves(taxa, "name", "parent").filter(below).select(F.col("name").alias("species"))


def visible_species(taxa: DataFrame, hidden: DataFrame) -> int:
    return all_leaves(taxa, "name", "parent").join(hidden, F.col("name") == F.col("species"), "left_anti").count()


def prune(nodes: DataFrame, root: str | None) -> DataFrame:
    """The subtree under `root` (all, without one), levels counted from the
    tree's own root. nodes(name, parent, distance, path)."""
    return nodes if root is None else nodes.filter(F.array_contains("path", F.lit(root))).withColumn(
        "parent", F.when(F.col("name") != root, F.col("parent"))
    ).withColumn("path", F.slice("path", F.array_position("path", F.lit(root)).cast("int"), F.size("path")))


def taxon_numbers(taxa: DataFrame, known: DataFrame) -> DataFrame:
    """taxa(name) with ncbi_id from known(name, ncbi_id); those without one
    get -100, -101, .. in the order of their names."""
    joined = taxa.join(known, "name", "left")
    missing = number_rows(joined.filter("ncbi_id is null").select("name"), ["name"], "n").select("name", (-100 - F.col("n")).alias("given"))
    return joined.join(missing, "name", "left").withColumn("ncbi_id", F.coalesce("ncbi_id", "given").cast("int")).drop("given")


def resolve_references(genes: DataFrame, named: DataFrame, extra: DataFrame) -> DataFrame:
    """genes(gene, ref) with xref: the extra identifier where one is mapped,
    else the one that the source names, else the gene's own reference."""
    more = extra.groupBy("ref").agg(F.min("xref").alias("more"))
    own = named.groupBy("gene").agg(F.min("name").alias("own"))
    return genes.join(more, "ref", "left").join(own, "gene", "left").withColumn("xref", F.coalesce("more", "own", "ref")).drop("more", "own")


def level_sizes(groups: DataFrame) -> DataFrame:
    """fam_id, depth, n: how many groups each family has at each depth."""
    return groups.groupBy("fam_id", "depth").agg(F.count(F.lit(1)).alias("n"))


def level_table(levels: DataFrame) -> DataFrame:
    """(row, fam, id, level): the group levels in order, numbered from 0."""
    return number_rows(levels.select("fam", "id", "level"), ["fam", "id", "level"], "row").select("row", "fam", "id", "level")


def write_levels(levels: DataFrame, path: str) -> None:
    """The level table on disk, sorted by family and identifier, so a family
    or a group is found by the row groups' statistics."""
    level_table(levels).repartitionByRange("fam", "id").sortWithinPartitions("fam", "id", "level").write.parquet(path)


def level_map(table: DataFrame, fam: int) -> DataFrame:
    """(id, level, row) of one family."""
    return table.filter(F.col("fam") == fam).select("id", "level", "row")
