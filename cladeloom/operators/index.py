"""Inverted k-mer index: one posting for each k-mer and family, at the lowest
common ancestor of the family's groups that hold the k-mer; and the match
probabilities of families and groups that follow from it.

Groups are numbered in pre-order (column pre), so the lowest common ancestor
of any set is that of its least and its greatest number. Building an index is
then an aggregate of two integers for each (k-mer, family), combined block by
block in the tasks (kmers.py) and again before the shuffle; paths are looked up
afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import K
from . import climbs
from .hierarchy import common_path
from .kmers import spans
from .shared import bucket_count, read_buckets, settle, shared_dir, write_buckets


def build(sequences: DataFrame, groups: DataFrame, k: int = K, hidden: DataFrame | None = None, reduced: bool = False) -> DataFrame:
    """(code, fam_id, hog_id), code being the k-mer as a number. sequences(hog_id, species, seq), groups(hog_id,
    fam_id, pre, path). Sequences of hidden species (column species) are not
    indexed. K-mers with X are indexed like others."""
    rows = sequences if hidden is None else sequences.join(hidden.select("species"), "species", "left_anti")
    placed = rows.join(groups.select("hog_id", "fam_id", "pre"), "hog_id").select("fam_id", "pre", "seq")
    return lowest(settle(spans(placed, k, reduced), "spans"), groups)


def lowest(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(code, fam_id, low, high) -> (code, fam_id, hog_id). Common ancestors are
    found once for each pair of groups that occurs; spans are joined once."""
    ends = groups.select("pre", "path")
    met = found.select("low", "high").distinct().join(ends.withColumnsRenamed({"pre": "low", "path": "a"}), "low").join(ends.withColumnsRenamed({"pre": "high", "path": "b"}), "high")
    met = settle(met.select("low", "high", F.element_at(common_path(F.col("a"), F.col("b")), -1).alias("hog_id")), "met")
    return found.join(met, ["low", "high"]).select("code", "fam_id", "hog_id")


#: Columns of stored postings, bucketed by code.
POSTINGS = "code long, fam_id int, hog_id long"


def store(postings: DataFrame, path: str | None = None) -> tuple[str, int]:
    """Write postings in buckets of their code; the path and their number. They
    are read twice, counted first."""
    spark = postings.sparkSession
    path = path or f"{shared_dir(spark)}/cladeloom/postings-{uuid.uuid4().hex[:12]}"
    made = postings.select("code", F.col("fam_id").cast("int").alias("fam_id"), F.col("hog_id").cast("long").alias("hog_id"))
    buckets = bucket_count(made)
    write_buckets(made, "code", buckets, path)
    return path, buckets


def stored(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    return read_buckets(spark, "code", buckets, path, POSTINGS)


def own_counts(postings: DataFrame) -> DataFrame:
    """hog_id, n: k-mers whose posting is at the group."""
    return postings.groupBy("hog_id").agg(F.count(F.lit(1)).alias("n"))


def family_probability(postings: DataFrame) -> DataFrame:
    """fam_id, fam_prob: the postings of the family's k-mers over all postings."""
    spread = postings.groupBy("code").agg(F.count(F.lit(1)).alias("df"))
    occurrences = postings.select("code", "fam_id").join(spread, "code").groupBy("fam_id").agg(F.sum("df").alias("occ"))
    total = postings.agg(F.count(F.lit(1)).alias("total"))
    return occurrences.join(F.broadcast(total)).select("fam_id", (F.col("occ") / F.col("total")).alias("fam_prob"))


def heaviest_chains(counts: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, hog_id, before, cum: for every group at or above one with a count
    the counts on the path to it (itself excluded) and the most that any chain
    from it downwards gathers, itself included.

    counts(keys, hog_id, n). No recursion: with P(d) the sum of counts on the
    path to d, cum(h) = max P(d) over counted d at or below h, less P(parent).
    Nodes, sums and maxima are found by doubling, with rows in proportion to
    the groups that are returned, however deep they lie."""
    counts = settle(counts, "counts")
    paths = groups.select("hog_id", "path")
    far = climbs.steps(paths)
    nodes = climbs.climb(counts, paths, far, keys, []).join(counts.select(*keys, "hog_id", "n"), [*keys, "hog_id"], "left")
    upto = settle(climbs.gather(nodes.withColumn("upto", F.coalesce("n", F.lit(0))), paths, far, keys, "upto"), "sums")
    best = climbs.climb(upto.filter("n is not null").select(*keys, "hog_id", F.col("upto").alias("top")), paths, far, keys, [F.max("top").alias("top")])
    before = F.col("upto") - F.coalesce("n", F.lit(0))
    return upto.join(best, [*keys, "hog_id"]).select(*keys, "hog_id", before.alias("before"), (F.col("top") - before).alias("cum"))


def group_probability(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """hog_id, hog_prob for every group (0 where nothing is posted at or below)."""
    counts = own_counts(postings).withColumn("one", F.lit(1))
    chains = heaviest_chains(counts, groups, ["one"]).select("hog_id", "cum")
    total = postings.agg(F.count(F.lit(1)).alias("total"))
    return groups.select("hog_id").join(chains, "hog_id", "left").join(F.broadcast(total)).select(
        "hog_id", (F.coalesce("cum", F.lit(0)) / F.col("total")).alias("hog_prob")
    )
