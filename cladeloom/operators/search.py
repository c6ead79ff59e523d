"""Placing query sequences: families by significant k-mer counts, then groups
within the families by descent along the best path.

One plan of joins and aggregates over (query, family) and (query, group); the
per-query loops of a scalar engine do not exist here. Queries are keyed by
their running number, since identifiers need not be unique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions.sequences import K, distinct_kmers, kmer_code, reported_length, with_x
from .index import heaviest_chains
from .shared import settle

THRESHOLD = 0.1
TOP_N = 1


def query_kmers(queries: DataFrame, k: int = K) -> DataFrame:
    """ord, kmer, pos: distinct k-mers without X and their first places."""
    return distinct_kmers(queries, "seq", k, ["ord"]).filter(~with_x(F.col("kmer")))


def query_sizes(queries: DataFrame, k: int = K) -> DataFrame:
    """ord, n: distinct k-mers; all those with X count as one together."""
    found = distinct_kmers(queries, "seq", k, ["ord"])
    return found.groupBy("ord").agg(
        (F.count_if(~with_x(F.col("kmer"))) + F.max(with_x(F.col("kmer")).cast("int"))).cast("long").alias("n"),
    )


#: Distinct query k-mers up to which a search reads only row groups near them, and the number of ranges of codes.
FEW_CODES = 4096
RANGES = 64


def near(postings: DataFrame, codes: DataFrame) -> DataFrame:
    """The postings in at most RANGES ranges that hold all codes, parted at
    their widest gaps, where the codes are few (a micro-batch): the scan then
    skips the row groups between. Only the scan changes; no hit is lost."""
    few = sorted(r.code for r in codes.select("code").distinct().limit(FEW_CODES + 1).collect())
    if not few or len(few) > FEW_CODES:
        return postings
    widest = sorted(sorted(range(1, len(few)), key=lambda i: few[i - 1] - few[i])[: RANGES - 1])
    ends = zip([0, *widest], [*widest, len(few)])
    within = [F.col("code").between(few[a], few[b - 1]) for a, b in ends]
    while len(within) > 1:
        within = [x | y for x, y in zip(within[::2], within[1::2])] + within[len(within) // 2 * 2 :]
    return postings.filter(within[0])


def hits(queries: DataFrame, postings: DataFrame, k: int = K, reduced: bool = False) -> DataFrame:
    """ord, code, pos, fam_id, hog_id. The query k-mers go to the postings:
    these are stored in buckets of their code and are neither shuffled nor
    sorted, while the queries' side is hashed."""
    asked = query_kmers(queries, k).select("ord", kmer_code(F.col("kmer"), k, reduced).alias("code"), "pos")
    asked = settle(asked, "asked")
    return asked.hint("shuffle_hash").join(near(postings, asked), "code")


def family_counts(found: DataFrame) -> DataFrame:
    """ord, fam_id, count, low, high."""
    return found.groupBy("ord", "fam_id").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("low"), F.max("pos").alias("high"))


def group_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("ord", "fam_id", "hog_id").agg(F.count(F.lit(1)).alias("n"))


def significant(counts: DataFrame, sizes: DataFrame, families: DataFrame, k: int = K, alpha: float = st.ALPHA, lengths: DataFrame | None = None) -> DataFrame:
    """The families that pass, cheapest test first: expected count, coverage,
    divergence bound, corrected p-value. families(fam_id, fam_prob), lengths(ord, len)."""
    total = families.agg(F.count(F.lit(1)).alias("n_families"))
    rows = counts.join(sizes, "ord").join(families.select("fam_id", "fam_prob"), "fam_id").join(lengths, "ord").join(F.broadcast(total))
    c, n, p = F.col("count"), F.col("n"), F.col("fam_prob")
    rows = rows.filter(c >= st.expected(p, n)).filter(st.covers(F.col("low"), F.col("high"), k)).filter(st.passes_divergence(c, n, p, alpha))
    rows = rows.withColumn("pvalue", st.corrected(st.neg_log_tail(c, n, p), F.col("n_families"))).filter(st.passes_alpha(F.col("pvalue"), alpha))
    return rows.select(
        "ord", "fam_id", "count", "n", "pvalue", st.normalised_count(c, n, p).alias("normcount"),
        st.overlap(F.col("low"), F.col("high"), k, F.col("len")).alias("overlap"),
    )


def top_families(rows: DataFrame, top_n: int = TOP_N, keys: list[str] = ("ord",)) -> DataFrame:
    """rows with rank, best first by normcount, overlap, pvalue; ties of all
    three go to the smaller family number."""
    order = Window.partitionBy(*keys).orderBy(F.desc("normcount"), F.desc("overlap"), F.desc("pvalue"), F.asc("fam_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_n)


def scored_groups(chosen: DataFrame, counts: DataFrame, groups: DataFrame) -> DataFrame:
    """ord, fam_id, hog_id, parent, depth, cum, score for all groups at or
    above a hit. chosen(ord, fam_id, n), counts(ord, fam_id, hog_id, n),
    groups(hog_id, fam_id, parent, depth, path, hog_prob)."""
    kept = counts.join(chosen.select("ord", "fam_id"), ["ord", "fam_id"], "left_semi")
    chains = heaviest_chains(kept.select("ord", "hog_id", "n"), groups, ["ord"])
    sizes = chosen.select("ord", "fam_id", "n")
    rows = chains.join(groups.select("hog_id", "fam_id", "parent", "depth", "hog_prob"), "hog_id").join(sizes, ["ord", "fam_id"])
    left = F.col("n") - F.col("before")
    return rows.select("ord", "fam_id", "hog_id", "parent", "depth", "cum", st.group_score(F.col("cum"), F.col("hog_prob"), left).alias("score"))


def best_path(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """The scored groups on the best path: the root, and below it each group
    that alone has the highest score above zero among its siblings, as long as
    all groups over it have that too."""
    family = Window.partitionBy("ord", "parent")
    scored = settle(scored, "scored")
    marked = scored.withColumn("top", F.max("score").over(family)).withColumn("is_top", (F.col("score") == F.col("top")).cast("int"))
    marked = marked.withColumn("n_top", F.sum("is_top").over(family))
    winner = (F.col("parent").isNotNull() & (F.col("score") > 0) & (F.col("is_top") == 1) & (F.col("n_top") == 1)).alias("winner")
    marked = marked.select("ord", "fam_id", "hog_id", "parent", "depth", "cum", "score", winner)
    steps = marked.join(groups.select("hog_id", "path"), "hog_id").select("ord", "hog_id", F.explode("path").alias("at"))
    won = marked.filter("winner").select("ord", F.col("hog_id").alias("at"))
    lengths = steps.join(won, ["ord", "at"]).groupBy("ord", "hog_id").agg(F.count(F.lit(1)).alias("wins"))
    return marked.join(lengths, ["ord", "hog_id"], "left").filter(F.coalesce("wins", F.lit(0)) == F.col("depth") - 1).drop("winner", "wins")


def place(path: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """ord, fam_id, hog_id, score, cum: the deepest group on the path that
    reaches the threshold; else the root, with neither score nor count."""
    pick = F.max_by(F.struct("hog_id", "score", "cum"), F.when(F.col("score") >= threshold, F.col("depth")))
    root = F.min_by("hog_id", "depth")
    return path.groupBy("ord", "fam_id").agg(pick.alias("pick"), root.alias("root")).select(
        "ord", "fam_id", F.coalesce("pick.hog_id", "root").alias("hog_id"), F.col("pick.score").alias("score"),
        F.when(F.col("pick.score") != 0, F.col("pick.cum")).alias("cum"),
    )


def gene_sets(members: DataFrame, groups: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """hog_id, subfamily_geneset: all member identifiers at or below each chosen
    group (column hog_id; all groups without it), by comma. Only groups below a
    chosen one meet the members, so the names are as many as the output's."""
    pairs = groups.select(F.explode("path").alias("at"), "hog_id")
    if chosen is not None:
        pairs = pairs.join(chosen.select(F.col("hog_id").alias("at")).distinct(), "at", "left_semi")
    below = members.join(pairs, "hog_id")
    return below.groupBy(F.col("at").alias("hog_id")).agg(F.array_join(F.array_sort(F.collect_list("ext_id")), ",").alias("subfamily_geneset"))


def search(
    queries: DataFrame, postings: DataFrame, groups: DataFrame, families: DataFrame, k: int = K, threshold: float = THRESHOLD, alpha: float = st.ALPHA,
    top_n: int = TOP_N, family_only: bool = False, members: DataFrame | None = None, closest: DataFrame | None = None, compatible: bool = True, reduced: bool = False,
) -> DataFrame:
    """The result table. queries(ord, qseqid, seq), sanitised; those shorter
    than k are left out. groups(hog_id, ext_id, fam_id, parent, depth, path,
    level, median_seqlen, hog_prob), families(fam_id, fam_prob).

    Every query has a row; further ones for further families. Values that are
    zero are null. With members(hog_id, ext_id) the genes of the chosen group
    are listed, with closest(hog_id, closest_taxon) its closest taxon."""
    asked = queries.filter(F.length("seq") >= k)
    found = settle(hits(asked, postings, k, reduced), "hits")  # the index is probed once; what follows reads the hits
    lengths = asked.select("ord", F.length("seq").alias("len"))
    chosen = settle(top_families(significant(family_counts(found), query_sizes(asked, k), families, k, alpha, lengths), top_n), "chosen")
    if family_only:
        roots = groups.filter("parent is null").select("fam_id", "hog_id")
        placed = chosen.select("ord", "fam_id").join(roots, "fam_id").select("ord", "fam_id", "hog_id", F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("cum"))
    else:
        placed = place(best_path(scored_groups(chosen, group_counts(found), groups), groups), threshold)
    rows = chosen.drop("n").join(placed, ["ord", "fam_id"]).join(
        groups.select("hog_id", F.col("ext_id").alias("hogid"), F.col("level").alias("hoglevel"), F.col("median_seqlen").alias("subfamily_medianseqlen")), "hog_id"
    )
    more = []
    if members is not None:
        rows = settle(rows, "placed")
        rows = rows.join(gene_sets(members, groups, rows), "hog_id", "left")
        more.append("subfamily_geneset")
    if closest is not None:
        rows = rows.join(closest, "hog_id", "left")
        more.append("closest_taxa")
        rows = rows.withColumnRenamed("closest_taxon", "closest_taxa")
    zero = lambda c, to: F.nullif(F.col(c), F.lit(0).cast(to)).alias
    out = asked.select("ord", "qseqid", reported_length(F.col("seq"), compatible).alias("qseqlen")).join(rows, "ord", "left")
    return out.select(
        "ord", "rank", "qseqid", "hogid", "hoglevel", zero("pvalue", "double")("family_p"), zero("count", "long")("family_count"),
        zero("normcount", "double")("family_normcount"), zero("score", "double")("subfamily_score"), zero("cum", "long")("subfamily_count"),
        "qseqlen", "subfamily_medianseqlen", zero("overlap", "double")("qseq_overlap"), *more,
    )
