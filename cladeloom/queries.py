"""The engine's operators on the driver's tables, each with its SQL twin.

Binding: documents are the reference proteins, benchmark items the queries.
A family is a source, its groups are source, source.lang and
source.lang.b(doc_id mod 3); the language is the species. Trees without
sequences are region, nation, customer. Stripped sequences hold the twenty
residues only; raw ones have X for everything else.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property, lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import identifiers as ids
from .functions import sequences as sq
from .functions import statistics as st
from .operators import build, hierarchy, index, tours
from .operators import search as srch
from .operators.shared import settle, shared_dir, spread
from .plans import engine
from .sources import browser, fasta, newick, orthoxml, results
from .sources.files import checksums

K = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- binding


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cladeloom/{name}-{uuid.uuid4().hex[:12]}"


def placed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, lang and the labels f, g, h of the three groups."""
    d = table(spark, sf_dir, "documents")
    f, lang = F.coalesce("source", F.lit("?")), F.coalesce("lang", F.lit("?"))
    h = F.concat_ws(".", f, lang, F.concat(F.lit("b"), (F.col("doc_id") % 3).cast("string")))
    return d.select("doc_id", "text", lang.alias("lang"), f.alias("f"), F.concat_ws(".", f, lang).alias("g"), h.alias("h"))


def bound_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hog_id (the pre-order rank), ext_id, fam_id, parent, depth, path, pre,
    level. A dimension: sources x languages x 3 rows, however many documents."""
    lowest = placed_documents(spark, sf_dir).select("f", "g", "h").distinct()
    rows = lowest.select(F.explode(F.array("f", "g", "h")).alias("ext_id")).distinct()
    numbered = rows.withColumn("hog_id", F.row_number().over(Window.orderBy(ids.parts(F.col("ext_id")))).cast("long"))
    names = numbered.select(F.col("ext_id").alias("above"), F.col("hog_id").alias("up"))
    steps = numbered.select("ext_id", "hog_id", F.posexplode(ids.prefixes(F.col("ext_id"))).alias("n", "above")).join(names, "above")
    paths = steps.groupBy("ext_id", "hog_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "up"))), lambda x: x["up"]).alias("path"))
    return paths.select(
        "hog_id", "ext_id", F.col("path")[0].cast("int").alias("fam_id"), F.when(F.size("path") > 1, F.element_at("path", -2)).alias("parent"), F.size("path").alias("depth"),
        "path", F.col("hog_id").alias("pre"), F.concat(F.lit("level"), F.size("path").cast("string")).alias("level"),
    )


def sequences(spark: SparkSession, sf_dir: str, groups: DataFrame, raw: bool = False) -> DataFrame:
    """doc_id, species, ext_id, hog_id, seq of the documents."""
    d = spread(placed_documents(spark, sf_dir), "doc_id")
    seq = sq.sanitise(F.coalesce("text", F.lit(""))) if raw else sq.strip_residues(F.coalesce("text", F.lit("")))
    g = groups.select("hog_id", F.col("ext_id").alias("h"))
    return d.select("doc_id", F.col("lang").alias("species"), "h", seq.alias("seq")).join(g, "h").withColumnRenamed("h", "ext_id")


def asked(spark: SparkSession, sf_dir: str, raw: bool = False) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    seq = sq.sanitise(F.coalesce("text", F.lit(""))) if raw else sq.strip_residues(F.coalesce("text", F.lit("")))
    return b.select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("qseqid"), seq.alias("seq")).filter(F.length("seq") >= K)


class Bound:
    """Everything a search needs. Groups and postings are written once, as in
    a stored database, and read by all that follows."""

    def __init__(self, spark: SparkSession, sf_dir: str, raw: bool = False):
        groups = settle(bound_groups(spark, sf_dir), "groups")
        self.seqs = sequences(spark, sf_dir, groups, raw)
        self.postings = index.stored(spark, *index.store(index.build(self.seqs, groups, K)))
        self.family_prob = index.family_probability(self.postings)
        self.names = groups.select("hog_id", "ext_id")
        self.family_names = groups.filter("parent is null").select("fam_id", F.col("ext_id").alias("family"))
        self.plain_groups = groups
        self.queries = asked(spark, sf_dir, raw)
        self.lengths = self.queries.select("ord", F.length("seq").alias("len"))

    @cached_property
    def found(self) -> DataFrame:
        return settle(srch.hits(self.queries, self.postings, K), "hits")

    @cached_property
    def groups(self) -> DataFrame:
        probability = index.group_probability(self.postings, self.plain_groups)
        lengths = self.seqs.select("hog_id", F.length("seq").alias("seq_len"))
        return settle(self.plain_groups.join(probability, "hog_id").join(build.median_lengths(lengths, self.plain_groups), "hog_id", "left"), "groups")

    def significant(self, alpha: float = st.ALPHA) -> DataFrame:
        return srch.significant(srch.family_counts(self.found), srch.query_sizes(self.queries, K), self.family_prob, K, alpha, self.lengths)

    def scored(self, alpha: float = st.ALPHA, top_n: int = 1) -> tuple[DataFrame, DataFrame]:
        groups = self.groups
        chosen = settle(srch.top_families(self.significant(alpha), top_n), "chosen")
        return srch.scored_groups(chosen, srch.group_counts(self.found), groups), groups

    def results(self, **options) -> DataFrame:
        return srch.search(self.queries, self.postings, self.groups, self.family_prob, K, **options)


@lru_cache(maxsize=2)
def _bound(application: str, sf_dir: str, raw: bool) -> Bound:
    return Bound(SparkSession.active(), sf_dir, raw)


def bound(spark: SparkSession, sf_dir: str, raw: bool = False) -> Bound:
    """The stored groups and postings of the tables, made once in a Spark
    application, as one database serves many searches."""
    return _bound(spark.sparkContext.applicationId, sf_dir, raw)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def shown(found: DataFrame) -> DataFrame:
    out = found.select(
        "qseqid", F.coalesce("rank", F.lit(1)).cast("long").alias("rank"), "hogid", "hoglevel", "family_p", "family_count", "family_normcount", "subfamily_score",
        "subfamily_count", F.col("qseqlen").cast("long").alias("qseqlen"), F.col("subfamily_medianseqlen").cast("long").alias("subfamily_medianseqlen"), "qseq_overlap",
    )
    return rounded(out, "family_p", "family_normcount", "subfamily_score", "qseq_overlap")


# ---------------------------------------------------------------- SQL parts

_ASCII = "upper(regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '', 'g'))"
STRIP = f"regexp_replace({_ASCII}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g')"
RAW = f"regexp_replace({_ASCII}, '[^ACDEFGHIKLMNPQRSTVWXY]', 'X', 'g')"


def base(seq: str) -> str:
    return f"""
d AS (SELECT doc_id, {seq} AS seq, coalesce(lang, '?') AS lang, coalesce(source, '?') AS f, coalesce(source, '?') || '.' || coalesce(lang, '?') AS g,
             coalesce(source, '?') || '.' || coalesce(lang, '?') || '.b' || (doc_id % 3) AS h FROM documents),
km AS (SELECT DISTINCT f, g, h, substr(seq, CAST(i AS INT), 6) AS kmer FROM d, unnest(range(1, length(seq) - 4)) AS t(i) WHERE length(seq) >= 6),
post AS (SELECT kmer, f AS fam, CASE WHEN count(DISTINCT h) = 1 THEN min(h) WHEN count(DISTINCT g) = 1 THEN min(g) ELSE f END AS lca FROM km GROUP BY kmer, f),
q AS (SELECT item_id, {seq} AS seq FROM benchmark WHERE length({seq}) >= 6),
qx AS (SELECT item_id, substr(seq, CAST(i AS INT), 6) AS kmer, min(i) - 1 AS pos FROM q, unnest(range(1, length(seq) - 4)) AS t(i) GROUP BY 1, 2),
qk AS (SELECT * FROM qx WHERE NOT contains(kmer, 'X')),
qn AS (SELECT item_id, count(*) FILTER (NOT contains(kmer, 'X')) + max(CASE WHEN contains(kmer, 'X') THEN 1 ELSE 0 END) AS n FROM qx GROUP BY 1),
hit AS (SELECT qk.item_id, qk.kmer, qk.pos, post.fam, post.lca FROM qk JOIN post ON qk.kmer = post.kmer),
fc AS (SELECT item_id, fam, count(*) AS cnt, min(pos) AS lo, max(pos) AS hi FROM hit GROUP BY 1, 2),
tot AS (SELECT count(*) AS total FROM post),
spread AS (SELECT kmer, count(*) AS df FROM post GROUP BY 1),
fp AS (SELECT fam, CAST(sum(df) AS DOUBLE) / max(total) AS p FROM post JOIN spread USING (kmer), tot GROUP BY fam)"""


def significance(alpha: float = 1e-6) -> str:
    return f"""
c1 AS (SELECT fc.item_id, fc.fam, cnt, lo, hi, n, p, length(seq) AS len FROM fc JOIN qn USING (item_id) JOIN fp ON fp.fam = fc.fam JOIN q USING (item_id)
       WHERE cnt >= p * n AND hi - lo + 6 >= 25),
c2 AS (SELECT *, greatest(1e-10, least(1 - 1e-10, cnt / n)) AS s FROM c1),
c3 AS (SELECT * FROM c2 WHERE s * ln(s / p) + (1 - s) * ln((1 - s) / (1 - p)) > -ln({alpha}) / n),
tail AS (SELECT item_id, fam, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p) - first)) AS total, max(first) AS first
         FROM (SELECT *, lgamma(n + 1) - lgamma(cnt + 1) - lgamma(n - cnt + 1) + cnt * ln(p) + (n - cnt) * ln(1 - p) AS first FROM c3), unnest(range(cnt, n + 1)) AS t(j)
         GROUP BY 1, 2),
nf AS (SELECT count(*) AS families FROM fp),
sig AS (SELECT c3.item_id, c3.fam, cnt, n, len, least(20000.0, greatest(0.0, -(first + ln(total)) - ln(families))) AS pvalue,
               (cnt - p * n) / (n - p * n) AS normcount, (hi - lo + 6) / len AS overlap
        FROM c3 JOIN tail ON tail.item_id = c3.item_id AND tail.fam = c3.fam, nf WHERE least(20000.0, greatest(0.0, -(first + ln(total)) - ln(families))) >= -ln({alpha})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY normcount DESC, overlap DESC, pvalue DESC, fam) AS rank FROM sig)"""


PROBABILITY = """
tree AS (SELECT DISTINCT f, g, h FROM d),
own AS (SELECT lca AS id, count(*) AS n FROM post GROUP BY 1),
ph AS (SELECT f, g, h, coalesce(n, 0) AS cum FROM tree LEFT JOIN own ON id = h),
pg AS (SELECT f, g, coalesce(max(n), 0) + max(cum) AS cum FROM ph LEFT JOIN own ON id = g GROUP BY 1, 2),
pf AS (SELECT f, coalesce(max(n), 0) + max(cum) AS cum FROM pg LEFT JOIN own ON id = f GROUP BY 1),
hp AS (SELECT id, cum / total AS p FROM (SELECT h AS id, cum FROM ph UNION ALL SELECT g, cum FROM pg UNION ALL SELECT f, cum FROM pf), tot)"""


def placement(top_n: int = 1) -> str:
    return f"""
chosen AS (SELECT * FROM ranked WHERE rank <= {top_n}),
qo AS (SELECT item_id, lca AS id, count(*) AS n FROM hit GROUP BY 1, 2),
sh AS (SELECT c.item_id, c.fam, t.g, t.h, coalesce(o.n, 0) AS cum FROM chosen c JOIN tree t ON t.f = c.fam LEFT JOIN qo o ON o.item_id = c.item_id AND o.id = t.h),
sg AS (SELECT s.item_id, s.fam, s.g, coalesce(max(o.n), 0) AS own, coalesce(max(o.n), 0) + max(s.cum) AS cum FROM sh s LEFT JOIN qo o ON o.item_id = s.item_id AND o.id = s.g GROUP BY 1, 2, 3),
sf AS (SELECT s.item_id, s.fam, coalesce(max(o.n), 0) AS own, coalesce(max(o.n), 0) + max(s.cum) AS cum FROM sg s LEFT JOIN qo o ON o.item_id = s.item_id AND o.id = s.fam GROUP BY 1, 2),
rf AS (SELECT sf.item_id, sf.fam, sf.own, sf.cum, c.n, (sf.cum - hp.p * c.n) / c.n AS score FROM sf JOIN chosen c ON c.item_id = sf.item_id AND c.fam = sf.fam JOIN hp ON hp.id = sf.fam),
rg AS (SELECT sg.item_id, sg.fam, sg.g, sg.own, sg.cum, rf.n - rf.own AS n, (sg.cum - hp.p * (rf.n - rf.own)) / (rf.n - rf.own) AS score
       FROM sg JOIN rf ON rf.item_id = sg.item_id AND rf.fam = sg.fam JOIN hp ON hp.id = sg.g WHERE sg.cum > 0),
rh AS (SELECT sh.item_id, sh.fam, sh.g, sh.h, sh.cum, (sh.cum - hp.p * (rg.n - rg.own)) / (rg.n - rg.own) AS score
       FROM sh JOIN rg ON rg.item_id = sh.item_id AND rg.g = sh.g JOIN hp ON hp.id = sh.h WHERE sh.cum > 0),
bg AS (SELECT * FROM (SELECT *, max(score) OVER w AS top FROM rg WINDOW w AS (PARTITION BY item_id, fam)) WHERE score > 0 AND score = top
       QUALIFY count(*) OVER (PARTITION BY item_id, fam) = 1),
bh AS (SELECT rh.* FROM rh JOIN bg ON bg.item_id = rh.item_id AND bg.g = rh.g WHERE rh.score > 0
       QUALIFY rh.score = max(rh.score) OVER (PARTITION BY rh.item_id, rh.g)),
bh1 AS (SELECT * FROM bh QUALIFY count(*) OVER (PARTITION BY item_id, g) = 1),
path AS (SELECT item_id, fam, fam AS id, 1 AS depth, cum, score FROM rf UNION ALL SELECT item_id, fam, g, 2, cum, score FROM bg UNION ALL SELECT item_id, fam, h, 3, cum, score FROM bh1),
pick AS (SELECT * FROM path WHERE score >= 0.1 QUALIFY row_number() OVER (PARTITION BY item_id, fam ORDER BY depth DESC) = 1),
med AS (SELECT id, CAST(floor(median(length(seq))) AS BIGINT) AS m FROM (SELECT f AS id, seq FROM d UNION ALL SELECT g, seq FROM d UNION ALL SELECT h, seq FROM d) GROUP BY 1)"""


def result(subfamilies: bool = True) -> str:
    chosen = "coalesce(pick.id, c.fam)" if subfamilies else "c.fam"
    score = "round(nullif(pick.score, 0), 6)" if subfamilies else "CAST(NULL AS DOUBLE)"
    count = "CASE WHEN pick.score <> 0 THEN nullif(pick.cum, 0) END" if subfamilies else "CAST(NULL AS BIGINT)"
    join = "LEFT JOIN pick ON pick.item_id = c.item_id AND pick.fam = c.fam" if subfamilies else ""
    return f"""
SELECT CAST(q.item_id AS VARCHAR) AS qseqid, coalesce(c.rank, 1) AS rank, {chosen} AS hogid,
       'level' || (1 + length({chosen}) - length(replace({chosen}, '.', ''))) AS hoglevel, round(nullif(c.pvalue, 0), 6) AS family_p, c.cnt AS family_count,
       round(nullif(c.normcount, 0), 6) AS family_normcount, {score} AS subfamily_score, {count} AS subfamily_count,
       CAST(length(q.seq) + 1 AS BIGINT) AS qseqlen, med.m AS subfamily_medianseqlen, round(nullif(c.overlap, 0), 6) AS qseq_overlap
FROM q LEFT JOIN chosen c ON c.item_id = q.item_id {join} LEFT JOIN med ON med.id = {chosen}"""


CHAIN = f"WITH {base(STRIP)},{significance()},{PROBABILITY},{placement()}"
CHAIN_3 = f"WITH {base(STRIP)},{significance(1e-2)},{PROBABILITY},{placement(3)}"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- scalar functions


@query(f"SELECT doc_id, md5({RAW}) AS seq_md5, CAST(length({RAW}) AS BIGINT) AS n FROM documents")
def sanitise(spark, sf_dir):
    seq = sq.sanitise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(seq).alias("seq_md5"), F.length(seq).cast("long").alias("n"))


@query(f"SELECT item_id, translate({STRIP}, 'STNQYVRM', 'AADEFIKL') AS seq FROM benchmark")
def reduced_alphabet(spark, sf_dir):
    seq = sq.reduce_alphabet(sq.strip_residues(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "benchmark").select("item_id", seq.alias("seq"))


@query(
    "WITH b AS (SELECT DISTINCT coalesce(source, '?') || '.' || coalesce(lang, '?') || '.b' || (doc_id % 3) AS id FROM documents) "
    "SELECT id, split_part(id, '.', 1) || ' ' || split_part(id, '.', 1) || '.' || split_part(id, '.', 2) || ' ' || id AS prefixes, "
    "split_part(id, '.', 1) || '.' || split_part(id, '.', 2) AS parent, CAST(3 AS BIGINT) AS depth, '7.' || split_part(id, '.', 2) || '.' || split_part(id, '.', 3) AS relabelled FROM b"
)
def id_prefixes(spark, sf_dir):
    h = F.col("h")
    return placed_documents(spark, sf_dir).select("h").distinct().select(
        h.alias("id"), F.array_join(ids.prefixes(h), " ").alias("prefixes"), ids.parent(h).alias("parent"), ids.depth(h).cast("long").alias("depth"),
        ids.relabel(F.lit(7), h, ids.parts(h)[0]).alias("relabelled"),
    )


@query(
    "SELECT c_custkey, printf('HOG:%07d.1a', c_custkey) AS gid, printf('CUST%05d', c_custkey) AS pid, CAST(c_custkey AS INT) AS fam, '1a' AS sub FROM customer"
)
def group_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", ids.group_id(F.col("c_custkey"), F.lit("1a")).alias("gid"), ids.protein_id(F.lit("CUST"), F.col("c_custkey")).alias("pid"))
    return c.withColumn("p", ids.parse_group(F.col("gid"))).select("c_custkey", "gid", "pid", F.col("p.fam").alias("fam"), F.col("p.sub").alias("sub"))


# ---------------------------------------------------------------- k-mers


@query(
    f"WITH {base(RAW)} SELECT item_id, count(*) FILTER (NOT contains(kmer, 'X')) AS n_clean, max(n) AS n FROM qx JOIN qn USING (item_id) GROUP BY 1"
)
def kmer_distinct(spark, sf_dir):
    q = asked(spark, sf_dir, raw=True)
    clean = srch.query_kmers(q, K).groupBy("ord").agg(F.count(F.lit(1)).alias("n_clean"))
    return srch.query_sizes(q, K).join(clean, "ord", "left").select(F.col("ord").alias("item_id"), F.coalesce("n_clean", F.lit(0)).alias("n_clean"), "n")


@query(f"WITH {base(RAW)} SELECT item_id, kmer, pos FROM qk")
def kmer_first_pos(spark, sf_dir):
    return srch.query_kmers(asked(spark, sf_dir, raw=True), K).select(F.col("ord").alias("item_id"), "kmer", F.col("pos").cast("long").alias("pos"))


@query(
    f"WITH {base(STRIP)} SELECT item_id, CAST(sum(list_sum(list_transform(range(1, 7), lambda i: (strpos('ACDEFGHIKLMNPQRSTVWXY', substr(kmer, CAST(i AS INT), 1)) - 1) * CAST(pow(21, 6 - i) AS BIGINT)))) AS BIGINT) "
    "AS codes FROM qk GROUP BY 1"
)
def kmer_codes(spark, sf_dir):
    k = srch.query_kmers(asked(spark, sf_dir), K)
    return k.groupBy(F.col("ord").alias("item_id")).agg(F.sum(sq.kmer_code(F.col("kmer"), K)).alias("codes"))


# ---------------------------------------------------------------- index


@query(f"WITH {base(RAW)} SELECT kmer, fam, lca FROM post")
def kmer_lca(spark, sf_dir):
    b = bound(spark, sf_dir, raw=True)
    return b.postings.join(b.family_names, "fam_id").join(b.names, "hog_id").select(sq.kmer_of(F.col("code"), K).alias("kmer"), F.col("family").alias("fam"), F.col("ext_id").alias("lca"))


@query(f"WITH {base(STRIP)} SELECT lca AS ext_id, count(*) AS n FROM post GROUP BY 1")
def hog_own_counts(spark, sf_dir):
    b = bound(spark, sf_dir)
    return index.own_counts(b.postings).join(b.names, "hog_id").select("ext_id", "n")


@query(f"WITH {base(STRIP)} SELECT fam, round(p, 9) AS p FROM fp")
def family_prob(spark, sf_dir):
    b = bound(spark, sf_dir)
    return b.family_prob.join(b.family_names, "fam_id").select(F.col("family").alias("fam"), F.round("fam_prob", 9).alias("p"))


@query(f"WITH {base(STRIP)},{PROBABILITY} SELECT id AS ext_id, round(p, 9) AS p FROM hp")
def hog_prob(spark, sf_dir):
    b = bound(spark, sf_dir)
    return index.group_probability(b.postings, b.plain_groups).join(b.names, "hog_id").select("ext_id", F.round("hog_prob", 9).alias("p"))


@query(
    "WITH t AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_regionkey AS BIGINT) AS r, n_nationkey % 7 + 1 AS n FROM nation), "
    "c AS (SELECT r, max(n) AS cum FROM t GROUP BY 1) "
    "SELECT id, CAST(10 AS BIGINT) AS before, CAST(n AS BIGINT) AS cum FROM t UNION ALL SELECT 100 + r, CAST(0 AS BIGINT), CAST(10 + cum AS BIGINT) FROM c"
)
def chain_counts(spark, sf_dir):
    """Cumulated counts of a region-nation tree with counts on both levels."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_regionkey") + 100).cast("long").alias("up"), (F.col("n_nationkey") % 7 + 1).alias("n"))
    low = n.select(F.col("id").alias("hog_id"), F.array("up", "id").alias("path"), "n")
    top = n.select(F.col("up").alias("hog_id"), F.array("up").alias("path"), F.lit(10).alias("n")).distinct()
    both = low.unionByName(top)
    counts = both.select(F.lit(1).alias("one"), "hog_id", "n")
    return index.heaviest_chains(counts, both.select("hog_id", "path"), ["one"]).select(F.col("hog_id").alias("id"), F.col("before").cast("long").alias("before"), F.col("cum").cast("long").alias("cum"))


# ---------------------------------------------------------------- search


@query(f"WITH {base(STRIP)} SELECT item_id, fam, cnt, lo, hi FROM fc")
def family_hits(spark, sf_dir):
    b = bound(spark, sf_dir)
    c = srch.family_counts(b.found).join(b.family_names, "fam_id")
    return c.select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.col("count").alias("cnt"), F.col("low").cast("long").alias("lo"), F.col("high").cast("long").alias("hi"))


@query(f"WITH {base(RAW)} SELECT item_id, fam, cnt, lo, hi FROM fc")
def family_hits_raw(spark, sf_dir):
    b = bound(spark, sf_dir, raw=True)
    c = srch.family_counts(b.found).join(b.family_names, "fam_id")
    return c.select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.col("count").alias("cnt"), F.col("low").cast("long").alias("lo"), F.col("high").cast("long").alias("hi"))


@query(f"WITH {base(STRIP)},{significance()} SELECT item_id, fam, round(s * ln(s / p) + (1 - s) * ln((1 - s) / (1 - p)), 6) AS kl FROM c2")
def kl_divergence(spark, sf_dir):
    b = bound(spark, sf_dir)
    rows = srch.family_counts(b.found).join(srch.query_sizes(b.queries, K), "ord").join(b.family_prob, "fam_id")
    c, n, p = F.col("count"), F.col("n"), F.col("fam_prob")
    rows = rows.filter(c >= st.expected(p, n)).filter(st.covers(F.col("low"), F.col("high"), K)).join(b.family_names, "fam_id")
    return rows.select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.round(st.divergence(c, n, p), 6).alias("kl"))


@query(f"WITH {base(STRIP)},{significance(1e-2)} SELECT item_id, fam, cnt, round(pvalue, 6) AS pvalue, round(normcount, 6) AS normcount, round(overlap, 6) AS overlap FROM sig")
def family_pvalue(spark, sf_dir):
    b = bound(spark, sf_dir)
    rows = b.significant(1e-2).join(b.family_names, "fam_id").select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.col("count").alias("cnt"), "pvalue", "normcount", "overlap")
    return rounded(rows, "pvalue", "normcount", "overlap")


@query(f"WITH {base(STRIP)},{significance(1e-2)} SELECT item_id, fam, rank FROM ranked WHERE rank <= 5")
def family_topn(spark, sf_dir):
    b = bound(spark, sf_dir)
    rows = srch.top_families(b.significant(1e-2), 5).join(b.family_names, "fam_id")
    return rows.select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.col("rank").cast("long").alias("rank"))


@query(f"{CHAIN} SELECT item_id, id, cum, round(score, 6) AS score FROM (SELECT item_id, fam AS id, cum, score FROM rf UNION ALL SELECT item_id, g, cum, score FROM rg UNION ALL SELECT item_id, h, cum, score FROM rh)")
def hog_scores(spark, sf_dir):
    b = bound(spark, sf_dir)
    scored, _ = b.scored()
    return scored.join(b.names, "hog_id").select(F.col("ord").alias("item_id"), F.col("ext_id").alias("id"), "cum", F.round("score", 6).alias("score"))


@query(f"{CHAIN_3} SELECT item_id, id, CAST(depth AS BIGINT) AS depth FROM path")
def best_path(spark, sf_dir):
    b = bound(spark, sf_dir)
    path = srch.best_path(*b.scored(1e-2, 3)).join(b.names, "hog_id")
    return path.select(F.col("ord").alias("item_id"), F.col("ext_id").alias("id"), F.col("depth").cast("long").alias("depth"))


@query(f"{CHAIN_3} SELECT c.item_id, c.fam, coalesce(pick.id, c.fam) AS id FROM chosen c LEFT JOIN pick ON pick.item_id = c.item_id AND pick.fam = c.fam")
def placement_top3(spark, sf_dir):
    b = bound(spark, sf_dir)
    placed = srch.place(srch.best_path(*b.scored(1e-2, 3))).join(b.names, "hog_id").join(b.family_names, "fam_id")
    return placed.select(F.col("ord").alias("item_id"), F.col("family").alias("fam"), F.col("ext_id").alias("id"))


@query(f"{CHAIN} {result()}")
def search_full(spark, sf_dir):
    return shown(bound(spark, sf_dir).results())


@query(f"{CHAIN_3} {result()}")
def search_top3(spark, sf_dir):
    return shown(bound(spark, sf_dir).results(alpha=1e-2, top_n=3))


@query(f"{CHAIN} {result(False)}")
def search_family_only(spark, sf_dir):
    return shown(bound(spark, sf_dir).results(family_only=True))


@query(
    f"{CHAIN} SELECT qseqid, hogid, hoglevel, family_p, family_count, family_normcount, subfamily_score, subfamily_count, qseqlen, subfamily_medianseqlen, qseq_overlap FROM ({result()})"
)
def results_round_trip(spark, sf_dir):
    """The result file, written in parallel and read back."""
    path = fresh_path(spark, "results")
    results.write_results(bound(spark, sf_dir).results(), path)
    got = results.read_results(spark, path)[0].withColumns({n: F.col(n).cast("long") for n in ("family_count", "subfamily_count", "qseqlen", "subfamily_medianseqlen")})
    return rounded(got, "family_p", "family_normcount", "subfamily_score", "qseq_overlap")


@query(f"SELECT CAST(item_id AS VARCHAR) AS qseqid, {RAW} AS seq FROM benchmark WHERE length({RAW}) >= 6")
def fasta_scan(spark, sf_dir):
    """Items written as FASTA records and read back as queries."""
    path = fresh_path(spark, "fasta")
    clean = sq.sanitise(F.coalesce("text", F.lit("")))
    table(spark, sf_dir, "benchmark").select(F.format_string(">%s some words\n%s\n%s", F.col("item_id").cast("string"), F.substring(clean, 1, 60), F.substring(clean, 61, 1 << 30)).alias("value")).write.text(path)
    return fasta.read_queries(spark, path, K).select("qseqid", "seq")


# ---------------------------------------------------------------- trees


def customer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parent: r0 .. regions, n0 .. nations, c1 .. customers."""
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    return r.unionByName(n).unionByName(c)


TREE = """
tree AS (SELECT 'r' || r_regionkey AS id, 'r' || r_regionkey AS path, 1 AS depth FROM region
         UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey || ' n' || n_nationkey, 2 FROM nation
         UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey || ' n' || n_nationkey || ' c' || c_custkey, 3 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query(f"WITH {TREE} SELECT id, path, CAST(depth AS BIGINT) AS depth FROM tree")
def tree_paths(spark, sf_dir):
    t = hierarchy.with_paths(customer_tree(spark, sf_dir))
    return t.select("id", F.array_join("path", " ").alias("path"), F.col("depth").cast("long").alias("depth"))


@query(f"WITH {TREE} SELECT id FROM tree WHERE path LIKE 'r2 %'")
def tree_descendants(spark, sf_dir):
    return hierarchy.descendants(hierarchy.with_paths(customer_tree(spark, sf_dir)), F.lit("r2")).select("id")


@query(f"WITH {TREE} SELECT id FROM tree WHERE path LIKE 'r1 %' AND NOT EXISTS (SELECT 1 FROM tree x WHERE x.path LIKE tree.path || ' %')")
def tree_leaves(spark, sf_dir):
    return hierarchy.leaves(hierarchy.with_paths(customer_tree(spark, sf_dir)), F.lit("r1")).select("id")


@query(f"WITH {TREE}, l AS (SELECT path FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE x.path LIKE t.path || ' %')) SELECT id, count(*) AS n_below FROM tree JOIN l ON l.path || ' ' LIKE tree.path || ' %' GROUP BY 1")
def leaf_counts(spark, sf_dir):
    return hierarchy.leaf_counts(hierarchy.with_paths(customer_tree(spark, sf_dir)))


@query("SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 3")
def tree_children(spark, sf_dir):
    return hierarchy.children(customer_tree(spark, sf_dir), F.lit("r3")).select("id")


@query(f"WITH {TREE} SELECT id, (path || ' ') LIKE '%n3 %' AS under FROM tree")
def is_ancestor(spark, sf_dir):
    t = hierarchy.with_paths(customer_tree(spark, sf_dir))
    return t.select("id", hierarchy.is_ancestor(F.col("path"), F.lit("n3")).alias("under"))


@query(
    "WITH o AS (SELECT c_mktsegment AS seg, c_custkey % 50 AS part, c_nationkey AS n, n_regionkey AS r, c_custkey AS c FROM customer JOIN nation ON c_nationkey = n_nationkey) "
    "SELECT seg, CAST(part AS BIGINT) AS part, CASE WHEN count(DISTINCT c) = 1 THEN 'c' || min(c) WHEN count(DISTINCT n) = 1 THEN 'n' || min(n) WHEN count(DISTINCT r) = 1 THEN 'r' || min(r) END AS lca FROM o GROUP BY 1, 2"
)
def tree_lca(spark, sf_dir):
    t = hierarchy.with_paths(customer_tree(spark, sf_dir))
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 50).alias("part"))
    return hierarchy.lowest_common_of(c.join(t.select("id", "path"), "id"), ["seg", "part"])


# ---------------------------------------------------------------- tours

EVENTS = f"""{TREE},
kids AS (SELECT count(*) AS n, regexp_replace(path, ' [^ ]+$', '') AS up FROM tree WHERE depth > 1 GROUP BY 2),
ev AS (SELECT split_part(path, ' ', 1) AS tree, id, path AS k, true AS going_in, depth = 1 OR up IS NOT NULL AS inner_node FROM tree LEFT JOIN kids ON up = path
       UNION ALL SELECT split_part(path, ' ', 1), id, path || ' ~', false, depth = 1 OR up IS NOT NULL FROM tree LEFT JOIN kids ON up = path),
num AS (SELECT *, CAST(row_number() OVER (PARTITION BY tree ORDER BY k) - 1 AS BIGINT) AS place FROM ev)"""


@query(f"WITH {EVENTS} SELECT tree, place, CASE WHEN NOT inner_node THEN 'leaf' WHEN going_in THEN 'prefix' ELSE 'postfix' END AS hook, id AS value FROM num WHERE inner_node OR going_in")
def tree_traverse(spark, sf_dir):
    """All three hooks of a visit of the whole forest."""
    t = tours.tour(customer_tree(spark, sf_dir))
    return tours.traverse(t, leaf=F.col("id"), prefix=F.col("id"), postfix=F.col("id")).withColumnRenamed("at", "place")


@query(
    "WITH n AS (SELECT n_regionkey, 'n' || n_nationkey AS id, CASE WHEN count(c_custkey) > 0 THEN '(' || string_agg('c' || c_custkey, ', ' ORDER BY 'c' || c_custkey) || ')' ELSE '' END || 'n' || n_nationkey AS x "
    "FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey) "
    "SELECT 'r' || r_regionkey AS tree, CASE WHEN count(n.id) > 0 THEN '(' || string_agg(x, ', ' ORDER BY n.id) || ')' ELSE '' END || 'r' || r_regionkey || ';' AS newick "
    "FROM region LEFT JOIN n ON n_regionkey = r_regionkey GROUP BY r_regionkey"
)
def tree_newick(spark, sf_dir):
    """The forest as text, all trees in one aggregate."""
    return tours.newick(tours.tour(customer_tree(spark, sf_dir)), F.col("id"))


@query(
    f"WITH {TREE}, v AS (SELECT id, path || ' ' AS path, CAST(length(id) AS BIGINT) AS x, depth = 3 OR NOT EXISTS (SELECT 1 FROM tree b WHERE b.path LIKE tree.path || ' %') AS leaf FROM tree) "
    "SELECT a.id, CAST(sum(CASE WHEN starts_with(b.path, a.path) THEN b.x ELSE 0 END) AS BIGINT) AS below, CAST(sum(CASE WHEN starts_with(a.path, b.path) THEN b.x ELSE 0 END) AS BIGINT) AS upto, "
    "CAST(sum(CASE WHEN starts_with(b.path, a.path) AND b.leaf THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves FROM v a JOIN v b ON starts_with(b.path, a.path) OR starts_with(a.path, b.path) GROUP BY 1"
)
def tree_sums(spark, sf_dir):
    """Sums at or below and on the path to every node, by prefix sums."""
    t = settle(tours.tour(customer_tree(spark, sf_dir)), "tour")
    value = F.length("id").cast("long")
    return tours.below_sums(t, "id", value, "below").join(tours.path_sums(t, "id", value, "upto"), "id").join(tours.leaves_below(t, "id", "n_leaves"), "id")


# ---------------------------------------------------------------- build


@query(
    f"WITH {base(STRIP)} SELECT id AS ext_id, CAST(floor(median(length(seq))) AS BIGINT) AS median_seqlen, count(*) AS n FROM (SELECT f AS id, seq FROM d UNION ALL SELECT g, seq FROM d UNION ALL SELECT h, seq FROM d) GROUP BY 1"
)
def median_len_subtree(spark, sf_dir):
    g = settle(bound_groups(spark, sf_dir), "groups")
    s = sequences(spark, sf_dir, g).select("hog_id", F.length("seq").alias("seq_len"))
    sizes = s.join(hierarchy.closure(g, "hog_id"), s.hog_id == F.col("node")).groupBy(F.col("ancestor").alias("hog_id")).agg(F.count(F.lit(1)).alias("n"))
    return build.median_lengths(s, g).join(sizes, "hog_id").join(g.select("hog_id", "ext_id"), "hog_id").select("ext_id", F.col("median_seqlen").cast("long").alias("median_seqlen"), "n")


@query("WITH s AS (SELECT count(DISTINCT coalesce(lang, '?')) AS total FROM documents) SELECT coalesce(source, '?') AS id, count(*) AS n_genes, round(count(DISTINCT coalesce(lang, '?')) / max(total), 9) AS completeness FROM documents, s GROUP BY 1")
def completeness(spark, sf_dir):
    d = placed_documents(spark, sf_dir)
    below = d.select(F.lit("all").alias("name"), "lang").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n_below"))
    rows = d.select(F.lit(1).alias("fam"), F.col("f").alias("id"), F.lit("all").alias("level"), F.lit(0).alias("ord"), F.col("doc_id").alias("gene"), F.col("lang").alias("species"))
    return build.group_sizes(rows, below).select("id", "n_genes", F.round("completeness", 9).alias("completeness"))


def bound_levels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Levels of the three kinds of groups: sizes are documents, taxa are
    all > west or north > languages; north is out of scope for sources
    whose number is divisible by 7."""
    d = placed_documents(spark, sf_dir)
    side = F.when(F.col("lang").isin("en", "de"), F.lit("north")).otherwise(F.lit("west"))
    fam = F.regexp_extract("f", r"(\d+)$", 1).cast("long")
    top = d.groupBy(fam.alias("fam"), F.col("f").alias("id")).agg(F.count(F.lit(1)).alias("n_genes"), (F.count_distinct("lang") / 4).alias("completeness")).withColumn(
        "level", F.when(F.col("fam") % 7 == 0, F.lit("elsewhere")).otherwise(F.lit("all")))
    mid = d.groupBy(fam.alias("fam"), F.col("g").alias("id"), side.alias("level")).agg(F.count(F.lit(1)).alias("n_genes"), F.lit(0.5).alias("completeness"))
    low = d.groupBy(fam.alias("fam"), F.col("h").alias("id"), F.col("lang").alias("level")).agg(F.count(F.lit(1)).alias("n_genes"), F.lit(1.0).alias("completeness"))
    rows = top.unionByName(mid).unionByName(low).withColumn("ord", F.col("fam"))
    taxa = spark.createDataFrame([("all", 0), ("north", 1), ("west", 1), ("en", 2), ("de", 2), ("fr", 2), ("es", 2)], "name string, level int")
    return rows, taxa


LEVELS = """
d AS (SELECT CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT) AS fam, source AS f, source || '.' || lang AS g, source || '.' || lang || '.b' || (doc_id % 3) AS h, lang FROM documents),
rows AS (
  SELECT fam, f AS id, f AS root, count(*) AS n_genes, count(DISTINCT lang) / 4 AS comp, 'all' AS tax, fam % 7 <> 0 AS inside FROM d GROUP BY 1, 2
  UNION ALL SELECT fam, g, CASE WHEN fam % 7 = 0 THEN g ELSE max(f) END, count(*), 0.5, CASE WHEN max(lang) IN ('en', 'de') THEN 'north' ELSE 'west' END, true FROM d GROUP BY fam, g
  UNION ALL SELECT fam, h, CASE WHEN fam % 7 = 0 THEN max(g) ELSE max(f) END, count(*), 1.0, max(lang), true FROM d GROUP BY fam, h),
good AS (SELECT fam, root FROM rows WHERE inside AND id = root AND (n_genes >= 15 AND comp >= 0.5)),
numbered AS (SELECT fam, root, row_number() OVER (ORDER BY fam, root) AS fam_id FROM good)"""


@query(
    f"WITH {LEVELS} SELECT CAST(fam_id AS INT) AS fam_id, fam_id || substr(id, length(r.root) + 1) AS label, id AS source_id, tax, n_genes, round(comp, 6) AS completeness FROM rows r JOIN numbered USING (fam, root) WHERE inside"
)
def root_filter(spark, sf_dir):
    levels, taxa = bound_levels(spark, sf_dir)
    got = build.select_groups(levels, taxa, min_size=15, min_completeness=0.5, logic="AND")
    return got.select("fam_id", "label", "source_id", "tax", "n_genes", F.round("completeness", 6).alias("completeness"))


@query(
    f"WITH {LEVELS}, l AS (SELECT fam_id || substr(id, length(r.root) + 1) AS label, fam_id FROM rows r JOIN numbered USING (fam, root) WHERE inside), "
    "n AS (SELECT *, row_number() OVER (ORDER BY fam_id, len(string_split(label, '.')), label) AS hog_id, row_number() OVER (ORDER BY fam_id, string_split(label, '.')) AS pre FROM l) "
    "SELECT n.label, n.hog_id, p.hog_id AS parent, CAST(len(string_split(n.label, '.')) AS BIGINT) AS depth FROM n LEFT JOIN n p ON n.label LIKE p.label || '.%' AND len(string_split(n.label, '.')) = len(string_split(p.label, '.')) + 1"
)
def group_table(spark, sf_dir):
    levels, taxa = bound_levels(spark, sf_dir)
    got = build.number_groups(build.select_groups(levels, taxa, min_size=15, min_completeness=0.5, logic="AND"))
    return got.select("label", "hog_id", "parent", F.col("depth").cast("long").alias("depth"))


@query(
    "WITH d AS (SELECT source AS f, source || '.' || lang AS g, lang FROM documents), m AS (SELECT DISTINCT g, lang FROM d) "
    "SELECT g AS id, lang AS tax FROM m UNION SELECT g, CASE WHEN lang IN ('en', 'de') THEN 'north' ELSE 'west' END FROM m "
    "UNION SELECT f, 'all' FROM d"
)
def hog_taxa(spark, sf_dir):
    """Groups source (taxon all) and source.lang (taxon north or west)."""
    d = placed_documents(spark, sf_dir).select("f", "g", "lang").distinct()
    side = F.when(F.col("lang").isin("en", "de"), F.lit("north")).otherwise(F.lit("west"))
    groups = d.select(F.col("f").alias("hog_id"), F.lit(None).cast("string").alias("parent"), F.lit("all").alias("tax")).distinct().unionByName(d.select(F.col("g").alias("hog_id"), F.col("f").alias("parent"), side.alias("tax")))
    members = d.select(F.col("g").alias("hog_id"), F.col("lang").alias("tax"))
    taxa = spark.createDataFrame([(p[-1], p) for p in (["all"], ["all", "north"], ["all", "west"], ["all", "north", "en"], ["all", "north", "de"], ["all", "west", "fr"], ["all", "west", "es"])], "tax string, path array<string>")
    return hierarchy.group_taxa(groups, members, taxa).select(F.col("hog_id").alias("id"), "tax")


FOREST = """
r AS (SELECT DISTINCT source AS f, source || '.' || CASE WHEN lang IN ('en', 'de') THEN 'north' ELSE 'west' END AS g, source || '.' || lang AS h,
             CASE WHEN lang IN ('en', 'de') THEN 'north' ELSE 'west' END AS side, lang FROM documents),
n AS (SELECT f AS id, 'all' AS tax, bool_or(side = 'north') AS below FROM r GROUP BY f
      UNION ALL SELECT g, max(side), bool_or(lang = 'de') FROM r GROUP BY g
      UNION ALL SELECT h, max(lang), false FROM r GROUP BY h)"""


def forest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Column]:
    """Sources at taxon all, their halves at north or west, their languages;
    and the lineage of German."""
    d = table(spark, sf_dir, "documents")
    side = F.when(F.col("lang").isin("en", "de"), F.lit("north")).otherwise(F.lit("west"))
    r = d.select(F.col("source").alias("f"), F.concat_ws(".", "source", side).alias("g"), F.concat_ws(".", "source", "lang").alias("h"), side.alias("side"), "lang").distinct()
    top = r.select(F.col("f").alias("hog_id"), F.lit(None).cast("string").alias("parent"), F.lit("all").alias("tax"))
    rows = top.unionByName(r.select(F.col("g").alias("hog_id"), F.col("f").alias("parent"), F.col("side").alias("tax"))).unionByName(r.select(F.col("h").alias("hog_id"), F.col("g").alias("parent"), F.col("lang").alias("tax")))
    return rows.distinct(), F.array(F.lit("all"), F.lit("north"), F.lit("de"))


@query(f"WITH {FOREST} SELECT id, tax IN ('all', 'north', 'de') AND NOT below AS implied FROM n")
def taxon_implied(spark, sf_dir):
    return hierarchy.taxon_implied(*forest(spark, sf_dir)).select(F.col("hog_id").alias("id"), "implied")


@query(f"WITH {FOREST} SELECT id, CASE WHEN tax IN ('all', 'north', 'de') AND NOT below THEN 'de' ELSE tax END AS closest FROM n")
def closest_taxon(spark, sf_dir):
    return hierarchy.closest_taxon(*forest(spark, sf_dir)).select(F.col("hog_id").alias("id"), F.col("closest_taxon").alias("closest"))


@query(
    f"WITH {base(STRIP)} SELECT kmer, fam, CASE WHEN count(DISTINCT h) = 1 THEN min(h) WHEN count(DISTINCT g) = 1 THEN min(g) ELSE fam END AS lca FROM "
    "(SELECT f AS fam, g, h, substr(seq, CAST(i AS INT), 6) AS kmer FROM d, unnest(range(1, length(seq) - 4)) AS t(i) WHERE lang = 'fr' AND length(seq) >= 6) GROUP BY kmer, fam"
)
def hidden_taxa(spark, sf_dir):
    """The index without three of the four species."""
    taxa = spark.createDataFrame([(p[-1], p[-2] if len(p) > 1 else None, p) for p in (["all"], ["all", "north"], ["all", "west"], ["all", "north", "en"], ["all", "north", "de"], ["all", "west", "fr"], ["all", "west", "es"])], "name string, parent string, path array<string>")
    g = settle(bound_groups(spark, sf_dir), "groups")
    post = index.build(sequences(spark, sf_dir, g), g, K, build.hidden_species(taxa, ["north", "es"]))
    return post.join(g.filter("parent is null").select("fam_id", F.col("ext_id").alias("fam")), "fam_id").join(g.select("hog_id", F.col("ext_id").alias("lca")), "hog_id").select(sq.kmer_of(F.col("code"), K).alias("kmer"), "fam", "lca")


@query("SELECT id AS ext_id, string_agg(doc, ',' ORDER BY doc) AS genes FROM (SELECT unnest([coalesce(source, '?'), coalesce(source, '?') || '.' || coalesce(lang, '?'), coalesce(source, '?') || '.' || coalesce(lang, '?') || '.b' || (doc_id % 3)]) AS id, CAST(doc_id AS VARCHAR) AS doc FROM documents) GROUP BY 1")
def geneset(spark, sf_dir):
    g = settle(bound_groups(spark, sf_dir), "groups")
    m = placed_documents(spark, sf_dir).select(F.col("h").alias("label"), F.col("doc_id").cast("string").alias("ext_id")).join(g.select("hog_id", F.col("ext_id").alias("label")), "label")
    return srch.gene_sets(m.select("hog_id", "ext_id"), g).join(g.select("hog_id", "ext_id"), "hog_id").select("ext_id", F.col("subfamily_geneset").alias("genes"))


@query("SELECT l.doc_id AS gene, 's' || (l.doc_id // 64) AS species FROM labels l")
def species_of_genes(spark, sf_dir):
    """Labelled documents as genes, blocks of 64 numbers as species."""
    blocks = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 64).alias("b")).distinct()
    species = blocks.select(F.concat(F.lit("s"), F.col("b").cast("string")).alias("species"), (F.col("b") * 64).alias("min_id"), (F.col("b") * 64 + 63).alias("max_id"))
    return build.species_of_genes(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("gene")), species).select("gene", "species")


@query("SELECT conv_id AS prot_id, count(*) AS n FROM conversations GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return build.repeated_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("prot_id")))


@query("SELECT n_nationkey AS nation, CAST(length(n_name) + 1 AS BIGINT) AS length, md5(n_name || chr(10)) AS md5 FROM nation")
def md5(spark, sf_dir):
    """A file for each nation, and the files' checksums."""
    path = fresh_path(spark, "md5")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_name").write.partitionBy("n_nationkey").text(path)
    got = checksums(spark, f"{path}/*/*.txt")
    return got.select(F.regexp_extract("path", r"n_nationkey=(\d+)", 1).cast("int").alias("nation"), "length", "md5")


@query("SELECT c_custkey AS gene, coalesce(n.n_name, c.c_name) AS xref FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey AND n.n_regionkey < 2")
def xref_resolve(spark, sf_dir):
    """Customers as genes; nations of two regions as extra identifiers."""
    genes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("gene"), F.col("c_nationkey").cast("string").alias("ref"), "c_name")
    extra = table(spark, sf_dir, "nation").filter("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("ref"), F.col("n_name").alias("xref"))
    return build.resolve_references(genes.select("gene", "ref"), genes.select("gene", F.col("c_name").alias("name")), extra).select("gene", "xref")


@query("SELECT name, CAST(coalesce(k, -99 - row_number() OVER (PARTITION BY k IS NULL ORDER BY name)) AS INT) AS ncbi_id FROM (SELECT n_name AS name, CASE WHEN n_regionkey < 3 THEN n_nationkey END AS k FROM nation)")
def taxon_numbers(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return build.taxon_numbers(n.select(F.col("n_name").alias("name")), n.filter("n_regionkey < 3").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("ncbi_id"))).select("name", "ncbi_id")


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer")
def numbered_rows(spark, sf_dir):
    """Consecutive numbers over a range sort, as families and groups get them."""
    from .operators.shared import number_rows

    return number_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), [F.desc("c_acctbal"), F.asc("id")], "n", 1).select("id", "n")


# ---------------------------------------------------------------- building from files

#: The SQL side of the world that world_files writes.
WORLD = """
j AS (SELECT n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS j FROM nation WHERE n_nationkey % 2 = 1),
w AS (SELECT c_custkey AS gene, 'C' || c_custkey AS prot_id, n_name AS species, n.n_nationkey AS ncbi_id, r_name AS region, r_regionkey + 1 AS fam,
             coalesce('.' || j || CASE WHEN c_custkey % 2 = 0 THEN 'a' ELSE 'b' END, '') AS branch, length(c_name || c_mktsegment) AS seq_len
      FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN j ON j.n_nationkey = n.n_nationkey)"""


def world_files(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """An OrthoXML, a Newick and a FASTA path: nations are species, customers
    genes, regions groups; nations of odd number were duplicated within their
    region, customers of even number being the first branch."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))

    def joined(text: Column, when: Column | None = None) -> Column:
        kept = F.struct("c_custkey", text.alias("x")) if when is None else F.when(when, F.struct("c_custkey", text.alias("x")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(kept)), lambda v: v["x"]), "")

    gene, even = F.format_string('<gene id="%d" protId="C%d"/>', "c_custkey", "c_custkey"), F.col("c_custkey") % 2 == 0
    ref = F.format_string('<geneRef id="%d"/>', "c_custkey")
    nations = c.groupBy("n_nationkey", "n_name", "r_regionkey", "r_name").agg(joined(gene).alias("genes"), joined(ref).alias("refs"), joined(ref, even).alias("a"), joined(ref, ~even).alias("b"))
    name = F.format_string('<property name="TaxRange" value="%s"/>', "n_name")
    group = lambda inner: F.concat(F.lit("<orthologGroup>"), name, inner, F.lit("</orthologGroup>"))
    inner = F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit("<paralogGroup>"), group(F.col("a")), group(F.col("b")), F.lit("</paralogGroup>"))).otherwise(group(F.col("refs")))
    species = nations.select(
        F.lit(1).alias("part"), F.col("n_nationkey").cast("long").alias("at"),
        F.concat(F.format_string('<species name="%s" NCBITaxId="%d"><database><genes>', "n_name", "n_nationkey"), "genes", F.lit("</genes></database></species>")).alias("x"),
    )
    regions = nations.select("r_regionkey", "r_name", "n_nationkey", inner.alias("x")).groupBy("r_regionkey", "r_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "x"))), lambda v: v["x"]), "").alias("x")
    ).select(
        F.lit(3).alias("part"), F.col("r_regionkey").cast("long").alias("at"),
        F.concat(F.format_string('<orthologGroup id="HOG:%07d"><property name="TaxRange" value="%s"/>', F.col("r_regionkey") + 1, "r_name"), "x", F.lit("</orthologGroup>")).alias("x"),
    )
    ends = spark.createDataFrame([(0, 0, '<orthoXML xmlns="http://orthoXML.org/2011/">'), (2, 0, "<groups>"), (4, 0, "</groups></orthoXML>")], "part int, at long, x string")
    xml, tree, fa = fresh_path(spark, "orthoxml"), fresh_path(spark, "newick"), fresh_path(spark, "fasta")
    species.unionByName(regions).unionByName(ends).orderBy("part", "at").coalesce(1).select("x").write.text(xml)
    lines = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(
        F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.format_string("'%s':1", "n_name"))), ","), F.lit(")")).alias("x")
    )
    lines.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.format_string("%s'%s':1", "x", "r_name"))), ","), F.lit(")all;")).alias("x")).coalesce(1).write.text(tree)
    table(spark, sf_dir, "customer").select(F.format_string(">C%d a customer\n%s%s", "c_custkey", "c_name", "c_mktsegment")).write.text(fa)
    return f"{xml}/*.txt", f"{tree}/*.txt", fa


@query(f"WITH {WORLD} SELECT gene, prot_id, species, ncbi_id FROM w")
def orthoxml_genes(spark, sf_dir):
    return orthoxml.read_genes(spark, world_files(spark, sf_dir)[0]).select("gene", "prot_id", "species", "ncbi_id")


@query(f"WITH {WORLD} SELECT species, ncbi_id, min(gene) AS min_id, max(gene) AS max_id FROM w GROUP BY 1, 2")
def orthoxml_species(spark, sf_dir):
    return orthoxml.read_species(spark, world_files(spark, sf_dir)[0])


@query(f"WITH {WORLD} SELECT fam, printf('HOG:%07d', fam) || branch AS id, gene FROM w")
def orthoxml_members(spark, sf_dir):
    """Genes under their branch labels."""
    return orthoxml.read_members(spark, world_files(spark, sf_dir)[0]).select("fam", "id", "gene")


@query(
    f"WITH {WORLD} SELECT fam, printf('HOG:%07d', fam) || branch AS id, species AS level, count(*) AS n FROM w GROUP BY ALL "
    "UNION ALL SELECT fam, printf('HOG:%07d', fam), region, count(*) FROM w GROUP BY ALL"
)
def orthoxml_groups(spark, sf_dir):
    return orthoxml.read_groups(spark, world_files(spark, sf_dir)[0]).groupBy("fam", "id", "level").agg(F.count(F.lit(1)).alias("n"))


@query(
    "WITH c AS (SELECT n_regionkey, r_name, n_nationkey, n_name, c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), "
    "p AS (SELECT n_regionkey, r_name, n_nationkey, n_name, coalesce('(' || string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) || ')', '') || n_name AS whole, "
    "coalesce('(' || string_agg(CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) END, ', ' ORDER BY c_custkey) || ')', '') || n_name AS a, "
    "coalesce('(' || string_agg(CASE WHEN c_custkey % 2 = 1 THEN CAST(c_custkey AS VARCHAR) END, ', ' ORDER BY c_custkey) || ')', '') || n_name AS b FROM c GROUP BY n_regionkey, r_name, n_nationkey, n_name) "
    "SELECT CAST(n_regionkey + 1 AS BIGINT) AS fam, '(' || string_agg(CASE WHEN n_nationkey % 2 = 1 THEN '(' || a || ', ' || b || ')' ELSE whole END, ', ' ORDER BY n_nationkey) || ')' || r_name || ';' AS newick "
    "FROM p GROUP BY n_regionkey, r_name"
)
def orthoxml_newick(spark, sf_dir):
    """All groups of a file as Newick in one aggregate."""
    return orthoxml.groups_newick(orthoxml.read_nodes(spark, world_files(spark, sf_dir)[0])).select("fam", "newick")


@query("SELECT n_name AS name, r_name AS parent, 2 AS level FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'all', 1 FROM region UNION ALL SELECT 'all', NULL, 0")
def newick_taxa(spark, sf_dir):
    return newick.taxa_table(newick.read_tree(spark, world_files(spark, sf_dir)[1])).select("name", "parent", "level")


def built(spark: SparkSession, sf_dir: str) -> engine.Database:
    xml, tree, fa = world_files(spark, sf_dir)
    return engine.create_from_orthoxml(spark, fresh_path(spark, "database"), xml, tree, [fa], min_size=1)


@query(f"WITH {WORLD} SELECT prot_id AS ext_id, species, fam || branch AS hog, seq_len FROM w")
def orthoxml_build(spark, sf_dir):
    """A database built from files: its members, their groups and sequences."""
    db = built(spark, sf_dir)
    return db.members.join(db.groups.select("hog_id", F.col("ext_id").alias("hog")), "hog_id").select("ext_id", "species", "hog", "seq_len")


@query(
    "SELECT * FROM (SELECT 'nr species' AS key, CAST(count(*) AS VARCHAR) AS value FROM nation UNION ALL SELECT 'root level', 'all' UNION ALL SELECT 'k-mer length', '6' "
    "UNION ALL SELECT 'alphabet size', '21' UNION ALL SELECT 'min fam size', '1' UNION ALL SELECT 'filter logic', 'OR' UNION ALL SELECT 'hidden taxa', '-' UNION ALL SELECT 'source', 'orthoxml')"
)
def database_info(spark, sf_dir):
    return built(spark, sf_dir).metadata.filter(F.col("key").isin("nr species", "root level", "k-mer length", "alphabet size", "min fam size", "filter logic", "hidden taxa", "source"))


@query(
    "SELECT 'C' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey - lo + 1 AS VARCHAR), 5, '0') AS ext_id, n_name AS species, "
    "CAST(rank AS VARCHAR) AS hog, length(c_name || c_mktsegment) AS seq_len FROM customer JOIN nation ON c_nationkey = n_nationkey "
    "JOIN (SELECT c_nationkey AS k, min(c_custkey) AS lo FROM customer GROUP BY 1) ON k = n_nationkey "
    "JOIN (SELECT c_mktsegment AS m, row_number() OVER (ORDER BY c_mktsegment) AS rank FROM customer GROUP BY 1) ON m = c_mktsegment WHERE n_regionkey < 3"
)
def browser_build(spark, sf_dir):
    """A database from the five browser tables: nations of three regions are
    genomes of the tree, customers entries, market segments groups."""
    n = table(spark, sf_dir, "nation")
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.concat(F.lit("C"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0"))
    genomes = c.groupBy("n_nationkey", "n_name").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi")).select(
        code.alias("code"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("")).alias("sci_name"), F.col("n_nationkey").alias("ncbi_id"),
        (F.col("lo") - 1).alias("entry_off"), (F.col("hi") - F.col("lo") + 1).alias("n_entries"), "n_name",
    )
    names = genomes.select(F.col("n_name"), F.when(F.col("sci_name") == "", F.col("code")).otherwise(F.col("sci_name")).alias("name"))
    entries = c.select(F.col("c_custkey").alias("entry_nr"), code.alias("code"), F.concat(F.lit("HOG:"), "c_mktsegment").alias("group"), F.concat("c_name", "c_mktsegment").alias("seq"))
    levels = c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_genes")).select(
        F.dense_rank().over(Window.orderBy("c_mktsegment")).cast("long").alias("fam"), F.concat(F.lit("HOG:"), "c_mktsegment").alias("id"), F.lit("all").alias("level"), F.lit(1.0).alias("completeness"), "n_genes",
    ).withColumn("ord", F.col("fam"))
    taxa = names.join(n, "n_name").filter("n_regionkey < 3").select("name", F.lit("all").alias("parent"), F.lit(1).alias("level"), F.array(F.lit("all"), F.col("name")).alias("path")).unionByName(
        spark.createDataFrame([("all", None, 0, ["all"])], "name string, parent string, level int, path array<string>"))
    db = engine.create_from_browser(spark, fresh_path(spark, "browser"), levels, genomes.drop("n_name"), entries, spark.createDataFrame([("all", 1)], "name string, ncbi_id int"), taxa)
    got = db.members.join(db.groups.select("hog_id", F.col("ext_id").alias("hog")), "hog_id").join(names.select(F.col("name").alias("species"), "n_name"), "species")
    return got.select("ext_id", F.col("n_name").alias("species"), "hog", "seq_len")


@query(f"SELECT doc_id, md5({RAW}) AS seq_md5, CAST(length({RAW}) AS BIGINT) AS n FROM documents")
def browser_sequences(spark, sf_dir):
    """Documents as entries of a sequence buffer, cut out of chunks that end
    in the middle of every sequence."""
    from .operators.shared import running_sum

    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_nr"), sq.sanitise(F.coalesce("text", F.lit(""))).alias("s")).withColumn("n", F.length("s").cast("long"))
    held = running_sum(d.withColumn("m", F.col("n") + 1), ["entry_nr"], "m", "end").withColumn("off", F.col("end") - F.col("m"))
    half = (F.col("n") / 2).cast("int")
    chunks = held.select(F.explode(F.array(
        F.struct(F.col("off").alias("start"), F.substring(F.col("s"), F.lit(1), half).alias("data")),
        F.struct((F.col("off") + half).alias("start"), F.concat(F.substring(F.col("s"), half + 1, F.length("s")), F.lit(" ")).alias("data")),
    )).alias("c")).select("c.*")
    got = browser.cut_sequences(held.select("entry_nr", "off", "n"), chunks)
    return got.select(F.col("entry_nr").alias("doc_id"), F.md5("seq").alias("seq_md5"), F.length("seq").cast("long").alias("n"))


@query("SELECT CAST(row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_name) - 1 AS BIGINT) AS row, c_nationkey AS fam, c_mktsegment AS id, c_name AS level FROM customer")
def level_table(spark, sf_dir):
    return build.level_table(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("fam"), F.col("c_mktsegment").alias("id"), F.col("c_name").alias("level")))


@query(
    "SELECT id, level, row FROM (SELECT CAST(row_number() OVER (ORDER BY c_nationkey, c_mktsegment, c_name) - 1 AS BIGINT) AS row, c_nationkey AS fam, c_mktsegment AS id, c_name AS level FROM customer) "
    "WHERE fam = (SELECT max(c_nationkey) FROM customer)"
)
def level_lookup(spark, sf_dir):
    """The levels of one family from the stored level table."""
    c = table(spark, sf_dir, "customer")
    path = fresh_path(spark, "levels")
    build.write_levels(c.select(F.col("c_nationkey").alias("fam"), F.col("c_mktsegment").alias("id"), F.col("c_name").alias("level")), path)
    return build.level_map(spark.read.parquet(path), c.agg(F.max("c_nationkey")).first()[0])


@query(
    "WITH d AS (SELECT coalesce(source, '?') AS f, coalesce(lang, '?') AS lang, CASE WHEN lang IN ('en', 'de') THEN 'north' ELSE 'west' END AS side FROM documents), "
    "b AS (SELECT side AS name, count(DISTINCT lang) AS n FROM d GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT lang) FROM d), "
    "r AS (SELECT f AS id, 'all' AS level, lang FROM d UNION ALL SELECT f || '.' || side, side, lang FROM d) "
    "SELECT id, level, count(*) AS n_genes, round(count(DISTINCT lang) / max(n), 9) AS completeness FROM r JOIN b ON name = level GROUP BY 1, 2"
)
def completeness_levels(spark, sf_dir):
    """Sizes and completeness of groups of three taxa."""
    side = F.when(F.col("lang").isin("en", "de"), F.lit("north")).otherwise(F.lit("west"))
    d = placed_documents(spark, sf_dir).withColumn("side", side)
    both = lambda top, low: F.explode(F.array(F.struct(F.lit("all").alias("level"), top.alias("id")), F.struct(F.col("side").alias("level"), low.alias("id"))))
    rows = d.select("doc_id", "lang", both(F.col("f"), F.concat_ws(".", "f", "side")).alias("g")).select(
        F.lit(1).alias("fam"), "g.id", "g.level", F.lit(0).alias("ord"), F.col("doc_id").alias("gene"), F.col("lang").alias("species")
    )
    below = rows.groupBy(F.col("level").alias("name")).agg(F.count_distinct("species").alias("n_below"))
    return build.group_sizes(rows, below).select("id", "level", "n_genes", F.round("completeness", 9).alias("completeness"))


@query("SELECT f AS family, depth, n FROM (SELECT DISTINCT source AS f FROM documents) JOIN (SELECT source AS s, unnest([1, 2, 3]) AS depth, unnest([1, count(DISTINCT lang), count(DISTINCT lang || doc_id % 3)]) AS n FROM documents GROUP BY 1) ON s = f")
def level_sizes(spark, sf_dir):
    g = settle(bound_groups(spark, sf_dir), "groups")
    return build.level_sizes(g).join(g.filter("parent is null").select("fam_id", F.col("ext_id").alias("family")), "fam_id").select("family", "depth", "n")


@query(f"WITH {LEVELS}, old AS (SELECT fam, root, row_number() OVER (ORDER BY fam, root) AS fam_id FROM good WHERE fam % 7 <> 0) SELECT CAST(o.fam_id AS INT) AS fam_id, id AS source_id FROM rows r JOIN old o USING (fam, root) WHERE inside")
def oldest_families(spark, sf_dir):
    """Root groups at the root taxon only."""
    levels, taxa = bound_levels(spark, sf_dir)
    got = build.select_groups(levels, taxa, min_size=15, min_completeness=0.5, logic="AND", root_taxon="all", include_younger=False)
    return got.select("fam_id", "source_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS ref, n_name AS xref FROM nation")
def reference_file(spark, sf_dir):
    path = fresh_path(spark, "references")
    rows = table(spark, sf_dir, "nation").select(F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("x"))
    rows.unionByName(spark.createDataFrame([("# a comment",)], "x string")).write.text(path)
    return orthoxml.read_references(spark, path)


@query("SELECT CAST(item_id AS VARCHAR) AS qseqid, CAST(NULL AS VARCHAR) AS hogid, CAST(NULL AS BIGINT) AS family_count, CAST(7 + item_id % 5 AS BIGINT) AS qseqlen FROM benchmark")
def search_of_unknowns(spark, sf_dir):
    """Queries of X alone have their row and no place."""
    b = bound(spark, sf_dir)
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ord"), F.col("item_id").cast("string").alias("qseqid"), F.expr("repeat('X', cast(6 + item_id % 5 as int))").alias("seq"))
    found = srch.search(q, b.postings, b.groups, b.family_prob, K)
    return found.select("qseqid", "hogid", F.col("family_count").cast("long").alias("family_count"), F.col("qseqlen").cast("long").alias("qseqlen"))


@query(f"SELECT doc_id, regexp_replace(translate({_ASCII}, 'STNQYVRM', 'AADEFIKL'), '[^ACDEFGHIKLPWX]', 'X', 'g') AS seq FROM documents")
def sanitise_reduced(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sq.sanitise(F.coalesce("text", F.lit("")), True).alias("seq"))


@query(
    "WITH g AS (SELECT DISTINCT source || '.' || lang || '.b' || (doc_id % 3) AS h FROM documents), t AS (SELECT DISTINCT source || '.en' AS top FROM documents UNION SELECT DISTINCT source FROM documents) "
    "SELECT h AS id, top FROM g JOIN t ON h = top OR starts_with(h, top || '.')"
)
def is_descendant(spark, sf_dir):
    d = placed_documents(spark, sf_dir)
    lower, tops = d.select(F.col("h").alias("id"), F.col("f")).distinct(), d.select(F.col("f"), F.explode(F.array(F.col("f"), F.concat("f", F.lit(".en")))).alias("top")).distinct()
    return lower.join(tops, "f").filter(ids.is_descendant(F.col("id"), F.col("top"))).select("id", "top")


# ---------------------------------------------------------------- deep forests, files in ranges, checks


#: Customers of a nation in chains of a hundred, each below the one before.
DEEP = """
o AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS bal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM customer),
t AS (SELECT id, nation, i // 100 AS chain, i, bal, CASE WHEN bal > 0 THEN CAST(floor(bal) AS BIGINT) % 9 + 1 END AS n FROM o)"""


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hog_id, path, bal, n (null: without a count) of DEEP."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("hog_id"), "c_nationkey", F.col("c_acctbal").alias("bal"))
    placed = c.withColumn("i", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("hog_id")) - 1).withColumn("chain", F.floor(F.col("i") / 100))
    line = Window.partitionBy("c_nationkey", "chain").orderBy("i")
    count = F.when(F.col("bal") > 0, F.floor("bal").cast("long") % 9 + 1)
    return settle(placed.select("hog_id", F.collect_list("hog_id").over(line).alias("path"), "bal", count.alias("n")), "chains")


@query(
    f"WITH {DEEP}, p AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY nation, chain ORDER BY i), 0) AS upto FROM t), "
    "m AS (SELECT *, max(CASE WHEN n IS NOT NULL THEN upto END) OVER (PARTITION BY nation, chain ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS top FROM p) "
    "SELECT id, CAST(upto - coalesce(n, 0) AS BIGINT) AS before, CAST(top - (upto - coalesce(n, 0)) AS BIGINT) AS cum FROM m WHERE top IS NOT NULL"
)
def deep_chains(spark, sf_dir):
    """Heaviest chains where groups lie up to a hundred deep."""
    g = chains(spark, sf_dir)
    counts = g.filter("n is not null").select(F.lit(1).alias("one"), "hog_id", "n")
    return index.heaviest_chains(counts, g, ["one"]).select(F.col("hog_id").cast("int").alias("id"), "before", "cum")


@query(
    f"WITH {DEEP} SELECT id, CAST(floor(median(CAST(floor(abs(bal)) AS BIGINT)) OVER (PARTITION BY nation, chain ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS BIGINT) AS median FROM t"
)
def deep_medians(spark, sf_dir):
    """Medians of whole amounts at or below each customer of such chains."""
    g = chains(spark, sf_dir)
    members = g.select("hog_id", F.floor(F.abs("bal")).cast("int").alias("seq_len"))
    return build.median_lengths(members, g).select(F.col("hog_id").cast("int").alias("id"), F.col("median_seqlen").cast("long").alias("median"))


@query(f"SELECT CAST(doc_id AS VARCHAR) AS id, md5({RAW}) AS seq_md5, CAST(length({RAW}) AS BIGINT) AS n FROM documents")
def fasta_ranges(spark, sf_dir):
    """Documents as records of compressed files, read back in ranges of 16 KB."""
    path = fresh_path(spark, "records")
    table(spark, sf_dir, "documents").select(F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" document\n"), sq.sanitise(F.coalesce("text", F.lit("")))).alias("value")).write.option("compression", "gzip").text(path)
    return fasta.read_fasta(spark, path, split=16 << 10).select("id", F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("seq").cast("long").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS prot_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unmatched_members(spark, sf_dir):
    """Documents without a label, as members that no record matches by its
    header or its first word (every second label names itself by the latter)."""
    members = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("prot_id"))
    name = F.col("doc_id").cast("string")
    records = table(spark, sf_dir, "labels").select(name.alias("id"), F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(name, F.lit(" label"))).alias("header"), F.lit("A").alias("seq"))
    return build.match_sequences(members, records).filter("seq is null")[["prot_id"]]


@query(f"WITH {TREE}, l AS (SELECT path FROM tree t WHERE NOT EXISTS (SELECT 1 FROM tree x WHERE x.path LIKE t.path || ' %')) SELECT count(*) AS n FROM l WHERE NOT (path || ' ' LIKE '% n3 %' OR path || ' ' LIKE 'r1 %')")
def indexed_species(spark, sf_dir):
    """The leaves that stay visible when a nation and a region are hidden."""
    t = named_tree(spark, sf_dir)
    hidden = build.hidden_species(t, ["n3", "r1"])
    return spark.range(1).select(F.lit(build.visible_species(t, hidden)).cast("long").alias("n"))


def named_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(hierarchy.with_paths(customer_tree(spark, sf_dir)).withColumnRenamed("id", "name"), "tree")


@query(f"WITH {TREE} SELECT id AS name, CASE WHEN depth = 2 THEN 'r2' WHEN depth = 3 THEN split_part(path, ' ', 2) END AS parent, CAST(depth AS BIGINT) AS depth FROM tree WHERE path = 'r2' OR path LIKE 'r2 %'")
def pruned_tree(spark, sf_dir):
    """The forest below a root taxon, which loses its parent."""
    t = build.prune(named_tree(spark, sf_dir), "r2")
    return t.select("name", F.when(F.col("name") != "r2", F.col("parent")).alias("parent"), F.size("path").cast("long").alias("depth"))
