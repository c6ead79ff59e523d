"""Exact dedup with a log-structured merge index of text digests.

* memtable and flush: each input task digests its own rows and writes them as
  a run sorted by digest, whose Parquet footer holds min/max statistics and a
  Bloom filter on the digest; nothing is shuffled. Beside each digest stands
  its cell, a 40-bit fingerprint: the column of cells is the run's filter.
* probe: a digest whose cell no other row has is new, whatever the runs hold.
  Only rows of cells that several rows have are looked at further, by digest.
* compaction: FANOUT runs of a level are merged into one of the next level; of
  each digest the winning row (most code points, then smallest identifier,
  then first written) and the number of rows stay. Equal digests are combined
  in each task before they are shuffled. Runs are numbered for the life of
  the index, so a number names one run only.
* byte verification: of each digest that several rows hold - a hit - the least
  and the greatest normalised text must be the same bytes; only the texts of
  hits are read for it. A digest that fails is split by its text.

Everything is DataFrame functions; joins keep the rows of a digest with a
large share of all rows where they are. Defined cases: null text counts as
empty; empty texts equal each other; a row repeated with the same id is a copy
like any other, and exactly one of the copies is kept; a null id is the
smallest id; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILTER_BITS, join_hot, keep_rows, materialise, scratch_path, text_tag

#: The six ASCII white-space characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"
#: Bits of the filter of hits that is broadcast, at most (2 to the 20th words).


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))


class Run(NamedTuple):
    level: int
    number: int
    path: str


class DigestIndex:
    """A log-structured merge index under `path`: one folder per flush or
    compaction. Rows of a run: digest, cell, best(less, id, run, row), rows."""

    #: Runs of one level that are merged into a run of the next.
    FANOUT = 4

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "lsm")
        self.runs: list[Run] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> Run:
        run = Run(level, self.made, f"{self.path}/level={level}/run={self.made:06d}")
        rows.sortWithinPartitions("digest").write.option("parquet.bloom.filter.enabled#digest", "true").parquet(run.path)
        self.made += 1
        return run

    def _read(self, runs: list[Run]) -> DataFrame:
        parts = [self.spark.read.parquet(r.path).select("digest", "cell", "best", "rows") for r in runs]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        return every

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: bool = False) -> DataFrame:
        """Digest docs into new runs of level 0, with the tag of the unchanged
        text too if asked for; returns those runs' rows, one per row of docs."""
        rows = docs.select(
            digest_of(normalised(F.col(text_col))).alias("digest"),
            F.struct(
                (-F.coalesce(F.length(text_col), F.lit(0))).alias("less"), F.col(id_col).alias("id"), F.lit(self.made).alias("run"), F.monotonically_increasing_id().alias("row")
            ).alias("best"),
            F.lit(1).cast("long").alias("rows"),
            *([text_tag(F.col(text_col)).alias("tag")] if tag else []),
        ).withColumn("cell", F.shiftrightunsigned(F.xxhash64("digest"), 24))
        self.runs.append(self._write(rows, 0))
        return self.spark.read.parquet(self.runs[-1].path)

    def _merged(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.first("cell").alias("cell"), F.min("best").alias("best"), F.sum("rows").alias("rows"))

    def compact(self) -> None:
        """Merge the runs of each level that has FANOUT of them."""
        level = 0
        while any(r.level >= level for r in self.runs):
            here = [r for r in self.runs if r.level == level]
            if len(here) >= self.FANOUT:
                merged = self._write(self._merged(self._read(here)), level + 1)
                self.runs = [r for r in self.runs if r.level != level] + [merged]
            level += 1

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Flush a batch and compact; returns the batch's rows (digest, best)
        whose digest an earlier batch already held. The filters are probed
        before any run is."""
        before = list(self.runs)
        new = self.flush(docs, id_col, text_col)
        if not before:
            seen = new.select("digest", "best").limit(0)
        else:
            cells = new.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
            maybe = self._read(before).join(cells.select("cell"), "cell", "left_semi").select("digest").distinct()
            held = maybe.join(new.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), "digest")
            seen = join_hot(new.select("digest", "best"), held, ["digest"], "n", new.count()).select("digest", "best")
        seen = materialise(seen, "seen")  # before its runs are merged away
        self.compact()
        return seen

    def level(self) -> DataFrame:
        """digest, cell, best, rows of all that was inserted."""
        return self._merged(self._read(self.runs))

    def hits(self) -> DataFrame:
        """digest, best, rows of the digests that several rows hold. Rows
        whose cell is theirs alone are never grouped by digest."""
        rows = self._read(self.runs)
        cells = rows.groupBy("cell").agg(F.sum("rows").alias("of"), F.count(F.lit(1)).alias("n")).filter("of > 1")
        maybe = join_hot(rows, cells.select("cell", "n"), ["cell"], "n", rows.count())
        return self._merged(maybe).filter("rows > 1").select("digest", "best", "rows")


def among(rows: DataFrame, hits: DataFrame, number: int) -> DataFrame:
    """The rows whose digest may be one of the `number` hits: a Bloom filter
    of 16 bits for each hit, FILTER_BITS at most, is broadcast in words of 64
    bits, so that the other rows are left out where they stand. Nothing that
    is a hit is left out; a full filter only lets more pass."""
    bits = min(FILTER_BITS, max(64, 16 * number))
    place = F.pmod(F.xxhash64("digest"), F.lit(bits))
    words = hits.select((place / 64).cast("long").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    return rows.withColumn("word", (place / 64).cast("long")).join(F.broadcast(words), "word").filter(F.getbit("bits", (place % 64).cast("int")) == 1).drop("word", "bits")


def suspects(docs: DataFrame, hits: DataFrame, number: int, text_col: str = "text") -> DataFrame:
    """Hits whose rows are not all the same bytes. The aggregate combines
    equal digests in each map task before anything is shuffled."""
    texts = docs.select(normalised(F.col(text_col)).alias("norm")).select(digest_of(F.col("norm")).alias("digest"), "norm")
    held = among(texts, hits, number)
    return held.groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high")).filter("low <> high").select("digest")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tag: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256
    (and the unchanged text's tag, if asked for)."""
    index = DigestIndex(docs.sparkSession)
    run = index.flush(docs, id_col, text_col, tag)
    more = ["tag"] if tag else []
    hits, total = materialise(index.hits(), "hits"), run.count()
    bad = materialise(suspects(docs, hits, hits.count(), text_col), "suspects")
    found = join_hot(run.select("digest", F.col("best").alias("own"), *more), hits, ["digest"], "rows", total, how="left")
    rows = found.select(
        F.col("own.id").alias(id_col),
        F.when(F.col("rows").isNull(), F.col("own.id")).otherwise(F.col("best.id")).alias("keep_id"),
        F.coalesce("rows", F.lit(1)).cast("long").alias("group_size"),
        (F.col("rows").isNull() | (F.col("best.row") == F.col("own.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        *more,
        "digest",
    )
    if bad.isEmpty():
        return rows.drop("digest")
    # A true collision: those rows are grouped by digest and text instead.
    norm = normalised(F.col(text_col))
    split = docs.select(
        F.col(id_col).alias("id"), norm.alias("norm"), F.coalesce(F.length(text_col), F.lit(0)).alias("points"),
        digest_of(norm).alias("digest"), F.monotonically_increasing_id().alias("row"),
        *([text_tag(F.col(text_col)).alias("tag")] if tag else []),
    ).join(bad, "digest", "left_semi")
    split = materialise(split, "collided")
    best = split.groupBy("digest", "norm").agg(
        F.min(F.struct((-F.col("points")).alias("less"), "id", "row")).alias("best"), F.count(F.lit(1)).alias("rows")
    )
    fixed = split.join(best, ["digest", "norm"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("best.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), *more,
    )
    return rows.join(bad, "digest", "left_anti").drop("digest").unionByName(fixed)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decisions = assign(docs, id_col, text_col, tag=True)
    verdict = decisions.groupBy(F.col(id_col).alias("id"), "tag").agg(
        F.sum(F.col("kept").cast("long")).alias("stay"), F.count(F.lit(1)).alias("rows")
    )
    return keep_rows(docs, materialise(verdict, "exact"), id_col, text_col)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
