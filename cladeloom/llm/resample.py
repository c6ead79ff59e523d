"""Resampling towards a target distribution by importance of hashed features.

Features are all runs of `least` to `most` consecutive words (A-Z
lower-cased), joined by a space. A bucket's gain is the log ratio of the
target's and the corpus's smoothed shares; a document's weight is the floored
mean of its features' gains; Gumbel noise drawn from the document's id turns
the highest scores into a sample without replacement.

Method: a dictionary of distinct features.

* Each task counts the features of its documents in blocks of about
  BLOCK_BYTES of text: a block's distinct features stand once in the table of
  words, and its documents refer to them by their number in the block.
* The dictionary sums the words table by feature; each distinct string is
  hashed once (CRC-32 of its UTF-8 bytes), and buckets are aggregated over the
  dictionary. Only the buckets (a parameter, 10000) are broadcast.
* A gain goes back from the dictionary to each block that holds the feature,
  and is multiplied there with the documents' own counts.

So the corpus is shuffled as distinct features of blocks, not as words or as
distinct features of documents. Features of many blocks stay where they are in
the join (`join_hot`). A text beyond PIECE bytes is counted in parts.

Defined cases: null text has no words; a document without features has weight
0 and no part in the draw unless min_words is 0; rows that repeat an id are
documents of their own with the same noise, ties after the id in any order; a
null id has the noise of the empty string and comes before other ids; an empty
corpus gives an empty result, an empty target a gain from smoothing alone;
further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.shared import number_rows
from .common import as_bytes, join_hot, materialise, pieces
from .decontam import words

LEAST, MOST = 1, 1
BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10

BLOCK_BYTES = 16 << 20
PIECE = 4 << 20



KINDS = {"long": T.LongType(), "int": T.IntegerType(), "binary": T.BinaryType()}
TABLE = {"block": "long", "row": "long", "n_words": "long", "n_features": "long", "ids": "binary", "counts": "binary", "n_ids": "int", "word": "binary", "number": "int", "n": "long"}


def parts(raw: bytes, most: int, limit: int = PIECE) -> Iterator[tuple[list[bytes], int]]:
    """The words of a text in parts, each with the words before it that its
    features may begin in, and how many those are."""
    before: list[bytes] = []
    for piece in pieces(raw, limit):
        own = words(piece)
        yield before + own, len(before)
        before = (before + own)[-(most - 1):] if most > 1 else []


def grams(ws: list[bytes], known: int, least: int, most: int) -> Counter:
    """Runs of least to most words that end after the first `known` words."""
    if most == 1:
        return Counter(ws)
    found: Counter = Counter()
    for n in range(least, most + 1):
        found.update(b" ".join(ws[i - n : i]) for i in range(max(n, known + 1), len(ws) + 1))
    return found


def counted(docs: DataFrame, least: int, most: int, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame]:
    """(block, row, id, n_words, n_features, ids, counts, n_ids) of docs(row,
    id, text), and (block, word, number, n) of each block's distinct features."""
    like = T.StructType([T.StructField(n, KINDS[t]) for n, t in TABLE.items()] + [T.StructField("id", docs.schema["id"].dataType)])
    schema = to_arrow_schema(like)

    def batch_of(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        number: dict[bytes, int] = {}
        total = np.zeros(0, np.int64)
        rows: list[tuple] = []
        size = held = 0

        def tell() -> Iterator[pa.RecordBatch]:
            if rows:
                columns = list(zip(*rows))
                yield batch_of(len(rows), block=pa.array([block] * len(rows), pa.int64()), **{f.name: pa.array(c, f.type) for f, c in zip([*list(schema)[1:7], schema.field("id")], columns)})

        def words_of() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(names := list(number)), 50_000):
                part = names[i : i + 50_000]
                yield batch_of(len(part), block=pa.array([block] * len(part), pa.int64()), word=pa.array(part, pa.binary()), number=pa.array(range(i, i + len(part)), pa.int32()), n=pa.array(total[i : i + len(part)]))

        for batch in batches:
            for row, name, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), as_bytes(batch.column("text"))):
                for ws, known in parts(text.as_py(), most):
                    c = grams(ws, known, least, most)
                    ids = np.fromiter((number.setdefault(w, len(number)) for w in c), np.uint32, len(c))
                    n = np.fromiter(c.values(), np.uint32, len(c))
                    if len(number) > len(total):
                        total = np.append(total, np.zeros(max(len(number), 1024), np.int64))
                    total[ids] += n
                    order = np.argsort(ids)
                    ids, n = ids[order], n[order]
                    rows.append((row, len(ws) - known, int(n.sum()), ids.tobytes(), n.astype(np.uint8 if not len(n) or n.max() < 256 else np.uint32).tobytes(), len(n), name))
                    held += 5 * len(n) + 64
                    size += sum(map(len, ws)) + len(ws)
                    if held > 2 << 20:
                        yield from tell()
                        rows, held = [], 0
                    if size > block_bytes:
                        yield from tell()
                        yield from words_of()
                        block, number, total, rows, size, held = block + 1, {}, np.zeros(0, np.int64), [], 0, 0
        yield from tell()
        yield from words_of()

    both = materialise(docs.mapInArrow(run, like), "features", compression="zstd")
    return both.filter("word is null").select("block", "row", "id", "n_words", "n_features", "ids", "counts", "n_ids"), both.filter("word is not null").select("block", "word", "number", "n")


def dictionary(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """word, gain, blocks (of the corpus that hold it), from the words tables."""
    each = corpus.select("word", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), F.lit(1).cast("long").alias("blocks")).unionByName(
        target.select("word", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).cast("long").alias("blocks"))
    )
    known = each.groupBy("word").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("blocks").alias("blocks"))
    known = materialise(known.withColumn("bucket", (F.crc32("word") % buckets).cast("int")), "dictionary")
    by_bucket = materialise(known.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "buckets")
    whole = by_bucket.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    over = (F.col("t") + 1).cast("double") * F.lit(float((whole.s or 0) + buckets))
    under = (F.col("s") + 1).cast("double") * F.lit(float((whole.t or 0) + buckets))
    gains = by_bucket.select("bucket", F.floor(F.lit(1000.0) * F.log(over / under)).cast("int").alias("gain"))
    return known.filter("blocks > 0").join(F.broadcast(gains), "bucket").select("word", "gain", "blocks")


def _weighed(docs: pa.Table, gains: pa.Table) -> pa.Table:
    gain = np.zeros((pc.max(gains.column("number")).as_py() + 1) if gains.num_rows else 0, np.int64)
    gain[gains.column("number").to_numpy()] = gains.column("gain").to_numpy()
    sums = []
    for ids, counts, n in zip(docs.column("ids"), docs.column("counts"), docs.column("n_ids").to_pylist()):
        c = counts.as_buffer()
        own = np.frombuffer(c, np.uint8 if len(c) == n else np.uint32).astype(np.int64)
        sums.append(int((gain[np.frombuffer(ids.as_buffer(), np.uint32)] * own).sum()) if n else 0)
    return pa.table([docs.column("row"), docs.column("id"), docs.column("n_words"), docs.column("n_features"), pa.array(sums, pa.int64())], names=["row", "id", "n_words", "n_features", "total"])


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a SHA-256."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(named, "UTF-8"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, buckets: int = BUCKETS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight, and a number of its own as row."""
    if not 1 <= least <= most:
        raise ValueError(f"runs of {least} to {most} words are not possible")
    numbered = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    own, corpus = counted(numbered, least, most, block_bytes)
    _, wanted = counted(target.select(F.monotonically_increasing_id().alias("row"), F.lit(None).cast("long").alias("id"), F.col("text")), least, most, block_bytes)
    known = dictionary(corpus, wanted, buckets)
    known = materialise(known, "gains")
    answers = join_hot(corpus.select(F.col("block").alias("at"), "word", "number"), known, ["word"], "blocks", corpus.count()).select("at", "number", "gain")
    like = own.selectExpr("row", "id", "n_words", "n_features", "0L as total").schema
    sums = own.groupBy("block").cogroup(answers.groupBy("at")).applyInArrow(_weighed, like)
    by_row = sums.groupBy("row").agg(F.first("id").alias(id_col), *(F.sum(c).alias(c) for c in ("n_words", "n_features", "total")))
    weight = F.when(F.col("n_features") > 0, F.floor(F.col("total") / F.col("n_features"))).otherwise(0).cast("long")
    return by_row.select(id_col, "n_words", "n_features", weight.alias("weight"), "row")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, **options) -> DataFrame:
    """One row per row of docs: id, n_words, n_features, weight, score, rank.
    rank numbers the drawn documents from 1, best first; others have none."""
    weighed = weigh(docs, target, id_col, text_col, **options)
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)), "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    quota = able.count() * percent // 100
    ranked = number_rows(able, [F.col("score").desc(), F.col(id_col).asc_nulls_first(), F.col("row")], "rank", 1)
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")).cast("long"))
    return ranked.unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))).select(id_col, "n_words", "n_features", "weight", "score", "rank")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
per AS (SELECT r, word, count(*) AS n FROM (SELECT r, unnest(w) AS word FROM dw) GROUP BY 1, 2),
each AS (SELECT word, n AS s, 0 AS t FROM per UNION ALL SELECT word, 0, count(*) FROM (SELECT unnest(w) AS word FROM bw) GROUP BY 1),
known AS (SELECT word, sum(s) AS s, sum(t) AS t FROM each GROUP BY 1),
crc AS (SELECT list_transform(range(256), lambda i: CAST(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT)) AS t),
hexed AS (SELECT word, hex(encode(word)) AS h FROM known),
bytes AS (SELECT word, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS b FROM hexed),
hashed AS (SELECT word, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) + 1 AS INT)]))) % 10000 AS bucket FROM bytes, crc),
buckets AS (SELECT bucket, sum(s) AS s, sum(t) AS t FROM known JOIN hashed USING (word) GROUP BY 1),
whole AS (SELECT sum(s) AS s, sum(t) AS t FROM known),
gains AS (SELECT bucket, floor(1000 * ln(CAST(b.t + 1 AS DOUBLE) * CAST(w.s + 10000 AS DOUBLE) / (CAST(b.s + 1 AS DOUBLE) * CAST(w.t + 10000 AS DOUBLE)))) AS gain FROM buckets b, whole w),
sums AS (SELECT r, sum(n * gain) AS total FROM per JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY 1),
weighed AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, CASE WHEN len(w) > 0 THEN CAST(floor(total / len(w)) AS BIGINT) ELSE 0 END AS weight,
              CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM dw LEFT JOIN sums USING (r)),
scored AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
