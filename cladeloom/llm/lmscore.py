"""Stupid-backoff language-model scores of documents under counts of the
whole corpus, computed relationally.

    S(w | context) = c(context w) / c(context)       if c(context w) >= min_count
                   = alpha * S(w | shorter context)  otherwise
    S(w)           = c(w) / N

A word is a run of non-blank characters, A-Z lower-cased; contexts do not
cross documents; a word that has fewer words before it than the order asks
for starts at the order it has. The score is the sum of ln S.

The relations are kept in packed rows, because a row for each of the corpus's
n-grams (several for each word) would take many times the input in shuffles:

* documents are dealt into blocks; a block's n-grams of all orders, exploded
  and grouped, become one row per hash bucket: sorted hashes and counts;
* a bucket is a partition of the count table: the rows of all blocks for it
  are summed by hash, and each block's row is answered by a row of totals;
* blocks meet their answers and each document's logarithms are summed.

An n-gram reaches its bucket once per block, so frequent words make no hot
partition. Blocks and buckets have a fixed size and their number grows with
the input; partitions take them in turn, one each up to MAX_PARTS. N-grams are known
by 64 bits of hash: of n distinct ones about n^2 / 2^65 pairs share a count
(0.0003 expected for the 10^8 n-grams of half a GB of Parquet, one in four
million n-grams for 10^13).

Defined cases: null and empty texts have no words and score 0; repeated rows
count as often as they stand and are scored each; a text of any length is
split into words in parts of bounded size; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, materialise, pieces, slices

ORDER = 3
ALPHA = 0.4
MIN_COUNT = 2
BLOCK_BYTES = 6 << 20
BUCKET_BYTES = 8 << 20
CHUNK_WORDS = 1 << 20
MAX_PARTS = 1 << 15
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def chunks(texts: list[bytes], order: int, limit: int = CHUNK_WORDS) -> Iterator[list[tuple[int, int, list[bytes]]]]:
    """Lists of (text number, lead, words) of about `limit` words. The lead
    words stand before a text's later parts and are context only."""
    held, size = [], 0
    for i, raw in enumerate(texts):
        lead: list[bytes] = []
        for piece in pieces(raw):
            w = piece.lower().split()
            for at in range(0, len(w), limit):
                part = lead + w[at : at + limit]
                held.append((i, len(lead), part))
                size += len(part)
                lead = part[1 - order :] if order > 1 else []
                if size >= limit:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def ngrams(chunk: list[tuple[int, int, list[bytes]]], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Text number and weight (0: lead) of each word; for n = 1 .. order the
    hash of the n-gram that ends at each word, and whether there is one."""
    import xxhash

    sizes = [len(w) for _, _, w in chunk]
    h = np.fromiter((x for _, _, w in chunk for x in map(xxhash.xxh3_64_intdigest, w)), np.uint64, sum(sizes))
    text = np.repeat([i for i, _, _ in chunk], sizes)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    place = np.arange(len(h)) - np.repeat(starts, sizes)
    weight = (place >= np.repeat([lead for _, lead, _ in chunk], sizes)).astype(np.int64)
    hashes, there = [], []
    for n in range(1, order + 1):
        g = np.full(len(h), n * 0x5851F42D4C957F2D & (1 << 64) - 1, np.uint64)
        for back in range(n):
            g[back:] += h[: len(h) - back] * _ODD[back % len(_ODD)] if back else h * _ODD[0]
            g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(32)
        hashes.append(g)
        there.append(place >= n - 1)
    return text, weight, hashes, there


def pack_counts(values: np.ndarray) -> bytes:
    """One byte for a number below 255; the others follow as 8 bytes each."""
    small = np.where(values < 255, values, 255).astype(np.uint8)
    return small.tobytes() + values[values >= 255].astype("<u8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    large = np.flatnonzero(out == 255)
    out[large] = np.frombuffer(raw, "<u8", len(large), n).astype(np.int64)
    return out


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending 64-bit numbers: how many, the low 5 bytes of each, and the
    compressed steps of the high 3 bytes (about 5.7 bytes each in all)."""
    import zstandard

    steps = np.diff((keys >> np.uint64(40)).astype(np.int64), prepend=0)
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    return struct.pack("<I", len(keys)) + low.tobytes() + zstandard.compress(pack_counts(steps), 1)


def unpack_keys(raw: bytes) -> np.ndarray:
    import zstandard

    (n,) = struct.unpack_from("<I", raw)
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :5] = np.frombuffer(raw, np.uint8, 5 * n, 4).reshape(n, 5)
    high = np.cumsum(unpack_counts(zstandard.decompress(raw[4 + 5 * n :]), n)).astype(np.uint64)
    return (high << np.uint64(40)) | whole.view("<u8").ravel()


def grouped(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of own, its distinct values, and the place among those of
    each value in order. (Sorting beats searching each value in a table.)"""
    order = np.argsort(own)
    s = own[order]
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return order, s[new], np.cumsum(new) - 1


def _cuts(table: np.ndarray, bits: int) -> np.ndarray:
    return np.searchsorted(table, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.int64)


def _asked(order: int, bits: int, table: pa.Table) -> pa.Table:
    import zstandard

    table = table.sort_by("row")  # chunks depend on the order, which a shuffle does not keep
    block = table.column("block")[0].as_py()
    out, z = [], zstandard.ZstdCompressor(level=1)
    for number, chunk in enumerate(chunks(_texts(table), order)):
        _, weight, hashes, there = ngrams(chunk, order)
        own = np.concatenate([h[t] for h, t in zip(hashes, there)])
        if weight.all():
            own.sort()
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            keys, counts = own[first], np.diff(np.append(first, len(own)))
        else:
            at, keys, where = grouped(own)
            counts = np.bincount(where, weights=np.concatenate([weight[t] for t in there])[at]).astype(np.int64)
        cuts = [0, *_cuts(keys, bits).tolist(), len(keys)]
        out += [(block, number, b, zlib.crc32(keys[i:j]), pack_keys(keys[i:j]), z.compress(pack_counts(counts[i:j]))) for b, (i, j) in enumerate(zip(cuts, cuts[1:])) if j > i]
    cols = list(zip(*out)) or [[]] * 6
    types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "chunk", "bucket", "mark", "keys", "counts"])


def _answered(table: pa.Table) -> pa.Table:
    import zstandard

    keys = [unpack_keys(k.as_py()) for k in table.column("keys")]
    sizes = [len(k) for k in keys]
    counts = np.concatenate([unpack_counts(zstandard.decompress(c.as_py()), n) for c, n in zip(table.column("counts"), sizes)])
    at, _, where = grouped(np.concatenate(keys))
    total = np.empty(len(at), np.int64)
    total[at] = np.bincount(where, weights=counts[at]).astype(np.int64)[where]
    edges, z = np.concatenate(([0], np.cumsum(sizes))), zstandard.ZstdCompressor(level=1)
    return table.select(["block", "chunk", "bucket", "mark"]).append_column("totals", pa.array([z.compress(pack_counts(total[i:j])) for i, j in zip(edges, edges[1:])], pa.binary()))


def _scored(order: int, bits: int, alpha: float, least: int, docs: pa.Table, answers: pa.Table) -> pa.Table:
    import zstandard

    docs = docs.sort_by("row")
    n = docs.num_rows
    part, uni, number = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    by: dict[int, list[tuple[int, int, bytes]]] = {}
    for chunk, *answer in zip(*(answers.column(c).to_pylist() for c in ("chunk", "bucket", "mark", "totals"))):
        by.setdefault(chunk, []).append(tuple(answer))
    for at, chunk in enumerate(chunks(_texts(docs), order)):
        text, weight, hashes, there = ngrams(chunk, order)
        sorted_at, keys, where = grouped(np.concatenate([h[t] for h, t in zip(hashes, there)]))
        cuts = [0, *_cuts(keys, bits).tolist(), len(keys)]
        total = np.zeros(len(keys), np.int64)
        for bucket, mark, raw in by.get(at, []):
            i, j = cuts[bucket], cuts[bucket + 1]
            if zlib.crc32(keys[i:j]) != mark:
                raise ValueError("an answer does not belong to this chunk")
            total[i:j] = unpack_counts(zstandard.decompress(raw), j - i)
        flat = np.empty(len(sorted_at), np.int64)
        flat[sorted_at] = total[where]
        c, begin = [], 0
        for t in there:
            have = int(np.count_nonzero(t))
            full = np.zeros(len(text), np.int64)
            full[t] = flat[begin : begin + have]
            c.append(full)
            begin += have
        s, open_, only_uni = np.zeros(len(text)), np.ones(len(text), bool), np.zeros(len(text), bool)
        for m in range(order, 0, -1):
            here = open_ & there[m - 1] & ((c[m - 1] >= least) if m > 1 else True)
            s[here] += np.log(c[m - 1][here])
            if m > 1:
                s[here] -= np.log(np.concatenate(([1], c[m - 2][:-1]))[here])
            else:
                only_uni = here
            open_ &= ~here
            if m > 1:
                s[open_ & there[m - 1]] += np.log(alpha)
        real = weight > 0
        part += np.bincount(text[real], weights=s[real], minlength=n)
        uni += np.bincount(text[real & only_uni], minlength=n)
        number += np.bincount(text[real], minlength=n)
    return docs.select(["id"]).append_column("n_words", pa.array(number)).append_column("part", pa.array(part)).append_column("n_single", pa.array(uni))


def _texts(table: pa.Table) -> list[bytes]:
    import zstandard

    return [zstandard.decompress(x.as_py()) for x in table.column("packed")]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the one shuffle that deals them into blocks."""
    import zstandard

    z = zstandard.ZstdCompressor(level=3)
    for batch in slices(batches, "text", 4 << 20):
        small = [z.compress(x) for x in as_bytes(batch.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("row"), batch.column("block"), pa.array(small, pa.binary())], names=["id", "row", "block", "packed"])


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, min_count: int = MIN_COUNT,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """id, n_words, log_score, mean_log_score for each row of docs."""
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    bits = max(0, (-(-total // bucket_bytes) - 1).bit_length())
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row")
    ).withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks)).cast("int"))
    dealt = rows.mapInArrow(_packed, rows.selectExpr("id", "row", "block", "binary('') as packed").schema).repartitionById(min(blocks, MAX_PARTS), F.col("block"))

    def ask(table: pa.Table) -> pa.Table:
        return _asked(order, bits, table)

    def add_up(docs: pa.Table, answers: pa.Table) -> pa.Table:
        return _scored(order, bits, alpha, min_count, docs, answers)

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, chunk int, bucket int, mark long, keys binary, counts binary")
    answers = asked.repartitionById(min(1 << bits, MAX_PARTS), F.col("bucket")).groupBy("bucket").applyInArrow(_answered, "block int, chunk int, bucket int, mark long, totals binary").repartitionById(min(blocks, MAX_PARTS), F.col("block"))
    schema = dealt.selectExpr("id", "0L as n_words", "0D as part", "0L as n_single").schema
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, schema)
    parts = materialise(found, "scores")
    n = parts.agg(F.sum("n_words")).first()[0] or 1
    whole = F.col("part") - F.col("n_single") * F.log(F.lit(float(n)))
    return parts.select(
        F.col("id").alias(id_col), "n_words", whole.alias("log_score"), F.when(F.col("n_words") > 0, whole / F.col("n_words")).alias("mean_log_score")
    )


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select(
        "doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score")
    )


OP6_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
           FROM documents),
t AS (SELECT r, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1:i] END AS w2, CASE WHEN i > 2 THEN w[i - 2:i] END AS w3
      FROM d, unnest(range(1, len(w) + 1)) AS u(i)),
c1 AS (SELECT w1, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT w2, count(*) AS n FROM t WHERE w2 IS NOT NULL GROUP BY 1),
c3 AS (SELECT w3, count(*) AS n FROM t WHERE w3 IS NOT NULL GROUP BY 1),
total AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.r, CASE
    WHEN c3.n >= 2 THEN ln(c3.n) - ln(b.n)
    WHEN c2.n >= 2 THEN ln(c2.n) - ln(a.n) + CASE WHEN t.i > 2 THEN ln(0.4) ELSE 0 END
    ELSE ln(c1.n) - ln(total.n) + least(t.i - 1, 2) * ln(0.4) END AS s
  FROM t JOIN c1 ON t.w1 = c1.w1 LEFT JOIN c2 ON t.w2 = c2.w2 LEFT JOIN c3 ON t.w3 = c3.w3
  LEFT JOIN c1 a ON a.w1 = t.w2[1] LEFT JOIN c2 b ON b.w2 = t.w3[1:2], total)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(x, 0), 6) AS log_score, round(x / len(w), 6) AS mean_log_score
FROM d LEFT JOIN (SELECT r, sum(s) AS x FROM s GROUP BY 1) USING (r)
"""
