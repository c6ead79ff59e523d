"""Line dedup with two Bloom filters.

A line's key is the line without white space `[\\x20\\x09-\\x0D]` at its ends,
A-Z lower-cased. Keys of at least `min_points` code points that stand in at
least `min_docs` documents lose all their lines, except in the document of the
largest id that holds them.

* Filters: each task hashes its own keys and reports, block by block, which
  bits a key sets (seen once) and which bits keys set that two of its texts
  hold (seen twice). Merging a block is `twice |= once & new; once |= new`, so
  the reports combine in any order and nothing but bits is shuffled. The bits
  follow the number of lines, up to MAX_BITS; beyond that more lines are
  suspected and none is missed.
* Suspects: the finished twice-filter (MAX_BITS / 8 bytes at most) is
  broadcast, and only keys whose bits it has all are shuffled, as SHA-256
  digests, to be counted by document exactly. The greatest id is chosen there.
* Removal: texts that lose nothing stay where they are (`maybe_among`); the
  others meet the digests of the keys that they lose.

A key in a large share of all documents is combined in each task before it is
shuffled, and its rows stay where they are when the decision is joined.

Defined cases: null or empty text is one empty line; a document is an id, so
rows that repeat an id count once for a key and share its fate; null is the
smallest id and, as an id, one document; lines of a document that keeps a key
all stay, also repeated ones; an empty table gives an empty result; further
columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, fresh, join_hot, materialise, maybe_among, named_id, slices, text_tag

MIN_POINTS = 20
MIN_DOCS = 3

#: Bits of a block, of the filter at least and at most, bits for each line, bits that a key sets in its block.
BLOCK_BITS = 1 << 13
LEAST_BITS = 1 << 20
MAX_BITS = 1 << 28
BITS_PER_LINE = 16
HASHES = 4

#: The white space that does not count at the ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"


def lines(raw: bytes) -> Iterator[bytes]:
    """The lines one after another, so that a long text is not held twice."""
    at = 0
    while (end := raw.find(b"\n", at)) >= 0:
        yield raw[at:end]
        at = end + 1
    yield raw[at:]


def key_of(line: bytes, min_points: int = MIN_POINTS) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_points or (not key.isascii() and len(key.decode("utf-8", "replace")) < min_points):
        return None
    return key


def digest(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()


def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each hash and the bits that it sets there."""
    block = (hashes >> np.uint64(40)) % np.uint64(blocks)
    bits = np.empty((len(hashes), HASHES), np.uint16)
    for i in range(HASHES):  # two numbers of the hash give all bits
        bits[:, i] = ((hashes & np.uint64(0xFFFFF)) + np.uint64(i) * (((hashes >> np.uint64(20)) & np.uint64(0xFFFFF)) | np.uint64(1))) % np.uint64(BLOCK_BITS)
    return block.astype(np.int64), bits


def _by_block(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, pa.Array]:
    block, bits = places(hashes, blocks)
    order = np.argsort(block, kind="stable")
    own, first = np.unique(block[order], return_index=True)
    ends = np.append(first, len(order)).astype(np.int32) * np.int32(2 * HASHES)
    return own, pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(bits[order]).tobytes())])


def _report(blocks: int, min_points: int):
    """For each task's texts: block, twice, bits (two bytes each)."""
    schema = pa.schema([("block", pa.int32()), ("twice", pa.bool_()), ("bits", pa.binary())])

    def told(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        for twice, h in ((False, found), (True, found[n > 1])):
            if len(h):
                own, bits = _by_block(h, blocks)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), twice)), bits], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, "text", 1 << 22):
            hashes, row = array("Q"), array("q")
            for i, text in enumerate(as_bytes(batch.column("text"))):
                before = len(hashes)
                hashes.extend(xxhash.xxh3_64_intdigest(k) for x in lines(text.as_py()) if (k := key_of(x, min_points)) is not None)
                row.extend([i] * (len(hashes) - before))
            if not hashes:
                continue
            h, r = np.frombuffer(hashes, np.uint64), np.frombuffer(row, np.int64)
            order = np.lexsort((h, r))
            h, r = h[order], r[order]
            parts.append(h[np.append(True, (h[1:] != h[:-1]) | (r[1:] != r[:-1]))])  # once for each text
            held += len(parts[-1])
            if held >= 1 << 21:
                yield from told(parts)
                parts, held = [], 0
        if parts:
            yield from told(parts)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once: dict[int, np.ndarray] = {}
    twice: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, again, bits in zip(batch.column("block").to_pylist(), batch.column("twice").to_pylist(), batch.column("bits").to_pylist()):
            flags = np.zeros(BLOCK_BITS, bool)
            flags[np.frombuffer(bits, np.uint16)] = True
            new = np.packbits(flags)
            if block not in once:
                once[block], twice[block] = np.zeros_like(new), np.zeros_like(new)
            if again:
                twice[block] |= new
            else:
                twice[block] |= once[block] & new
                once[block] |= new
    own = [b for b in once if twice[b].any()]
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([twice[b].tobytes() for b in own], pa.binary())], names=["block", "bits"])


def twice_filter(docs: DataFrame, text_col: str = "text", min_points: int = MIN_POINTS) -> tuple[bytes, int]:
    """The bits of the keys that more than one text may hold, and the number of blocks."""
    texts = docs.select(F.col(text_col).alias("text"))
    n = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(MAX_BITS, max(LEAST_BITS, 1 << max(0, BITS_PER_LINE * n - 1).bit_length()))
    blocks = bits // BLOCK_BITS
    told = texts.mapInArrow(_report(blocks, min_points), "block int, twice boolean, bits binary")
    parts = max(1, min(blocks // 16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = bytearray(bits // 8)
    for r in told.repartition(parts, "block").mapInArrow(_merge, "block int, bits binary").collect():  # MAX_BITS / 8 bytes at most
        out[r.block * BLOCK_BITS // 8 : (r.block + 1) * BLOCK_BITS // 8] = r.bits
    return bytes(out), blocks


def suspects(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """id, tag, digest: the keys of each text that another text may hold too."""
    bits, blocks = twice_filter(docs, text_col, min_points)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_tag(F.col(text_col)).alias("tag"))
    schema = rows.select("id", "tag", F.lit(b"").alias("digest")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, np.uint8)

        def repeated(keys: list[bytes], row: list[int], batch: pa.RecordBatch) -> pa.RecordBatch:
            block, at = places(np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64), blocks)
            at = block[:, None] * BLOCK_BITS + at
            hit = ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
            found = sorted({(row[i], digest(keys[i])) for i in np.flatnonzero(hit)})
            r = pa.array([i for i, _ in found], pa.int64())
            return pa.RecordBatch.from_arrays([batch.column("id").take(r), batch.column("tag").take(r), pa.array([d for _, d in found], pa.binary())], names=["id", "tag", "digest"])

        for batch in slices(batches, "text", 1 << 22):
            keys, row, size = [], [], 0
            for i, text in enumerate(as_bytes(batch.column("text"))):
                for x in lines(text.as_py()):
                    if (k := key_of(x, min_points)) is not None:
                        keys.append(k)
                        row.append(i)
                        size += len(k) + 64
                        if size > 1 << 23:  # a long text's keys are asked for in parts
                            yield repeated(keys, row, batch)
                            keys, row, size = [], [], 0
            if keys:
                yield repeated(keys, row, batch)

    return materialise(rows.mapInArrow(run, schema), "suspects")


def losses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS) -> DataFrame:
    """id, tag, rows, digests: what each text of an id (rows of them) loses,
    the digests at most as many as the text's own lines."""
    found = suspects(docs, id_col, text_col, min_points)
    n, k = "__n", "__k"
    rows = found.select("*", *named_id(F.col("id"), n, k))
    held = rows.groupBy("digest", n, k).agg(F.first("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    counts = held.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("last"), F.sum("rows").alias("rows"))
    repeated = materialise(counts.filter(F.col("docs") >= min_docs).select("digest", "last", "rows"), "repeated")
    lost = join_hot(found, repeated, ["digest"], "rows", found.count()).filter(~F.col("id").eqNullSafe(F.col("last")))
    each = lost.select(*named_id(F.col("id"), n, k), "tag", "digest").groupBy(n, k, "tag", "digest").agg(F.count(F.lit(1)).alias("rows"))
    return each.groupBy(n, k, "tag").agg(F.max("rows").alias("rows"), F.collect_list("digest").alias("digests"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_points: int = MIN_POINTS, min_docs: int = MIN_DOCS, counts: tuple[str, str] | None = None) -> DataFrame:
    """docs with the remaining lines as text (null becomes empty); `counts`
    names two further columns, the lines before and the lines dropped."""
    n, k, tag, rows, digests = fresh([*docs.columns, *(counts or ())], "__n", "__k", "__tag", "__rows", "__digests")
    lost = materialise(losses(docs, id_col, text_col, min_points, min_docs).toDF(n, k, tag, rows, digests), "losses")
    free, asked = maybe_among(docs, lost, [n, k], id_col)
    asked = materialise(asked.withColumn(tag, text_tag(F.col(text_col))), "asked")
    most = lost.agg(F.sum(rows)).first()[0] or 0
    joined = join_hot(asked, lost, [n, k, tag], rows, most, how="left").select(*docs.columns, digests)

    before, dropped = counts or fresh(joined.columns, "__before", "__dropped")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    n_lines = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")

    def untouched(part: DataFrame) -> DataFrame:
        return part.withColumns({before: n_lines, dropped: F.lit(0).cast("long"), text_col: whole}).select(*docs.columns, before, dropped)

    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 22):
            kept, was, gone = [], [], []
            for text, own in zip(as_bytes(batch.column(text_col)), batch.column(digests)):
                drop, stay, n = set(own.as_py() or ()), bytearray(), 0
                left = 0
                for n, x in enumerate(lines(text.as_py()), 1):
                    if (key := key_of(x, min_points)) is None or digest(key) not in drop:
                        stay += b"\n" * (left > 0) + x
                        left += 1
                kept.append(bytes(stay))
                was.append(n)
                gone.append(n - left)
            columns = [pa.array(kept, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(was, pa.int64()), pa.array(gone, pa.int64())], names=[*names, before, dropped])

    rest = untouched(free.select(*docs.columns))
    out = rest.unionByName(joined.mapInArrow(run, rest.schema))
    return out if counts else out.select(*docs.columns)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeated_lines(docs, counts=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line,
             translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
hot AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT l.*, hot.key IS NOT NULL AND l.doc_id <> hot.last AS gone FROM l LEFT JOIN hot ON l.key = hot.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
