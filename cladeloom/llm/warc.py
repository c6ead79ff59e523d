"""Deterministic sharded WARC writer and its reader.

Writing: payload digests are compared first (numbers only); the rows that
revisit another record then join the pages by a union, and both are dealt to
shards of page ids. The shards' boundaries are prefix sums of the html's bytes
by page id, so they depend on the pages alone and shards are even in bytes;
the payloads are shuffled once and no group of copies meets in one task. Each task writes its range in order as one gzip
member per record with regenerated headers and digests, and rolls to a new
file once `roll_bytes` of compressed data are reached. A file is written under
a name of its own attempt; the manifest, itself written by Spark, lists the
files of the attempts that succeeded, and committing gives those their final
names. Names, order and bytes depend on the pages alone, so a lost executor
or a second attempt changes nothing.

Defined cases: null html is an empty payload; empty and short payloads are
always responses; a null url becomes the page's urn; a null page id is sorted
first and is the least id of a group; rows that repeat a page id are separate
records, and of those with the same long payload one is the response; an
empty table gives no archive and no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import running_sum
from .common import as_bytes, discard, join_hot, materialise, scratch_path

LEAST_REVISIT = 1000
ROLL_BYTES = 8 << 20  # compressed; a range of SHARD_BYTES of text fills about one file and a half
SHARD_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1"
MANIFEST = "name string, attempt string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _urn(page) -> str:
    return f"<urn:page:{'null' if page is None else page}>"


def record(page, url: str | None, payload: bytes, refers, is_revisit: bool, date: str = DATE) -> bytes:
    """One WARC record, uncompressed."""
    digest = hashlib.sha1(payload).hexdigest()
    body = b"" if is_revisit else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + body
    lines = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", _urn(page)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%") if url is not None else _urn(page)[1:-1]),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        lines += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(refers))]
    lines += [("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8") + b"\r\n"
    return head + block + b"\r\n\r\n"


def _member(raw: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # gzip without name or time
    return z.compress(raw) + z.flush()


class _Roller:
    """Files of one task, rolled by compressed size."""

    def __init__(self, base: str, shard: int, roll: int):
        self.fs, self.root = _fs(base)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.roll, self.at, self.out, self.done = shard, roll, 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.at:05d}.warc.gz"
            self.attempt = f".{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.attempt}", compression=None)
            self.hash, self.size, self.records = hashlib.sha256(), 0, 0
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.attempt, self.records, self.size, self.hash.hexdigest()))
            self.out, self.at = None, self.at + 1


def _writer(base: str, roll: int, level: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Roller(base, TaskContext.get().partitionId(), roll)
        current, visits, seen = object(), {}, set()
        for batch in batches:
            pages, kinds = batch.column("page_id").to_pylist(), batch.column("kind").to_pylist()
            urls, keys, refers = (batch.column(c).to_pylist() for c in ("url", "key", "refers_to"))
            for page, kind, url, raw, key, ref in zip(pages, kinds, urls, as_bytes(batch.column("html")), keys, refers):
                if page != current:
                    current, visits, seen = page, {}, set()
                if kind == 0:
                    visits[bytes(key)] = ref
                    continue
                payload = raw.as_py()
                again, ref = False, None
                if len(payload) >= LEAST_REVISIT:
                    own = hashlib.sha256(payload).digest()
                    again = own in visits or own in seen
                    ref = visits.get(own, page)
                    seen.add(own)
                files.add(_member(record(page, url, payload, ref, again, date), level))
        files.close()
        if files.done:
            cols = list(zip(*files.done))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4])],
                names=["name", "attempt", "records", "bytes", "sha256"],
            )

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, key, refers_to) of the pages that revisit another page."""
    rows = pages.select(
        "page_id", F.unhex(F.sha2(F.encode(F.col("html"), "UTF-8"), 256)).alias("key"), F.octet_length("html").alias("n")
    ).filter(F.col("n") >= LEAST_REVISIT)
    best = rows.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    return join_hot(rows, best, ["key"], "rows", rows.count()).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to").distinct()


def boundaries(pages: DataFrame, shard_bytes: int = SHARD_BYTES) -> list[int]:
    """The first page_id of each shard but the first one, which also has the
    nulls: a page belongs to the shard that the html of the pages before it
    fills to. They follow from the pages alone, not from their partitions. One
    number for each shard_bytes of html reaches the driver."""
    sizes = pages.filter("page_id is not null").groupBy("page_id").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("size"))
    placed = running_sum(sizes, ["page_id"], "size", "upto").withColumn("shard", F.floor((F.col("upto") - F.col("size")) / shard_bytes))
    return sorted(r.first for r in placed.groupBy("shard").agg(F.min("page_id").alias("first")).filter("shard > 0").collect())


def shard_of(first: list[int]):
    """The shard of a page_id, by binary search; null pages are in shard 0."""

    @F.arrow_udf("int")
    def find(page: pa.Array) -> pa.Array:
        known = pc.fill_null(page, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(np.array(first, np.int64), known, side="right"), pa.int32())

    return find


def write(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, level: int = 6, date: str = DATE) -> DataFrame:
    """Archive pages(page_id, url, html) under `path`; returns the manifest
    (name, records, bytes, sha256), which is also kept in path/manifest."""
    spark = pages.sparkSession
    seen = materialise(revisits(pages), "revisits")
    none = F.lit(None)
    rows = pages.select(
        F.lit(1).alias("kind"), "page_id", "url", F.col("html"), none.cast("binary").alias("key"), none.cast("long").alias("refers_to")
    ).unionByName(seen.select(F.lit(0).alias("kind"), "page_id", none.cast("string").alias("url"), none.cast("string").alias("html"), "key", F.col("refers_to").cast("long")))
    first = boundaries(pages, shard_bytes)
    dealt = rows.repartitionById(len(first) + 1, shard_of(first)(F.col("page_id"))).sortWithinPartitions("page_id", "kind", "url", "html")
    listed = dealt.mapInArrow(_writer(path, roll_bytes, level, date), MANIFEST)
    return publish(listed, path)


def publish(listed: DataFrame, path: str) -> DataFrame:
    """Run the writing tasks of listed (name, attempt, ..), give the files of
    the attempts that counted their names, and last of all write the manifest:
    where there is one, all files that it names are complete."""
    attempts = materialise(listed, "attempts")
    _commit(attempts, path)
    attempts.drop("attempt").write.parquet(f"{path}/manifest")
    discard(attempts)
    return attempts.sparkSession.read.parquet(f"{path}/manifest")


def _commit(manifest: DataFrame, base: str) -> None:
    """Give the listed attempts their final names; may be run again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = _fs(base)
        for batch in batches:
            for name, attempt in zip(batch.column("name").to_pylist(), batch.column("attempt").to_pylist()):
                if store.get_file_info(f"{root}/{attempt}").type != fs.FileType.NotFound:
                    store.move(f"{root}/{attempt}", f"{root}/{name}")
                elif store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    raise FileNotFoundError(f"{base}/{name}")
            yield batch.select(["name"])

    manifest.mapInArrow(run, "name string").agg(F.count("name")).first()
    spark = manifest.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(base)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in store.globStatus(jvm.org.apache.hadoop.fs.Path(folder, ".shard-*")) or []:  # of attempts that failed
        store.delete(left.getPath(), False)


def _members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    z, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        if not data:
            break
        parts.append(z.decompress(data))
        rest = z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends within a record")


def parse(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if first.encode() != VERSION:
        raise ValueError(f"not a WARC record: {first[:40]}")
    said = dict(x.split(": ", 1) for x in lines)
    n = int(said["Content-Length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if said["WARC-Block-Digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("a record's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda urn: None if urn in (None, "<urn:page:null>") else int(urn[len("<urn:page:") : -1])
    kind, digest = said["WARC-Type"], said["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload's digest is wrong")
    uri = said["WARC-Target-URI"]
    return {
        "page_id": number(said["WARC-Record-ID"]), "url": None if uri.startswith("urn:page:") else uri, "record_type": kind,
        "refers_to": number(said.get("WARC-Refers-To")), "payload_bytes": int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0]),
        "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives that the manifest under `path` lists."""
    manifest = spark.read.parquet(f"{path}/manifest").select("name")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", *["payload"] * payloads]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(path)
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in _members(stream):
                        rows.append(parse(raw))
                        size += len(raw) if payloads else 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    schema = RECORDS if payloads else RECORDS.rsplit(",", 1)[0]
    files = manifest.count()
    return manifest.repartition(max(1, files)).mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, html, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to
FROM q
"""
