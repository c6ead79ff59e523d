"""Text files as byte ranges that many tasks read, compressed ones included.

A table of files becomes a table of ranges; each task opens its file at its
range and looks at the first bytes to know the kind. A range holds

* plain text: the bytes of the range;
* gzip, bzip2: the members (streams) that begin in it. They are found by their
  first bytes, and the first of a range counts only if it unpacks to its end
  with the right checksum; the others follow one another. Bytes that look like
  a member by chance therefore do no harm, and a file of one member is one
  task's, whatever its size, read in small parts;
* xz: the blocks that begin in it, as the index at the file's end lists them.

Records start at `>` on a new line. What stands before the first and after the
last start of a range may belong to a record of its neighbours: only these
fragments are put together, by one shuffle of two rows for each range.
"""

from __future__ import annotations

import bz2
import io
import lzma
import re
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import MAGIC
from ..operators.shared import number_rows, settle

SPLIT = 64 << 20
CHUNK = 64 << 10
BATCH = 4 << 20
GZIP, BZIP2, XZ = MAGIC

#: How a member begins (gzip: method and flags; bzip2: level and the mark of a block or of the end).
BEGINS = {GZIP: re.compile(rb"\x1f\x8b\x08[\x00-\x1f]", re.S), BZIP2: re.compile(rb"BZh[1-9](?:1AY&SY|\x17rE8P\x90)", re.S)}

#: Schemes that a task opens by itself; Spark's own readers open the others.
SCHEMES = ("file", "hdfs", "s3", "gs", "abfs", "abfss")


def opened(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return io.BufferedReader(where.open_input_file(name), 1 << 20)


def _at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


def _member(f, at: int, kind: bytes) -> Iterator[bytes | int]:
    """The unpacked parts of the member that begins at `at`, then its end."""
    machine = zlib.decompressobj(31) if kind == GZIP else bz2.BZ2Decompressor()
    while not machine.eof:
        raw = _at(f, at, CHUNK)
        if not raw:
            raise EOFError("a compressed file ends within a member")
        at += len(raw)
        yield machine.decompress(raw)
    yield at - len(machine.unused_data)


def _sound(f, at: int, kind: bytes) -> bool:
    try:
        for _ in _member(f, at, kind):
            pass
    except (zlib.error, OSError, EOFError):
        return False
    return True


def _first_member(f, start: int, end: int, kind: bytes) -> int | None:
    """The first place of the range where a whole member begins."""
    if start == 0:
        return 0
    for low in range(start, end, CHUNK):
        for m in BEGINS[kind].finditer(_at(f, low, min(CHUNK, end - low) + 16)):
            at = low + m.start()
            if m.start() < CHUNK and at < end and _sound(f, at, kind):
                return at
    return None


def _members(f, start: int, end: int, size: int, kind: bytes) -> Iterator[bytes]:
    at = _first_member(f, start, end, kind)
    while at is not None and at < min(end, size):
        for part in _member(f, at, kind):
            if isinstance(part, int):
                at = part
            else:
                yield part
        while at < size and (head := _at(f, at, 16)).startswith(b"\0"):
            at += len(head) - len(head.lstrip(b"\0"))  # padding
        if at < size and not BEGINS[kind].match(head):
            raise ValueError("bytes after a compressed member are not another")


def _number(data: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, and where the next thing begins."""
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def blocks(f, size: int) -> list[tuple[bytes, int, int]]:
    """Stream header, place and length of every block of an xz file, from the
    indexes that its streams end with."""
    found: list[list[tuple[bytes, int, int]]] = []
    end = size
    while end > 0:
        foot = _at(f, end - 12, 12)
        if foot.endswith(b"\0\0\0\0"):
            end -= 4  # padding between streams
            continue
        if not foot.endswith(b"YZ"):
            raise ValueError("an xz stream has no end")
        length = (int.from_bytes(foot[4:8], "little") + 1) * 4
        index = _at(f, end - 12 - length, length)
        n, at = _number(index, 1)
        sizes = []
        for _ in range(n):
            unpadded, at = _number(index, at)
            _, at = _number(index, at)
            sizes.append(-(-unpadded // 4) * 4)
        begin = end - 24 - length - sum(sizes)
        head, place, stream = _at(f, begin, 12), begin + 12, []
        for s in sizes:
            stream.append((head, place, s))
            place += s
        found.append(stream)
        end = begin
    return [b for stream in reversed(found) for b in stream]


def _blocks(f, start: int, end: int, listed: list[tuple[bytes, int, int]]) -> Iterator[bytes]:
    for head, at, length in listed:
        if start <= at < end:
            machine = lzma.LZMADecompressor(lzma.FORMAT_XZ)
            machine.decompress(head)
            for low in range(at, at + length, CHUNK):
                yield machine.decompress(_at(f, low, min(CHUNK, at + length - low)))


def _plain(f, start: int, end: int) -> Iterator[bytes]:
    for low in range(start, end, CHUNK):
        yield _at(f, low, min(CHUNK, end - low))


def layout(f, size: int) -> tuple[bytes | None, list[tuple[bytes, int, int]]]:
    """The kind of a file, by its first bytes, and the blocks of an xz file."""
    head = _at(f, 0, 6)
    kind = next((m for m in MAGIC if head.startswith(m)), None)
    return kind, blocks(f, size) if kind == XZ else []


def text_of(f, start: int, end: int, size: int, known: tuple[bytes | None, list[tuple[bytes, int, int]]] | None = None) -> Iterator[bytes]:
    """The unpacked text of a range, in small parts; known: the file's layout."""
    kind, listed = known or layout(f, size)
    if kind is None:
        return _plain(f, start, end)
    return _blocks(f, start, end, listed) if kind == XZ else _members(f, start, end, size, kind)


def cut(parts: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """0 and what precedes the first start of a record, 1 and each record, 2
    and the last record, which may go on in the next range. Without a start
    all is of kind 0; without text there is nothing."""
    held: list[bytes] = []
    carry, kind = b"", 0
    for part in parts:
        part = carry + part
        carry = b"\n" if part.endswith(b"\n") else b""  # its > may come next
        first, *more = part.removesuffix(b"\n").split(b"\n>")
        held.append(first)
        for x in more:
            yield kind, b"".join(held)
            kind, held = 1, [x]
    rest = b"".join([*held, carry])
    if kind or rest:
        yield 2 if kind else 0, rest


def ranges(spark: SparkSession, paths: tuple[str, ...], split: int = SPLIT) -> DataFrame:
    """path, file, size, start, split: all ranges, numbered in the order of the
    paths. Spark lists the files; none is opened."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", F.monotonically_increasing_id().alias("file"), F.col("length").alias("size"))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("long")))
    return number_rows(files.withColumn("start", starts), ["path", "file", "start"], "split")


def records(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """ord, r: the text of every record, as it stands after its `>`. ord grows
    along each file and, by path, over files; empty files have no rows."""
    found = settle(ranges(spark, paths, split), "ranges")
    total = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.col("size") - F.col("start"), F.lit(split))).alias("bytes")).first()
    # tasks follow the bytes, not the ranges; one takes neighbours, so it opens few files
    tasks = max(min(total.n, max(2 * spark.sparkContext.defaultParallelism, -(-(total.bytes or 0) // SPLIT))), 1)
    dealt = found.repartitionById(tasks, F.floor(F.col("split") * tasks / max(total.n, 1)).cast("int")).sortWithinPartitions("split")
    names = ["split", "file", "kind", "nr", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ExitStack() as held:
            path, f, known = None, None, None
            rows, weight = [], 0
            for row in (r for batch in batches for r in batch.to_pylist()):
                if row["path"] != path:
                    held.close()
                    path, f = row["path"], held.enter_context(opened(row["path"]))
                    known = layout(f, row["size"])
                for nr, (kind, text) in enumerate(cut(text_of(f, row["start"], min(row["start"] + split, row["size"]), row["size"], known))):
                    rows.append((row["split"], row["file"], kind, nr, text))
                    weight += len(text) + 32
                    if weight >= BATCH:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)
                        rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=shape)

    shape = pa.schema([("split", pa.int64()), ("file", pa.int64()), ("kind", pa.int32()), ("nr", pa.int64()), ("text", pa.binary())])
    read = settle(dealt.mapInArrow(run, "split long, file long, kind int, nr long, text binary").withColumn("text", F.col("text").cast("string")), "read")
    place = F.shiftleft(F.col("split"), 33) + F.col("nr")
    whole = read.filter("kind = 1").select(place.alias("ord"), F.col("text").alias("r"))
    order = Window.partitionBy("file").orderBy("split", "nr")
    ends = read.filter("kind <> 1").withColumn("chain", F.sum((F.col("kind") == 2).cast("int")).over(order))
    chained = ends.groupBy("file", "chain").agg(F.min(place).alias("at"), F.array_sort(F.collect_list(F.struct("split", "nr", "text"))).alias("all"))
    joined = chained.select("at", F.posexplode(F.split(F.array_join(F.transform("all", lambda x: x["text"]), ""), "\n>")).alias("n", "r"))
    return whole.unionByName(joined.select((F.col("at") + F.col("n")).alias("ord"), "r"))
