"""Packed token ids as binary shards.

Documents become token ids with a closing id; one longer than a sequence is
split into pieces of full length and a last shorter one, so nothing is lost.
A task packs its own documents, `shard_tokens` ids at a time, best-fit-
decreasing: the open bins are kept by their capacity, and a segment tree over
the capacities finds the least sufficient one. Each shard is one file: the id
matrix (unsigned 16 bit where the vocabulary allows), the cumulative segment
lengths of every sequence, the position ids, which start at 0 in every
segment, and an Arrow table of which piece stands where.

No ids are shuffled and a task holds one shard at most. Files are written
under a name of their attempt, and only those that the manifest lists get
their final names, so a lost executor leaves no half shard.

Defined cases: null text is empty and becomes the closing id alone; repeated
rows are packed each; an empty table gives no shards; pieces of equal length
are packed in the order of the rows.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, slices
from .tokens import default_path, encoder

CAPACITY = 2048
SHARD_TOKENS = 1 << 22
END_ID = 50256
MAGIC = b"PACKEDID"


class CapacityTree:
    """Which free capacities some open bin has; finds the least of at least s."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.node = bytearray(2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, free: int, number: int) -> None:
        self.bins[free].append(number)
        i = free + self.size
        while i and not self.node[i]:
            self.node[i] = 1
            i >>= 1

    def take(self, s: int) -> tuple[int, int] | None:
        """(free capacity, bin) of the tightest bin that has room for s."""
        i = s + self.size
        if not self.node[i]:
            while i > 1 and (i & 1 or not self.node[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.node[2 * i])
        free = i - self.size
        number = self.bins[free].pop()
        if not self.bins[free]:
            self.node[i] = 0
            i >>= 1
            while i and not (self.node[2 * i] or self.node[2 * i + 1]):
                self.node[i] = 0
                i >>= 1
        return free, number


def split(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    return [(s, min(capacity, total - s)) for s in range(0, total, capacity)]


def best_fit_decreasing(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], int]:
    """Row and offset of each piece, number of rows."""
    tree, row, offset, rows = CapacityTree(capacity), [0] * len(sizes), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        got = tree.take(s)
        free, number = got or (capacity, rows)
        rows += got is None
        row[i], offset[i] = number, capacity - free
        if free > s:
            tree.add(free - s, number)
    return row, offset, rows


def encode_shard(ids: list[np.ndarray], docs: pa.Array, capacity: int, pad: int, level: int = 1) -> bytes:
    """One shard's bytes: magic, length of a JSON header, header, sections."""
    import zstandard

    which, piece, start, size = [], [], [], []
    for d, x in enumerate(ids):
        for k, (s, n) in enumerate(split(len(x), capacity)):
            which.append(d)
            piece.append(k)
            start.append(s)
            size.append(n)
    row, offset, rows = best_fit_decreasing(size, capacity)
    kind = "<u2" if max(pad, max((int(x.max()) for x in ids), default=0)) < 1 << 16 else "<u4"
    matrix, place = np.full((rows, capacity), pad, kind), np.zeros((rows, capacity), "<u2" if capacity <= 1 << 16 else "<u4")
    for d, s, n, r, o in zip(which, start, size, row, offset):
        matrix[r, o : o + n] = ids[d][s : s + n]
        place[r, o : o + n] = np.arange(n)
    order = np.lexsort((offset, row))
    lengths = np.array(size, np.int64)[order]
    owner = np.array(row, np.int64)[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)])) if len(owner) else np.zeros(1, np.int64)
    sums = [np.concatenate(([0], np.cumsum(lengths[a:b]))) for a, b in zip(first, first[1:])]
    table = pa.table({
        "doc": docs.take(pa.array(np.array(which, np.int64)[order])), "piece": pa.array(np.array(piece, np.int32)[order]), "start": pa.array(np.array(start, np.int64)[order]),
        "length": pa.array(lengths), "row": pa.array(owner), "offset": pa.array(np.array(offset, np.int64)[order]),
    })
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    z = zstandard.ZstdCompressor(level=level)
    parts = {
        "ids": matrix.tobytes(), "positions": place.tobytes(), "cu_seqlens": np.concatenate(sums or [np.zeros(0)]).astype("<i4").tobytes(),
        "cu_starts": np.cumsum([0, *(len(s) for s in sums)]).astype("<i8").tobytes(), "pieces": sink.getvalue().to_pybytes(),
    }
    packed = {k: z.compress(v) for k, v in parts.items()}
    head = json.dumps({"rows": rows, "capacity": capacity, "ids": kind, "positions": place.dtype.str, "pad": pad, "sections": {k: len(v) for k, v in packed.items()}}).encode()
    return b"".join((MAGIC, struct.pack("<I", len(head)), head, *packed.values()))


def decode_shard(raw: bytes) -> dict:
    """The shard's arrays: ids, positions (rows x capacity), cu_seqlens (a list
    of arrays, one for each row), pieces (an Arrow table)."""
    import zstandard

    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard")
    (n,) = struct.unpack_from("<I", raw, len(MAGIC))
    at = len(MAGIC) + 4
    head = json.loads(raw[at : at + n])
    at += n
    parts, z = {}, zstandard.ZstdDecompressor()
    for k, size in head["sections"].items():
        parts[k] = z.decompress(raw[at : at + size])
        at += size
    shape = (head["rows"], head["capacity"])
    sums, starts = np.frombuffer(parts["cu_seqlens"], "<i4"), np.frombuffer(parts["cu_starts"], "<i8")
    return {
        "ids": np.frombuffer(parts["ids"], head["ids"]).reshape(shape), "positions": np.frombuffer(parts["positions"], head["positions"]).reshape(shape),
        "cu_seqlens": [sums[a:b] for a, b in zip(starts, starts[1:])], "pieces": pa.ipc.open_stream(parts["pieces"]).read_all(),
    }


def write(docs: DataFrame, path: str, tokenizer: str | None = None, capacity: int = CAPACITY, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shards of docs under `path`; returns the manifest (shard, name, rows, tokens, sha256)."""
    from . import warc

    vocabulary = tokenizer or default_path()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = warc._fs(path)
        store.create_dir(root, recursive=True)
        enc, task = encoder(vocabulary), TaskContext.get().partitionId()
        ids, owners, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            data = encode_shard(ids, pa.concat_arrays(owners), capacity, end_id)
            name = f"shard-{task:06d}-{number:05d}.ids"
            attempt = f".{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(f"{root}/{attempt}", compression=None) as out:
                out.write(data)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 24) + number], pa.int64()), pa.array([name]), pa.array([attempt]), pa.array([held], pa.int64()), pa.array([hashlib.sha256(data).hexdigest()])],
                names=["shard", "name", "attempt", "tokens", "sha256"],
            )

        for batch in slices(batches, "text", 1 << 20):
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids.append(np.append(enc.ids(text or ""), np.array([end_id], "<u4")))
                owners.append(batch.column("id").slice(i, 1))
                held += len(ids[-1])
                if held >= shard_tokens:
                    yield flush()
                    ids, owners, held, number = [], [], 0, number + 1
        if ids:
            yield flush()

    return warc.publish(rows.mapInArrow(run, "shard long, name string, attempt string, tokens long, sha256 string"), path)


def read_pieces(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """Every piece as it stands in the shards, with the CRC-32 of its ids
    (unsigned 32 bit, little-endian) as read back."""
    from . import warc

    manifest = spark.read.parquet(f"{path}/manifest").select("shard", "name", "sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = warc._fs(path)
        for batch in batches:
            for shard, name, sha in zip(*(batch.column(c).to_pylist() for c in ("shard", "name", "sha256"))):
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    raw = f.read()
                if hashlib.sha256(raw).hexdigest() != sha:
                    raise ValueError(f"{name} is not what was written")
                got = decode_shard(raw)
                crc, sound = [], []
                for r, o, n in zip(*(got["pieces"].column(c).to_pylist() for c in ("row", "offset", "length"))):
                    crc.append(zlib.crc32(got["ids"][r, o : o + n].astype("<u4").tobytes()))
                    sums = got["cu_seqlens"][r]
                    k = int(np.searchsorted(sums, o))
                    sound.append(bool(sums[k] == o and sums[k + 1] == o + n and (got["positions"][r, o : o + n] == np.arange(n)).all()))
                t = got["pieces"].append_column("sequence_id", pa.array((shard << 24) + got["pieces"].column("row").to_numpy())).append_column("ids_crc32", pa.array(crc, pa.int64())).append_column("sound", pa.array(sound))
                yield from t.drop_columns(["row"]).combine_chunks().to_batches(max_chunksize=10_000)

    schema = f"doc {id_type}, piece int, start long, length long, offset long, sequence_id long, ids_crc32 long, sound boolean"
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, schema)


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return read_pieces(spark, path).withColumnRenamed("doc", "doc_id")
