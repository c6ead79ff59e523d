"""Best-fit packing with bound-certified repacking.

Documents become token ids plus a closing 0; one longer than a sequence is
cut into full pieces, the remainder first. Full pieces are sequences of their
own. The other pieces are dealt by hash to partitions of about `part_items`,
and each partition packs its own best-fit-decreasing. Dual feasible functions
of the partition's piece lengths bound from below the bins that any packing
of it needs. A partition that reaches its bound is certified: only its
emptiest bin is opened again. A partition with a gap opens all bins that are
not full. What is opened is exchanged - dealt anew over fewer partitions -
and packed again; a round counts only if it needs fewer bins than before.

Per task: one partition's rows of numbers (no texts). To the driver: counts.
The tokenised pieces are written once, so nothing is tokenised twice.

Defined cases: null text is empty, so its document is the single id 0; the
ends of repeated rows are packed separately; ties in length are packed in
the order of identifier and piece; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, released, slices
from .tokens import default_path, encoder

CAPACITY = 2048
PART_ITEMS = 100_000
ROUNDS = 6


def cut(total: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `total` ids."""
    first = total % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    path = tokenizer or default_path()
    rows = docs.select(id_col, text_col)
    schema = rows.selectExpr(id_col, "0 as piece", "0L as start", "0L as length", "0L as ids_crc32").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in slices(batches, text_col, 4 << 20):
            row, out = [], []
            for i, text in enumerate(batch.column(text_col).to_pylist()):
                ids = np.append(enc.ids(text or ""), np.array([0], "<u4"))
                for k, (start, n) in enumerate(cut(len(ids), capacity)):
                    row.append(i)
                    out.append((k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
            k, start, n, crc = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col).take(pa.array(row)), pa.array(k, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32"],
            )

    return rows.mapInArrow(released(run), schema)


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most that dual feasible functions of these sizes prove."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    best = -(-int((count * x).sum()) // capacity)
    number, mass = np.cumsum(count), np.cumsum(count * x)
    for e in range(1, capacity // 2 + 1):  # below e nothing, above capacity - e a whole bin
        large = int(number[-1] - number[capacity - e])
        middle = int(mass[capacity - e] - mass[e - 1])
        best = max(best, large + -(-middle // capacity))
    for k in range(1, 101):  # rounding down to multiples of capacity / k
        exact = (x * (k + 1)) % capacity == 0
        u = np.where(exact, x * k, (x * (k + 1) // capacity) * capacity)  # k times the function's value
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


def best_fit(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item (descending sizes), fill of each bin. Bins
    are kept by the room they have; a bit mask finds the least sufficient room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill, where, offset = 0, [], [], []
    for s in sizes:
        m = mask >> s
        if m:
            room = s + (m & -m).bit_length() - 1
            b = stacks[room].pop()
            if not stacks[room]:
                mask ^= 1 << room
        else:
            b, room = len(fill), capacity
            fill.append(0)
        where.append(b)
        offset.append(fill[b])
        fill[b] += s
        if room > s:
            stacks[room - s].append(b)
            mask |= 1 << (room - s)
    return where, offset, fill


def _packer(turn: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rows = rows.sort_by([("length", "descending"), (rows.column_names[0], "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows.column("length").to_numpy()
        where, offset, fill = best_fit(sizes.tolist(), capacity)
        filled, w = np.array(fill), np.array(where)
        certified = len(fill) == lower_bound(sizes, capacity)
        opened = filled < capacity
        if certified:
            opened &= np.arange(len(filled)) == int(filled.argmin())
        base = (turn << 56) | (TaskContext.get().partitionId() << 32)
        out = rows.select(rows.column_names[:5]).append_column("sequence_id", pa.array(base + w)).append_column("offset", pa.array(offset, pa.int64())).append_column("opened", pa.array(opened[w]))
        yield from out.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, part_items: int = PART_ITEMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    every = materialise(pieces(docs, tokenizer, capacity, id_col, text_col), "pieces")
    names = every.columns
    whole = every.filter(F.col("length") == capacity).select(
        *names, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    todo, closed, kept, parts = every.filter(F.col("length") < capacity), [whole], None, None
    for turn in range(ROUNDS):
        n = todo.count()
        if not n or parts == 1:
            break
        parts = max(1, -(-n // part_items))
        dealt = todo.repartition(parts, F.xxhash64(F.lit(turn), *names))
        packed = materialise(dealt.mapInArrow(released(_packer(turn, capacity)), todo.selectExpr(*names, "0L as sequence_id", "0L as offset", "true as opened").schema), "packed")
        bins = packed.agg(F.count_distinct("sequence_id")).first()[0]
        if kept is not None and bins >= kept[1]:
            break
        if kept is not None:
            closed.append(kept[0].filter("not opened").drop("opened"))
        kept = (packed, packed.filter("opened").agg(F.count_distinct("sequence_id")).first()[0])
        todo = packed.filter("opened").select(*names)
        if kept[1] <= 1:
            break
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out if kept is None else out.unionByName(kept[0].drop("opened"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
