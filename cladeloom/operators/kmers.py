"""The spans of k-mers in families, combined in blocks before Spark sees them.

A task slides over the residues of its sequences in blocks of BLOCK places:
codes come from a Horner scheme over the block's bytes, and each block's places
are sorted once, so that a k-mer of a family leaves it as one row with its
least and greatest group number. Memory follows the block, not the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import alphabet, check_k

BLOCK = 2 << 20
ROWS = 1 << 16
SCHEMA = pa.schema([("code", pa.int64()), ("fam_id", pa.int32()), ("low", pa.int64()), ("high", pa.int64())])


def codes(data: np.ndarray, k: int, base: int) -> np.ndarray:
    """The code of every place of digits: k - 1 fewer than there are digits."""
    n = max(len(data) - k + 1, 0)
    out = np.zeros(n, np.int64)
    for j in range(k):
        out *= base
        out += data[j : n + j]
    return out


def block_spans(data: np.ndarray, ends: np.ndarray, rank: np.ndarray, n: int, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (code, rank) of the k-mers that begin at the first n places,
    in order. data: digits of sequences end to end; ends: where each ends, which
    may lie behind the data; rank: of each one's group."""
    held = np.searchsorted(ends, n - 1, "right") + 1
    owner = np.repeat(np.arange(held), np.diff(np.minimum(ends[:held], n), prepend=0))
    found = codes(data, k, base)
    owner = owner[: len(found)]
    inside = np.arange(k, k + len(found)) <= ends[owner]
    bits = int(rank.max()).bit_length()
    key = (found[inside] << bits) | rank[owner[inside]]
    key.sort()
    key = key[np.diff(key, prepend=-1) != 0]
    return key >> bits, key & ((1 << bits) - 1)


def spans_of(k: int, reduced: bool = False, block: int = BLOCK) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(fam_id, pre, seq) -> (code, fam_id, low, high), combined by block."""
    letters = alphabet(reduced)
    digit = np.full(256, 255, np.uint8)
    digit[list(letters.encode())] = np.arange(len(letters))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seq = batch.column("seq").cast(pa.large_binary())
            starts = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
            ends, zero = starts[1:] - starts[0], starts[0]
            if not len(seq) or ends[-1] < k:
                continue
            residues = np.frombuffer(seq.buffers()[2], np.uint8)[zero : zero + ends[-1]]
            fam, pre = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("fam_id", "pre"))
            groups, rank = np.unique(np.stack([fam, pre]), axis=1, return_inverse=True)
            rank = rank.reshape(-1)
            for at in range(0, len(residues), block):
                n = min(block, len(residues) - at)
                data = digit[residues[at : at + n + k - 1]]
                if (data == 255).any():
                    raise ValueError("a sequence is not sanitised")
                low = np.searchsorted(ends, at, "right")
                code, of = block_spans(data, ends[low:] - at, rank[low:], n, k, len(letters))
                if not len(code):
                    continue
                family = groups[0][of]
                begins = np.append(True, (code[1:] != code[:-1]) | (family[1:] != family[:-1]))
                here = np.flatnonzero(begins)
                last = np.append(here[1:], len(code)) - 1
                out = pa.RecordBatch.from_arrays([pa.array(code[here]), pa.array(family[here].astype(np.int32)), pa.array(groups[1][of[here]]), pa.array(groups[1][of[last]])], schema=SCHEMA)
                yield from (out.slice(i, ROWS) for i in range(0, len(out), ROWS))

    return run


def spans(rows: DataFrame, k: int, reduced: bool = False) -> DataFrame:
    """(code, fam_id, low, high): the least and greatest group number (pre) of
    each k-mer in each family. rows(fam_id, pre, seq), sanitised.

    Sequences are first dealt by family, large families over many tasks: what a
    family repeats then meets in one task, and residues are moved once instead
    of its k-mers from every task."""
    check_k(k)
    asked = rows.filter(F.length("seq") >= k).select(F.col("fam_id").cast("int").alias("fam_id"), F.col("pre").cast("long").alias("pre"), "seq")
    return asked.hint("rebalance", "fam_id").mapInArrow(spans_of(k, reduced), "code long, fam_id int, low long, high long").groupBy("code", "fam_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
