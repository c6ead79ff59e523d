"""Elements of XML files, found in byte ranges of each file by many tasks.

A file is read as pieces that end with `>`, so each has one tag at most, and
Spark cuts large files into splits. First each split is summed up: how many
more of the wanted tags it opens than closes, and whether it ends in a comment,
for both ways in which it may begin. Prefix sums over the splits (one row for
each) then say at which depth every split begins. Elements that lie within a
split are given out where they stand; only the parts of those that cross
splits are put together by a shuffle. No size is fixed for a file.

Attribute values must write > as &gt;, as XML writers do, and tags of the
wanted names must not stand in CDATA sections.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import settle
from .files import compressed_otherwise, expand

_TAG = re.compile(r"<(/?)(?:[\w.-]+:)?([\w.-]+)[^<]*$")
_PREFIX = re.compile(r"(</?)[\w.-]+:")

#: Order numbers: of each split 2 to the 42nd, of each tag two.
SPLIT_BITS = 42

#: Pieces of an element that are held one by one.
PIECES = 4096


def tag_of(piece: str, names: tuple[str, ...]) -> tuple[int, bool]:
    """How many elements of the names the piece's tag opens (-1: closes one),
    and whether it opens and closes one at once."""
    m = _TAG.search(piece)
    if m is None or m[2] not in names:
        return 0, False
    if m[1]:
        return -1, False
    return (0, True) if piece.endswith("/") else (1, False)


class Reader:
    """The pieces of a split in order: is a comment open, how deep are we."""

    def __init__(self, names: tuple[str, ...], comment: bool = False, depth: int = 0):
        self.names, self.comment, self.depth = names, comment, depth

    def step(self, piece: str) -> tuple[int, bool]:
        if self.comment:
            self.comment = not piece.endswith("--")
            return 0, False
        begun = piece.rfind("<!--")
        if begun >= 0:
            self.comment = not piece.endswith("--") or len(piece) < begun + 6
            return 0, False
        change, whole = tag_of(piece, self.names)
        self.depth += change
        return change, whole


def _pieces(spark: SparkSession, paths: str) -> DataFrame:
    """file, start (of the split), piece: in the order of each split. Files
    that the text reader does not open by their name are one split each."""
    if compressed_otherwise(spark, paths):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    text = expand(data).decode("utf-8").split(">")
                    for i in range(0, len(text), 10_000):
                        part = text[i : i + 10_000]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array([0] * len(part), pa.int64()), pa.array(part)], names=["path", "start", "piece"])

        whole = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, start long, piece string")
        return whole.select(F.xxhash64("path").alias("file"), "start", "piece")
    raw = spark.read.option("lineSep", ">").text(paths)
    return raw.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


def _summed(names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        both: list[Reader] = []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"file": [at[0]], "start": [at[1]], "depth": [both[0].depth], "comment": [both[0].comment], "depth_in": [both[1].depth], "comment_in": [both[1].comment]})

        for batch in batches:
            for file, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != at:
                    if at is not None:
                        yield told()
                    at, both = (file, start), [Reader(names), Reader(names, comment=True)]
                for r in both:
                    r.step(piece)
        if at is not None:
            yield told()

    return run


def begins(pieces: DataFrame, names: tuple[str, ...]) -> dict[tuple[int, int], tuple[int, bool, int]]:
    """(file, start) -> number of the split, whether it begins in a comment,
    its depth. One entry for each split of the input (of 128 MB as a rule)."""
    rows = pieces.mapInArrow(_summed(names), "file long, start long, depth long, comment boolean, depth_in long, comment_in boolean").collect()
    out, file, comment, depth = {}, None, False, 0
    for n, r in enumerate(sorted(rows, key=lambda r: (r.file, r.start))):
        if r.file != file:
            file, comment, depth = r.file, False, 0
        out[(r.file, r.start)] = (n, comment, depth)
        depth += r.depth_in if comment else r.depth
        comment = r.comment_in if comment else r.comment
    return out


def _cut(names: tuple[str, ...], known: dict[tuple[int, int], tuple[int, bool, int]]):
    """ord, opens, closes, text of each element, or part of one, in a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, reader, number, tag = None, Reader(names), 0, 0
        part: list[str] = []
        packed: list[str] = []  # what part held before: pieces are small, and each would cost more than its text
        ord_, opens = 0, False
        out: list[tuple] = []

        def pack() -> None:
            packed.append(_PREFIX.sub(r"\1", "".join(part)))
            part.clear()

        def ended(closes: bool) -> None:
            pack()
            out.append((number, ord_, opens, closes, "".join(packed)))
            packed.clear()

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2]), pa.array(columns[3]), pa.array(columns[4], pa.string())], names=["split", "ord", "opens", "closes", "text"])

        for batch in batches:
            size = 0
            for file, start, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, start) != at:
                    if part or packed:
                        ended(False)
                    at, tag = (file, start), 0
                    number, comment, depth = known[at]
                    reader = Reader(names, comment, depth)
                    ord_, opens = (number << SPLIT_BITS), False
                tag += 1
                before = reader.depth
                change, whole = reader.step(piece)
                if before == 0 and (change == 1 or whole):
                    ord_, opens = (number << SPLIT_BITS) + 2 * tag, True
                    piece = piece[piece.rfind("<") :]
                if before or change == 1 or whole:
                    part.append(piece + ">")
                    size += len(piece)
                    if reader.depth == 0:
                        ended(True)
                    elif len(part) >= PIECES:
                        pack()
            if out:
                yield batch_of()
        if part or packed:
            ended(False)
        if out:
            yield batch_of()

    return run


def elements(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """ord, text: the outermost elements of the names, their tags without
    prefixes of namespaces. ord rises with their order in a file, and between two of them
    there is room for a number for each tag."""
    pieces = _pieces(spark, path)
    known = begins(pieces, names)
    parts = settle(pieces.mapInArrow(_cut(names, known), "split long, ord long, opens boolean, closes boolean, text string"), "elements")
    whole = parts.filter("opens and closes").select("ord", "text")
    torn = parts.filter("not (opens and closes)")
    # of a split at most two parts are torn: its first and its last
    marks = sorted((r.split, r.ord, r.opens) for r in torn.select("split", "ord", "opens").collect())
    owner, rows = None, []
    for split, ord_, opens in marks:
        owner = ord_ if opens else owner
        rows.append((split, ord_, owner))
    if not rows:
        return whole
    owners = spark.createDataFrame(rows, "split long, ord long, owner long")
    joined = torn.join(F.broadcast(owners), ["split", "ord"]).groupBy(F.col("owner").alias("ord")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "text"))), lambda x: x["text"]), "").alias("text")
    )
    return whole.unionByName(joined.filter("ord is not null"))
