"""Helpers shared by the text operators: shared scratch tables, Arrow access
to whole texts as bytes, row removal by id."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


FILTER_BITS = 1 << 26  # of a broadcast Bloom filter
ROW_GROUP = 8 << 20  # bytes of a scratch table that a writing task holds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``
    of the session, else the context's checkpoint folder. Only where neither
    is set and all tasks run in this process (tests) a temporary folder
    becomes both; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get().rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = "file://" + tempfile.mkdtemp(prefix="cladeloom-")
    spark.sparkContext.setCheckpointDir(base)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/cladeloom/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage,
    survives lost executors, and gives later joins true sizes to plan with."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.options(**{"parquet.block.size": ROW_GROUP, **options}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise, once nothing lazy
    reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    roots = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for root in roots:
        if "/cladeloom/" not in root:
            continue
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def as_bytes(column: pa.Array) -> pa.Array:
    """A string column as binary without decoding; null becomes empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return column.fill_null(b"") if column.null_count else column


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `limit` text bytes (one row at
    least), so that a task's memory does not follow the batch size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        first = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        yield batch.slice(first)


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(raw: bytes, limit: int = 1 << 22) -> Iterator[bytes]:
    """raw in parts of about `limit` bytes that begin at a blank, so that no
    word is cut and the words of one part at a time are held."""
    at = 0
    while len(raw) - at > limit:
        blank = _BLANK.search(raw, at + limit)
        if blank is None:
            break
        yield raw[at : blank.start()]
        at = blank.start()
    yield raw[at:] if at else raw


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20, rows: int = 256) -> Iterator[None]:
    """While an action runs, Arrow batches of about `size` bytes at most and
    `rows` rows at once from Parquet: a batch of long texts is held by the JVM
    and by the worker at once, in whole arrays of it."""
    keys = {"spark.sql.execution.arrow.maxBytesPerBatch": str(size), "spark.sql.parquet.columnarReaderBatchSize": str(rows)}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def released(run: Callable) -> Callable:
    """run, after which the worker gives the memory of its batches back to the
    system: workers live as long as the session, and many stages use them."""

    @wraps(run)
    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim is not None:
                trim(0)

    return through


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def join_hot(left: DataFrame, right: DataFrame, on: list[str], number: str, rows: int, parts: int = 1000, how: str = "inner") -> DataFrame:
    """left joined (inner or left) to right (one row for each key, `number` =
    how many rows of left have it) where a key may hold a large share of
    left's `rows`. Null keys find nothing.

    Keys of more than rows / parts rows (rounded to a power of two) are hot;
    there are fewer than 2 * `parts` of them, so they can always be broadcast,
    and their rows stay where they are. The others are joined by a shuffle, in
    which no key is large.
    """
    least = 1 << max(0, rows // parts).bit_length() >> 1  # few thresholds, so that compiled plans serve again
    hot = right.filter(F.col(number) > least)
    (mark,) = fresh(left.columns + right.columns, "__hot")
    marked = left.join(F.broadcast(hot.withColumn(mark, F.lit(True))), on, "left")
    cold = marked.filter(F.col(mark).isNull()).select(*left.columns).join(right.filter(F.col(number) <= least), on, how)
    names = [*left.columns, *(c for c in right.columns if c not in on)]
    return marked.filter(F.col(mark)).select(*names).unionByName(cold.select(*names))


def text_tag(text: Column) -> Column:
    """SHA-256 of a whole text as it stands; null counts as empty."""
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def named_id(c: Column, null: str, text: str) -> list[Column]:
    """An identifier as two columns that are never null."""
    return [c.isNull().alias(null), F.coalesce(c.cast("string"), F.lit("")).alias(text)]


def maybe_among(docs: DataFrame, ids: DataFrame, names: list[str], id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose id is surely not one of ids (with named_id's two
    columns, called `names`), and the others; both have those columns. A Bloom
    filter of 16 bits for each id, FILTER_BITS at most, is broadcast in words
    of 64 bits; a full one only lets more rows be asked about."""
    word, bits = fresh([*docs.columns, *names], "__word", "__bits")
    size = min(FILTER_BITS, max(64, 1 << (16 * ids.count()).bit_length()))  # few sizes, so that compiled plans serve again
    place = F.pmod(F.xxhash64(*names), F.lit(size))
    at, bit = F.floor(place / 64).alias(word), (place % 64).cast("int")
    words = ids.select(at, F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias(bits)).groupBy(word).agg(F.bit_or(bits).alias(bits))
    probed = docs.select("*", *named_id(F.col(id_col), *names)).withColumn(word, at).join(F.broadcast(words), word, "left")
    maybe = F.coalesce(F.getbit(bits, bit) == 1, F.lit(False))
    return probed.filter(~maybe).drop(word, bits), probed.filter(maybe).drop(word, bits)


def keep_rows(docs: DataFrame, verdict: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that verdict (id, tag, stay, rows; one row for each id
    and text_tag, stay 0 or 1) lets stay.

    Only rows whose id may be one from which rows go are shuffled, with their
    texts; a Bloom filter of those ids (over 16 bits for each, FILTER_BITS at
    most) is broadcast in words of 64 bits, and what it rules out stays where
    it is.
    A full filter lets more rows pass and loses none.

    Rows are found by id and tag together, so a hot text is spread by its ids
    and a repeated id by its texts; rows that repeat both are found by a
    broadcast where they are many. Of them one stays, the least in the order
    of all columns. Null ids match each other.
    """
    n, k, t, stay, rows, row = fresh(docs.columns, "__n", "__k", "__t", "__stay", "__rows", "__row")
    v = verdict.filter("stay < rows").select(*named_id(F.col("id"), n, k), F.col("tag").alias(t), F.col("stay").alias(stay), F.col("rows").alias(rows))
    most = verdict.agg(F.sum("rows")).first()[0]
    untouched, probed = maybe_among(docs, v, [n, k], id_col)
    asked = materialise(probed.select(*docs.columns, n, k, text_tag(F.col(text_col)).alias(t)), "asked")
    joined = join_hot(asked, v, [n, k, t], rows, most or 0, how="left")
    free = untouched.select(*docs.columns).unionByName(joined.filter(F.col(stay).isNull()).select(*docs.columns))
    if v.filter(F.col(stay) > 0).isEmpty():
        return free
    some = joined.filter(F.col(stay) > 0).groupBy(n, k, t).agg(F.min(F.struct(*docs.columns)).alias(row))
    return free.unionByName(some.select(f"{row}.*"))
