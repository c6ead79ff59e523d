"""Opening what may be compressed, and file checksums."""

from __future__ import annotations

import bz2
import gzip
import lzma

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The first bytes of each kind of compressed file.
MAGIC = {b"\x1f\x8b": gzip.decompress, b"BZh": bz2.decompress, b"\xfd7zXZ\x00": lzma.decompress}

#: The names by which the text reader knows them.
NAMED = {b"\x1f\x8b": ".gz", b"BZh": ".bz2"}


def expand(data: bytes) -> bytes:
    """Plain bytes of a file's content, whatever its name says."""
    for magic, how in MAGIC.items():
        if data.startswith(magic):
            return how(data)
    return data


def _files(spark: SparkSession, path: str) -> list:
    """The file system and status of each file that the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [f for s in fs.globStatus(where) or [] for f in ([s] if s.isFile() else fs.listStatus(s.getPath()))]
    return [(fs, f) for f in found if f.isFile() and not f.getPath().getName().startswith(("_", "."))]


def file_sizes(spark: SparkSession, path: str) -> list[int]:
    return [f.getLen() for _, f in _files(spark, path)]


def compressed_otherwise(spark: SparkSession, path: str) -> bool:
    """Whether files of the path begin like a compressed file that the text
    reader would not know by its name. Looks at a few bytes of each."""
    for fs, f in _files(spark, path):
        stream = fs.open(f.getPath())
        try:
            head = bytes(b for b in (stream.read() for _ in range(6)) if b >= 0)
        finally:
            stream.close()
        kind = next((m for m in MAGIC if head.startswith(m)), None)
        if kind is not None and not f.getPath().getName().endswith(NAMED.get(kind, "\0")):
            return True
    return False


def read_small(spark: SparkSession, path: str) -> str:
    """A whole file of metadata size (a tree, a list) as text."""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    if row is None:
        raise FileNotFoundError(path)
    return expand(bytes(row.content)).decode("utf-8")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, length, md5 of files, computed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.md5("content").alias("md5"))
