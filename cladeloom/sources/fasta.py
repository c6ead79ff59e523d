"""FASTA records as rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequences import K, sanitise
from .files import compressed_otherwise, expand
from .ranges import SCHEMES, SPLIT, records

SCHEMA = "ord long, id string, header string, seq string"


def read_fasta(spark: SparkSession, *paths: str, split: int = SPLIT) -> DataFrame:
    """ord, id (first word of the header), header, seq of every record. Files
    are plain, gzip, bzip2 or xz, whatever their names say, and are read in
    ranges of `split` bytes by many tasks; ord follows the records of a file.
    Files of schemes that tasks cannot open come through Spark's readers."""
    schemes = {p.split("://")[0].split(":")[0] if ":" in p.split("/")[0] else spark.conf.get("spark.hadoop.fs.defaultFS", "file:").split(":")[0] for p in paths}
    if schemes <= set(SCHEMES):
        raw = records(spark, *paths, split=split).withColumn("r", F.regexp_replace("r", "^\\s*>?", ""))
    else:
        raw = _through_readers(spark, *paths).withColumn("ord", F.monotonically_increasing_id())
    cut = F.regexp_extract("r", r"^([^\r\n]*)[\r\n]*([\s\S]*)$", 1), F.regexp_extract("r", r"^([^\r\n]*)[\r\n]*([\s\S]*)$", 2)
    rows = raw.filter(F.length(F.trim("r")) > 0).select("ord", cut[0].alias("header"), F.translate(cut[1], " \t\r\n>", "").alias("seq"))
    return rows.select(
        "ord", F.regexp_extract("header", r"^\s*(\S*)", 1).alias("id"), F.trim("header").alias("header"), "seq"
    )


def _through_readers(spark: SparkSession, *paths: str) -> DataFrame:
    """r: records by the text reader, which splits plain files and knows gz and
    bz2 by name; files that it cannot open are read one by one."""
    packed = [p for p in paths if compressed_otherwise(spark, p)]
    plain = [p for p in paths if p not in packed]
    parts = []
    if plain:
        parts.append(spark.read.option("lineSep", "\n>").text(plain).select(F.regexp_replace("value", "^\\s*>?", "").alias("r")))
    if packed:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column("content").to_pylist():
                    text = expand(data).decode("utf-8")
                    yield pa.RecordBatch.from_arrays([pa.array([x.removeprefix(">") for x in text.split("\n>")], pa.string())], names=["r"])

        parts.append(spark.read.format("binaryFile").load(packed).select("content").mapInArrow(run, "r string"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def read_queries(spark: SparkSession, path: str, k: int = K, reduced: bool = False) -> DataFrame:
    """ord, qseqid, seq: sanitised, records of fewer than k residues left out."""
    rows = read_fasta(spark, path).filter(F.length("seq") >= k)
    return rows.select("ord", F.col("id").alias("qseqid"), sanitise(F.col("seq"), reduced).alias("seq"))
