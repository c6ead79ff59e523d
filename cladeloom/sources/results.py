"""Search results as tab-separated text with a preamble of !key: value lines."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a result file, their types, the mark for null.
COLUMNS = (
    ("qseqid", "string"), ("hogid", "string"), ("hoglevel", "string"), ("family_p", "double"), ("family_count", "long"), ("family_normcount", "double"),
    ("subfamily_score", "double"), ("subfamily_count", "long"), ("qseqlen", "long"), ("subfamily_medianseqlen", "long"), ("qseq_overlap", "double"),
)
OPTIONAL = ("subfamily_geneset", "closest_taxa")
NULL = "N/A"


def shaped(results: DataFrame) -> DataFrame:
    """The columns of a result file, in their order."""
    names = [n for n, _ in COLUMNS] + [n for n in OPTIONAL if n in results.columns]
    return results.select(*names)


def write_results(results: DataFrame, path: str) -> None:
    """A folder of part files, each with the column header: written in parallel."""
    shaped(results).write.csv(path, sep="\t", header=True, nullValue=NULL, emptyValue="", quote="")


def lines(results: DataFrame, metadata: dict[str, str] | None = None, header: bool = True) -> Iterable[str]:
    """The text of one result file in the order of queries and ranks, fetched
    partition by partition. Without rows there is no preamble and no header."""
    rows = results.orderBy("ord", "rank") if {"ord", "rank"} <= set(results.columns) else results
    table, first = shaped(rows), True
    for r in table.toLocalIterator(prefetchPartitions=False):
        if first and header:
            for k, v in (metadata or {}).items():
                yield f"!{k}: {v}\n"
            yield "\t".join(table.columns) + "\n"
        first = False
        yield "\t".join(NULL if v is None or (isinstance(v, float) and math.isnan(v)) else str(v) for v in r) + "\n"


def save_results(results: DataFrame, file: str, metadata: dict[str, str] | None = None, header: bool = True) -> None:
    """One file on the driver's machine, streamed."""
    with open(file, "w", encoding="utf-8") as out:
        out.writelines(lines(results, metadata, header))


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The rows of a result file, and its preamble. The first ': ' of a line
    parts key and value, which may hold more."""
    raw = spark.read.text(path)
    head = raw.filter(F.startswith("value", F.lit("!"))).collect()
    metadata = dict(r.value[1:].split(": ", 1) for r in head if ": " in r.value)
    names = (raw.filter(~F.startswith("value", F.lit("!"))).first() or [""])[0].split("\t")
    kinds = dict(COLUMNS)
    schema = ", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)
    rows = spark.read.csv(path, sep="\t", header=True, comment="!", nullValue=NULL, schema=schema, quote="")
    return rows, metadata
