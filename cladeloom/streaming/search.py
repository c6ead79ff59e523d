"""Search over a stream of query files.

New FASTA files in a folder are placed as they come. A query's result depends
on the query alone, so each micro-batch is one batch search with the same plan
and there is no state. A batch writes a folder of its own, over what an
earlier attempt at it left, so every file's results are there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.sequences import sanitise
from ..plans.engine import Database, search_table
from ..sources.results import shaped


def records(raw: DataFrame) -> DataFrame:
    """header, seq of text split at record starts."""
    body = F.regexp_replace("value", "^\\s*>?", "")
    return raw.select(F.regexp_extract(body, r"^\s*(\S*)", 1).alias("qseqid"), F.translate(F.regexp_extract(body, r"^[^\r\n]*[\r\n]*([\s\S]*)$", 1), " \t\r\n>", "").alias("seq"))


def search_stream(db: Database, folder: str, out: str, checkpoint: str, files_per_batch: int = 100, available_now: bool = True, **options) -> StreamingQuery:
    """Place the FASTA files of `folder`; Parquet under `out`, by batch."""
    k, reduced = db.k, db.reduced
    raw = db.spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_batch).text(folder)

    def place(batch: DataFrame, number: int) -> None:
        queries = records(batch).filter(F.length("seq") >= k).select(F.monotonically_increasing_id().alias("ord"), "qseqid", sanitise(F.col("seq"), reduced).alias("seq"))
        shaped(search_table(db, queries, **options)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = raw.writeStream.foreachBatch(place).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()
