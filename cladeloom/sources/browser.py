"""The genome browser's five tables as Parquet: hog_level, genome, entries,
sequence_buffer, taxonomy, each a file or folder of that name.

The buffer holds all sequences end to end and comes in chunks of any size
(Start: place of the first byte, Bytes). An entry says where its sequence
begins and how long it is, with one byte more at its end. Each place finds its
chunk by a sorted merge, so chunks may differ in size, and a sequence is put
together from as many chunks as it crosses. No task holds the buffer.

Defined cases: a sequence of no residues is empty; a chunk of no bytes is
left out; chunks that overlap, and a sequence that the chunks do not hold
whole, are errors.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.build import species_of_genes
from ..operators.shared import number_rows


class Browser(NamedTuple):
    """The tables under the names that create_from_browser takes."""

    levels: DataFrame
    genomes: DataFrame
    entries: DataFrame
    taxonomy: DataFrame


def cut_sequences(entries: DataFrame, buffer: DataFrame) -> DataFrame:
    """entries(entry_nr, off, n, ..) with `seq`, the n bytes from off;
    buffer(start, data)."""
    key = ["entry_nr", "off", "n"]
    chunks = number_rows(buffer.select(F.col("start").cast("long").alias("start"), F.col("data").cast("binary").alias("data")).filter(F.octet_length("data") > 0), ["start"], "chunk")
    stop = F.col("start") + F.octet_length("data")
    ranges = chunks.select(F.col("chunk").alias("species"), F.col("start").alias("min_id"), (stop - 1).alias("max_id"))
    ends = entries.filter("n > 0").select(*key, F.explode(F.array(F.col("off"), F.col("off") + F.col("n") - 1)).alias("gene"))
    crossed = species_of_genes(ends, ranges).groupBy(*key).agg(F.min("species").alias("a"), F.max("species").alias("b"))
    low, high = F.greatest("off", "start"), F.least(F.col("off") + F.col("n"), stop)
    part = F.decode(F.substring(F.col("data"), (low - F.col("start") + 1).cast("int"), (high - low).cast("int")), "US-ASCII")
    parts = crossed.select(*key, F.explode(F.sequence("a", "b")).alias("chunk")).join(chunks, "chunk").select(*key, "chunk", part.alias("part"))
    whole = parts.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("chunk", "part")))["part"], "").alias("seq"))
    lacking = F.raise_error(F.concat(F.lit("the sequence buffer does not hold entry "), F.col("entry_nr").cast("string")))
    found = F.coalesce("seq", F.lit(""))
    return entries.join(whole, key, "left").withColumn("seq", F.when(F.length(found) == F.col("n"), found).otherwise(lacking))


def read_browser(spark: SparkSession, folder: str) -> Browser:
    """The tables as read, their columns under the browser's names."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    text = lambda name: F.col(name).cast("string")
    levels = read("hog_level").select(
        F.col("Fam").cast("long").alias("fam"), text("ID").alias("id"), text("Level").alias("level"), F.col("CompletenessScore").cast("double").alias("completeness"),
        F.col("NrMemberGenes").cast("long").alias("n_genes"),
    )
    genomes = read("genome").select(
        text("UniProtSpeciesCode").alias("code"), text("SciName").alias("sci_name"), F.col("NCBITaxonId").cast("int").alias("ncbi_id"),
        F.col("EntryOff").cast("long").alias("entry_off"), F.col("TotEntries").cast("long").alias("n_entries"),
    )
    entries = read("entries").select(
        F.col("EntryNr").cast("long").alias("entry_nr"), text("OmaHOG").alias("group"), F.col("SeqBufferOffset").cast("long").alias("off"),
        (F.col("SeqBufferLength").cast("long") - 1).alias("n"),
    )
    buffer = read("sequence_buffer").select(F.col("Start").alias("start"), F.col("Bytes").alias("data"))
    taxonomy = read("taxonomy").select(text("Name").alias("name"), F.col("NCBITaxonId").cast("int").alias("ncbi_id"))
    return Browser(number_rows(levels, ["fam", "id", "level"], "ord"), genomes, cut_sequences(entries, buffer).select("entry_nr", "group", "seq"), taxonomy)
