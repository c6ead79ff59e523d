"""The database as a folder of Parquet tables, and the commands on it."""

from __future__ import annotations

import hashlib
import uuid
import warnings
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import statistics as st
from ..functions.identifiers import protein_id
from ..functions.sequences import K, check_k, kmer_code, sanitise
from ..operators import build, hierarchy, index
from ..operators import search as srch
from ..operators.shared import settle, spread
from ..sources import browser, fasta, newick, orthoxml, results
from ..sources.files import checksums, file_sizes, read_small

SCHEMA_VERSION = "1.1"
TABLES = ("taxa", "groups", "families", "members", "postings", "metadata")


@dataclass
class Database:
    """Tables: taxa(name, parent, level, path, ncbi_id), groups(hog_id, ext_id,
    fam_id, parent, depth, path, pre, level, n_genes, completeness,
    median_seqlen, hog_prob), families(fam_id, fam_prob, root), members(ext_id,
    species, hog_id, seq_len), postings(code, fam_id, hog_id) in buckets of
    the code, metadata(key, value)."""

    spark: SparkSession
    path: str
    data: str  # the folder of this snapshot's tables
    said: str  # and of its metadata

    def table(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise KeyError(name)
        if name == "postings":
            return self._postings()
        return self.spark.read.parquet(self.said if name == "metadata" else f"{self.data}/{name}")

    def _postings(self) -> DataFrame:
        said = self.settings()
        if "postings buckets" not in said:  # schema 1.0: sorted by the k-mer itself
            old = self.spark.read.parquet(f"{self.data}/postings")
            return old.select(kmer_code(F.col("kmer"), int(said["k-mer length"]), said["alphabet size"] == "13").alias("code"), "fam_id", "hog_id")
        return index.stored(self.spark, f"{self.data}/postings", int(said["postings buckets"]))

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        raise AttributeError(name)

    def settings(self) -> dict[str, str]:
        return {r.key: r.value for r in self.metadata.collect()}

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Database:
        """Same version: opened; an older minor one: opened with a warning;
        a newer one or another major one: an error."""
        newest = snapshots(spark, path)[-1:]
        said = f"{path}/snapshots/{newest[0]:06d}" if newest else f"{path}/metadata"  # schema 1.0 had one version
        place = {r.key: r.value for r in spark.read.parquet(said).collect()}.get("data folder")
        db = cls(spark, path, f"{path}/{place}" if place else path, said)
        found = db.settings().get("schema version", "0.0")
        major, minor = (int(x) for x in found.split("."))
        ours = tuple(int(x) for x in SCHEMA_VERSION.split("."))
        if major != ours[0] or minor > ours[1]:
            raise ValueError(f"the database has schema {found}, this is {SCHEMA_VERSION}")
        if minor < ours[1]:
            warnings.warn(f"the database has the older schema {found}", stacklevel=2)
        return db

    @property
    def k(self) -> int:
        return int(self.settings()["k-mer length"])

    @property
    def reduced(self) -> bool:
        return self.settings()["alphabet size"] == "13"


def snapshots(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the published versions, oldest first: those whose
    metadata was written to its end."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/snapshots/*/_SUCCESS")
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(f.getPath().getParent().getName()) for f in store.globStatus(folder) or [])


def create(
    spark: SparkSession, path: str, levels: DataFrame, entries: DataFrame, records: DataFrame, taxa: DataFrame, k: int = K, reduced: bool = False,
    min_size: int = build.MIN_SIZE, min_completeness: float = build.MIN_COMPLETENESS, logic: str = "OR", root_taxon: str | None = None,
    include_younger: bool = True, hidden: list[str] | None = None, known_taxa: DataFrame | None = None, source: str = "tables", overwrite: bool = False,
) -> Database:
    """Build a database under `path`, as a version of its own: its tables go to
    a new folder, and the metadata, written last, publishes it. Until then, and
    for readers that have opened it, the version before stands. Where there is
    one, `overwrite` must be asked for; old versions' files stay.

    levels(fam, id, level, completeness, n_genes, ord); entries(prot_id,
    species, group); records(header, id, seq) as read; taxa(name, parent,
    level, path of names)."""
    check_k(k)
    before = snapshots(spark, path)
    if before and not overwrite:
        raise FileExistsError(path)
    if before:
        warnings.warn(f"a new version replaces the database {path}", stacklevel=2)
    folder = f"data-{uuid.uuid4().hex[:12]}"
    place = f"{path}/{folder}"
    if root_taxon is not None and taxa.filter(F.col("name") == root_taxon).count() != 1:
        raise ValueError(f"the root taxon {root_taxon} is not in the taxonomy exactly once")
    scope = build.prune(taxa, root_taxon)
    if known_taxa is not None:
        scope = build.taxon_numbers(scope, known_taxa)
    scope = settle(scope if "ncbi_id" in scope.columns else scope.withColumn("ncbi_id", F.lit(None).cast("int")), "taxa")
    selected = build.select_groups(levels, scope, min_size, min_completeness, logic, root_taxon, include_younger)
    groups = settle(build.number_groups(selected), "groups")

    placed = settle(build.place_members(entries, groups), "members")
    build.check_entries(placed)
    clean = records.withColumn("seq", sanitise(F.col("seq")))  # the full alphabet, whatever is indexed
    members = settle(build.match_sequences(placed, clean), "sequences")
    build.check_sequences(members)
    members = members.withColumn("seq_len", F.length("seq"))

    asked = hidden or []
    unseen = build.hidden_species(taxa, asked)
    to_index = spread(members, "prot_id").withColumn("seq", sanitise(F.col("seq"), reduced))
    postings = settle(index.build(to_index, groups, k, unseen if asked else None, reduced), "postings")
    family = index.family_probability(postings)
    roots = groups.filter("parent is null").select("fam_id", F.col("hog_id").alias("root"))
    full = groups.join(index.group_probability(postings, groups), "hog_id").join(build.median_lengths(members, groups), "hog_id", "left").select(
        "hog_id", F.col("source_id").alias("source_id"), F.col("label").alias("ext_id"), "fam_id", "parent", "depth", "path", "pre", F.col("tax").alias("level"),
        "n_genes", "completeness", "median_seqlen", "hog_prob",
    )
    tables = {
        "taxa": scope, "groups": full, "families": roots.join(family, "fam_id", "left").fillna(0.0, ["fam_prob"]),
        "members": members.select(F.col("prot_id").alias("ext_id"), "species", "hog_id", "seq_len"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{place}/{name}")
    _, buckets = index.store(postings, f"{place}/postings")
    top = root_taxon or scope.filter("parent is null").first().name
    said = {
        "schema version": SCHEMA_VERSION, "data folder": folder, "source": source, "root level": top, "create timestamp": datetime.now().isoformat(),
        "min fam size": str(min_size), "min fam completeness": str(min_completeness), "filter logic": logic, "include younger fams": str(include_younger),
        "k-mer length": str(k), "postings buckets": str(buckets), "alphabet size": str(13 if reduced else 21),
        "nr species": str(hierarchy.all_leaves(scope, "name", "parent").count()),
        "nr indexed species": str(build.visible_species(scope, unseen)), "hidden taxa": ",".join(asked) or "-",
    }
    said["database hash"] = table_hash(spark, place)
    spark.createDataFrame(list(said.items()), "key string, value string").coalesce(1).write.parquet(f"{path}/snapshots/{max(before, default=0) + 1:06d}")
    return Database.open(spark, path)


def table_hash(spark: SparkSession, path: str) -> str:
    """MD5 of the sorted checksums of the data files, before the metadata is written."""
    sums = checksums(spark, ",".join([f"{path}/*/*.parquet"])).select("md5").orderBy("md5")
    h = hashlib.md5()
    for r in sums.toLocalIterator():
        h.update(r.md5.encode())
    return h.hexdigest()


def create_from_orthoxml(spark: SparkSession, path: str, orthoxml_path: str, tree_path: str, sequence_paths: list[str], references: list[str] | None = None, **options) -> Database:
    """Build from an OrthoXML file, a Newick species tree and FASTA files."""
    taxa = newick.taxa_table(newick.read_tree(spark, tree_path))
    root = options.get("root_taxon")
    scope = build.prune(taxa, root)
    genes = settle(orthoxml.read_genes(spark, orthoxml_path), "genes")
    if references:
        extra = orthoxml.read_references(spark, *references)
        found = build.resolve_references(genes.select("gene", F.col("prot_id").alias("ref")), genes.select("gene", F.col("prot_id").alias("name")), extra)
        genes = genes.join(found.select("gene", "xref"), "gene").withColumn("prot_id", F.col("xref")).drop("xref")
    of_gene = genes.select("gene", "species").dropDuplicates(["gene"])
    grouped = orthoxml.read_groups(spark, orthoxml_path).join(of_gene, "gene")
    below = hierarchy.all_leaves(scope, "name", "parent").select(F.explode("path").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n_below"))
    sizes = build.group_sizes(grouped, below)
    inside = orthoxml.read_members(spark, orthoxml_path).join(of_gene, "gene").join(scope.select(F.col("name").alias("species")), "species", "left_semi")
    levels = sizes.unionByName(build.gene_levels(inside))
    names = genes.select("gene", "prot_id").dropDuplicates(["gene"])
    entries = inside.join(names, "gene").select("prot_id", "species", F.col("id").alias("group"))
    known = genes.filter("ncbi_id is not null").groupBy(F.col("species").alias("name")).agg(F.min("ncbi_id").alias("ncbi_id"))
    records = fasta.read_fasta(spark, *sequence_paths)
    return create(spark, path, levels, entries, records, taxa, known_taxa=known, source="orthoxml", **options)


def create_from_browser(spark: SparkSession, path: str, levels: DataFrame, genomes: DataFrame, entries: DataFrame, taxonomy: DataFrame, taxa: DataFrame, **options) -> Database:
    """Build from the browser's tables, however they were exported.

    levels(fam, id, level, completeness, n_genes, ord); genomes(code, sci_name,
    ncbi_id, entry_off, n_entries); entries(entry_nr, code, group, seq) with
    the code of their genome (without it, it is found by the genomes' ranges of
    entry numbers); taxonomy(name, ncbi_id); taxa as create has them. A genome
    is known in the tree by its scientific name, else by its code."""
    in_tree = taxa.select(F.col("name").alias("known"))
    found = genomes.join(F.broadcast(in_tree), F.col("sci_name") == F.col("known"), "left")
    by_code = found.filter("known is null").drop("known").join(F.broadcast(in_tree), F.col("code") == F.col("known"))
    species = found.filter("known is not null").select("code", "entry_off", F.col("known").alias("species")).unionByName(by_code.select("code", "entry_off", F.col("known").alias("species")))
    if "code" not in entries.columns:
        ranges = genomes.select(F.col("code").alias("species"), (F.col("entry_off") + 1).alias("min_id"), (F.col("entry_off") + F.col("n_entries")).alias("max_id"))
        entries = build.species_of_genes(entries.withColumnRenamed("entry_nr", "gene"), ranges).withColumnRenamed("gene", "entry_nr").withColumnRenamed("species", "code")
    named = entries.join(species, "code").select(
        protein_id(F.col("code"), F.col("entry_nr") - F.col("entry_off")).alias("prot_id"), "species", "group", F.rtrim("seq").alias("seq")
    )
    named = settle(named, "entries")
    codes = genomes.select(F.col("code").alias("name"), F.col("ncbi_id").alias("by_code"))
    numbers = taxa.select("name").join(taxonomy.groupBy("name").agg(F.min("ncbi_id").alias("by_name")), "name", "left").join(codes, "name", "left")
    known = numbers.select("name", F.when(F.col("name") == "LUCA", 0).otherwise(F.coalesce("by_name", "by_code")).cast("int").alias("ncbi_id")).filter("ncbi_id is not null")
    records = named.select(F.col("prot_id").alias("header"), F.col("prot_id").alias("id"), "seq")
    return create(spark, path, levels, named.select("prot_id", "species", "group"), records, taxa, known_taxa=known, source="browser", **options)


def create_from_browser_files(spark: SparkSession, path: str, folder: str, tree_path: str | None = None, **options) -> Database:
    """Build from the browser's tables in Parquet (sources/browser.py); the
    species tree is the folder's speciestree.nwk, if no other is named."""
    taxa = newick.taxa_table(newick.read_tree(spark, tree_path or f"{folder}/speciestree.nwk"))
    found = browser.read_browser(spark, folder)
    return create_from_browser(spark, path, found.levels, found.genomes, found.entries, found.taxonomy, taxa, **options)


def search_table(db: Database, queries: DataFrame, reference_taxon: str | None = None, include_extant_genes: bool = False, **options) -> DataFrame:
    """Results for queries(ord, qseqid, seq), sanitised."""
    closest = None
    if reference_taxon is not None:
        line = db.taxa.filter(F.col("name") == reference_taxon).select("path").collect()
        if len(line) != 1:
            raise ValueError(f"the reference taxon {reference_taxon} is not in the taxonomy exactly once")
        lineage = F.array(*[F.lit(x) for x in line[0].path])
        closest = hierarchy.closest_taxon(db.groups.select("hog_id", "parent", F.col("level").alias("tax")), lineage)
    members = db.members.select("hog_id", "ext_id") if include_extant_genes else None
    return srch.search(queries, db.postings, db.groups, db.families, db.k, reduced=db.reduced, members=members, closest=closest, **options)


def search_file(db: Database, query_path: str, out: str | None = None, **options) -> DataFrame:
    """Results for a FASTA file; with `out` also written as one result file.
    A file that is not there or holds nothing is an error before any search."""
    if not file_sizes(db.spark, query_path):
        raise FileNotFoundError(query_path)
    if not sum(file_sizes(db.spark, query_path)):
        raise ValueError(f"the query file {query_path} is empty")
    found = search_table(db, fasta.read_queries(db.spark, query_path, db.k, db.reduced), **options)
    if out is not None:
        said = db.settings()
        header = {"query-md5": checksums(db.spark, query_path).first().md5, "date-run": datetime.now().isoformat(), "db-path": db.path}
        header |= {f"db-info-{k.replace(' ', '_')}": said[k] for k in ("source", "root level", "database hash") if k in said}
        found = settle(found, "results")
        results.save_results(found, out, header)
    return found


def info(db: Database) -> list[tuple[str, str]]:
    return sorted(db.settings().items())


def read_names(spark: SparkSession, path: str) -> list[str]:
    """One name for each line (hidden taxa)."""
    return [x.strip() for x in read_small(spark, path).splitlines() if x.strip()]
