"""python -m cladeloom mkdb | search | info"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .plans import engine
from .sources.results import lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cladeloom")
    sub = top.add_subparsers(dest="command", required=True)
    mk = sub.add_parser("mkdb", help="build a database")
    mk.add_argument("--db", required=True)
    built_from = mk.add_mutually_exclusive_group(required=True)
    built_from.add_argument("--orthoxml", help="with --species_tree and --sequences")
    built_from.add_argument("--browser", help="folder of the browser's tables in Parquet, with speciestree.nwk or --species_tree")
    mk.add_argument("--species_tree")
    mk.add_argument("--sequences", nargs="+", default=[])
    mk.add_argument("--xrefs", nargs="*", default=[])
    mk.add_argument("--min_fam_size", type=int, default=6)
    mk.add_argument("--min_fam_completeness", type=float, default=0.5)
    mk.add_argument("--logic", choices=["AND", "OR"], default="OR")
    mk.add_argument("--root_taxon")
    mk.add_argument("--hidden_taxa", help="file with a taxon name on each line")
    mk.add_argument("--reduced_alphabet", action="store_true")
    mk.add_argument("--k", type=int, default=6)
    mk.add_argument("--overwrite", action="store_true", help="publish a new version of a database that exists")
    se = sub.add_parser("search", help="place query sequences")
    se.add_argument("--db", required=True)
    se.add_argument("--query", required=True)
    se.add_argument("--threshold", type=float, default=0.1)
    se.add_argument("--family_alpha", type=float, default=1e-6)
    se.add_argument("--family_only", action="store_true")
    se.add_argument("--top_n_fams", type=int, default=1)
    se.add_argument("--reference_taxon")
    se.add_argument("--include_extant_genes", action="store_true")
    se.add_argument("--out")
    inf = sub.add_parser("info", help="describe a database")
    inf.add_argument("--db", required=True)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "mkdb" and args.orthoxml and not (args.species_tree and args.sequences):
        top.error("--orthoxml needs --species_tree and --sequences")
    if args.command == "mkdb" and args.browser and (args.sequences or args.xrefs):
        top.error("--browser takes neither --sequences nor --xrefs")
    spark = spark or SparkSession.builder.appName("cladeloom").getOrCreate()
    if args.command == "mkdb":
        hidden = engine.read_names(spark, args.hidden_taxa) if args.hidden_taxa else None
        options = dict(
            k=args.k, reduced=args.reduced_alphabet, min_size=args.min_fam_size, min_completeness=args.min_fam_completeness, logic=args.logic,
            root_taxon=args.root_taxon, hidden=hidden, overwrite=args.overwrite,
        )
        if args.browser:
            engine.create_from_browser_files(spark, args.db, args.browser, args.species_tree, **options)
        else:
            engine.create_from_orthoxml(spark, args.db, args.orthoxml, args.species_tree, args.sequences, args.xrefs or None, **options)
        return 0
    db = engine.Database.open(spark, args.db)
    if args.command == "info":
        for k, v in engine.info(db):
            print(f"  {k:23s}:{v:>40}")
        return 0
    began = time.time()
    found = engine.search_file(
        db, args.query, args.out, reference_taxon=args.reference_taxon, include_extant_genes=args.include_extant_genes, threshold=args.threshold,
        alpha=args.family_alpha, top_n=args.top_n_fams, family_only=args.family_only,
    )
    if args.out is None:
        sys.stdout.writelines(lines(found, header=False))
    n = found.select("ord").distinct().count()
    print(f"{n} queries, {n / max(time.time() - began, 1e-9):.1f} a second", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())

