"""A small database built from OrthoXML, Newick and FASTA, and searched."""

from __future__ import annotations

import gzip
import lzma
import random

import pytest
from pyspark.sql import functions as F

from cladeloom.__main__ import main
from cladeloom.plans import engine
from cladeloom.sources import fasta, newick, orthoxml
from cladeloom.sources.results import read_results, save_results
from cladeloom.streaming.search import search_stream

TREE = "((A:1,B:1.5)AB:1,('C x':2,D:2)CD:0.5)LUCA;"
AA = "ACDEFGHIKLMNPQRSTVWY"


def rand_seq(rng, n):
    return "".join(rng.choice(AA) for _ in range(n))


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    """Two families; the first has a duplication below the root."""
    d = tmp_path_factory.mktemp("world")
    rng = random.Random(3)
    (d / "tree.nwk").write_text(TREE)
    genes = {"A": range(1, 11), "B": range(11, 21), "C x": range(21, 31), "D": range(31, 41)}
    sp = "".join(f'<species name="{s}" NCBITaxId="{i + 7}"><database name="x"><genes>' + "".join(f'<gene id="{g}" protId="P{g:03d}"/>' for g in ids) + "</genes></database></species>" for i, (s, ids) in enumerate(genes.items()))
    prop = lambda t: f'<property name="TaxRange" value="{t}"/>'
    og = lambda t, inner: f'<orthologGroup>{prop(t)}{inner}</orthologGroup>'
    ref = lambda *g: "".join(f'<geneRef id="{x}"/>' for x in g)
    fam1 = f'<orthologGroup id="HOG:0000005">{prop("LUCA")}<paralogGroup>{og("AB", ref(1, 11))}{og("AB", ref(2, 12))}</paralogGroup>{og("CD", ref(21, 31))}</orthologGroup>'
    fam2 = f'<orthologGroup id="9">{prop("LUCA")}{ref(3, 13, 22, 32)}</orthologGroup>'
    small = f'<orthologGroup id="11">{prop("AB")}{ref(4)}</orthologGroup>'
    (d / "groups.orthoxml").write_text(f'<orthoXML xmlns="http://orthoXML.org/2011/">{sp}<groups>{fam1}{fam2}{small}</groups></orthoXML>')
    base, one, two, other = (rand_seq(rng, n) for n in (120, 60, 60, 150))
    seqs = {1: base + one, 11: base + one, 2: base + two, 12: base + two, 21: base, 31: base, 3: other, 13: other, 22: other + "W", 32: other, 4: rand_seq(rng, 50)}
    text = "".join(f">P{g:03d} some words\n{s[:50]}\n{s[50:]}\n" for g, s in seqs.items())
    half = text.index(">P003")
    (d / "one.fa").write_text(text[:half])
    with gzip.open(d / "two.fa.gz", "wt") as f:
        f.write(text[half:])
    query = {"q1": base[:100] + one, "q2": base[:100] + two, "q3": base, "q4": rand_seq(rng, 80), "short": "ACD", "q5": "X" * 30, "q6": other.lower()}
    (d / "query.fa").write_text("".join(f">{n}\n{s}\n" for n, s in query.items()))
    return d


@pytest.fixture(scope="module")
def db(spark, world):
    return engine.create_from_orthoxml(spark, str(world / "db"), str(world / "groups.orthoxml"), str(world / "tree.nwk"), [str(world / "one.fa"), str(world / "two.fa.gz")], min_size=2, min_completeness=0.6, logic="AND")


def test_newick_round_trip():
    nodes = newick.parse(TREE)
    assert [(n, p) for _, n, p, _ in nodes] == [("LUCA", None), ("AB", 0), ("A", 1), ("B", 1), ("CD", 0), ("C x", 4), ("D", 4)]
    assert nodes[3][3] == 1.5
    assert newick.write(nodes, lengths=False) == "((A, B)AB, (C x, D)CD)LUCA;"
    with pytest.raises(ValueError):
        newick.parse("((A,B);")


def test_tree_levels(spark, world):
    taxa = {r.name: r for r in newick.taxa_table(newick.read_tree(spark, str(world / "tree.nwk"))).collect()}
    assert taxa["B"].level == 2 and taxa["C x"].level == 2 and taxa["CD"].level == 0
    assert taxa["A"].path == ["LUCA", "AB", "A"] and taxa["LUCA"].parent is None


def test_species_and_labels(spark, world):
    sp = {r.species: (r.min_id, r.max_id, r.ncbi_id) for r in orthoxml.read_species(spark, str(world / "groups.orthoxml")).collect()}
    assert sp["C x"] == (21, 30, 9)
    m = {r.gene: (r.fam, r.id) for r in orthoxml.read_members(spark, str(world / "groups.orthoxml")).collect()}
    assert m[1] == (5, "HOG:0000005.1a") and m[12] == (5, "HOG:0000005.1b") and m[21] == (5, "HOG:0000005") and m[3] == (9, "HOG:0000009")


def test_letters_and_nested_counters():
    import xml.etree.ElementTree as ET

    assert [orthoxml.letters(i) for i in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]
    top = ET.fromstring('<orthologGroup id="1"><paralogGroup><paralogGroup><geneRef id="1"/><geneRef id="2"/></paralogGroup><geneRef id="3"/></paralogGroup>'
                        '<paralogGroup><geneRef id="4"/><paralogGroup><geneRef id="5"/></paralogGroup></paralogGroup></orthologGroup>')
    _, _, label = orthoxml.labelled(top)
    got = {el.get("id"): v for el, v in label.items() if el.tag == "geneRef"}
    assert got == {"1": "1.1a.1a", "2": "1.1a.1b", "3": "1.1b", "4": "1.2a", "5": "1.2b.2a"}
    assert orthoxml.gene_of(top, 5).get("id") == "5" and orthoxml.gene_of(top, 9) is None
    assert orthoxml.annotations(top) == [{}] and orthoxml.levels_of(top) == []


def test_level_table(spark, tmp_path):
    from cladeloom.operators import build

    levels = spark.createDataFrame([(2, "b", "x"), (1, "a.1", "y"), (1, "a", "z"), (1, "a", "q")], "fam int, id string, level string")
    build.write_levels(levels, str(tmp_path / "lv"))
    got = build.level_map(spark.read.parquet(str(tmp_path / "lv")), 1)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "q", 0), ("a", "z", 1), ("a.1", "y", 2)]


def test_groups(db):
    g = {r.source_id: r for r in db.groups.collect()}
    assert set(g) == {"HOG:0000005", "HOG:0000005.1a", "HOG:0000005.1b", "HOG:0000009"}
    assert g["HOG:0000005"].ext_id == "1" and g["HOG:0000005.1b"].ext_id == "1.1b" and g["HOG:0000009"].ext_id == "2"
    assert g["HOG:0000005"].n_genes == 6 and g["HOG:0000005"].completeness == 1.0
    assert g["HOG:0000005.1a"].parent == g["HOG:0000005"].hog_id and g["HOG:0000005.1a"].level == "AB"
    assert g["HOG:0000005"].median_seqlen == 180 and g["HOG:0000009"].median_seqlen == 150
    fam = {r.fam_id: r.fam_prob for r in db.families.collect()}
    assert abs(sum(fam.values()) - 1) < 0.05


def test_search(db, world, tmp_path):
    out = str(tmp_path / "res.tsv")
    found = {r.qseqid: r for r in engine.search_file(db, str(world / "query.fa"), out, alpha=1e-2, include_extant_genes=True).collect()}
    assert set(found) == {"q1", "q2", "q3", "q4", "q5", "q6"}
    assert found["q1"].hogid == "1.1a" and found["q2"].hogid == "1.1b" and found["q3"].hogid == "1" and found["q6"].hogid == "2"
    assert found["q4"].hogid is None and found["q5"].hogid is None and found["q5"].qseqlen == 31
    assert found["q1"].subfamily_geneset == "P001,P011" and found["q1"].qseqlen == 161
    rows, meta = read_results(db.spark, out)
    back = {r.qseqid: r for r in rows.collect()}
    assert meta["db-path"] == db.path and "query-md5" in meta and meta["db-info-root_level"] == "LUCA"
    assert back["q1"].hogid == "1.1a" and back["q4"].hogid is None and abs(back["q1"].family_p - found["q1"].family_p) < 1e-9


def test_family_only_top_n_and_reference_taxon(db, world):
    only = {r.qseqid: r for r in engine.search_file(db, str(world / "query.fa"), family_only=True, alpha=1e-2).collect()}
    assert only["q1"].hogid == "1" and only["q1"].subfamily_score is None and only["q1"].subfamily_count is None
    ref = {r.qseqid: r for r in engine.search_file(db, str(world / "query.fa"), reference_taxon="A", alpha=1e-2).collect()}
    assert ref["q1"].closest_taxa == "A" and ref["q6"].closest_taxa == "A" and ref["q3"].closest_taxa == "LUCA"


def test_hidden_taxa_and_reduced_alphabet(spark, world):
    args = (str(world / "groups.orthoxml"), str(world / "tree.nwk"), [str(world / "one.fa"), str(world / "two.fa.gz")])
    hid = engine.create_from_orthoxml(spark, str(world / "db2"), *args, min_size=2, min_completeness=0.6, logic="AND", hidden=["AB"], reduced=True)
    said = dict(engine.info(hid))
    assert said["nr species"] == "4" and said["nr indexed species"] == "2" and said["hidden taxa"] == "AB" and said["alphabet size"] == "13"
    g = {r.source_id: r for r in hid.groups.collect()}
    assert g["HOG:0000005"].n_genes == 6 and g["HOG:0000005.1a"].hog_prob == 0
    found = {r.qseqid: r for r in engine.search_file(hid, str(world / "query.fa"), alpha=1e-2).collect()}
    assert found["q1"].hogid == "1" and found["q6"].hogid == "2"
    with pytest.raises(ValueError):
        engine.create_from_orthoxml(spark, str(world / "db3"), *args, hidden=["nobody"])
    with pytest.raises(ValueError):
        engine.create_from_orthoxml(spark, str(world / "db4"), *args, k=8)


def test_stream(db, world, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text((world / "query.fa").read_text())
    run = lambda: search_stream(db, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), alpha=1e-2).awaitTermination()
    run()
    (tmp_path / "in" / "b.fa").write_text(">again\n" + (world / "query.fa").read_text().split("\n")[1] + "\n")
    run()
    got = {(r.qseqid, r.batch): r.hogid for r in db.spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[("q1", 0)] == "1.1a" and got[("again", 1)] == "1.1a" and len(got) == 7


def test_query_files(spark, db, world, tmp_path):
    """Missing and empty files are errors; a gz file needs no name that says so."""
    import gzip

    with pytest.raises(FileNotFoundError):
        engine.search_file(db, str(tmp_path / "none.fa"))
    (tmp_path / "empty.fa").write_text("")
    with pytest.raises(ValueError):
        engine.search_file(db, str(tmp_path / "empty.fa"))
    (tmp_path / "packed").write_bytes(gzip.compress((world / "query.fa").read_bytes()))
    names = lambda p: sorted(r.qseqid for r in fasta.read_queries(spark, str(p)).collect())
    assert names(tmp_path / "packed") == names(world / "query.fa")


def test_species_are_read_without_groups(spark, tmp_path):
    (tmp_path / "cut.xml").write_text("<o><species name='a'><genes><gene id='1' protId='p'/></genes></species><groups><broken")
    assert [(r.species, r.gene) for r in orthoxml.read_genes(spark, str(tmp_path / "cut.xml")).collect()] == [("a", 1)]


def test_cli(spark, db, world, capsys):
    assert main(["info", "--db", db.path], spark) == 0
    assert "k-mer length" in capsys.readouterr().out
    assert main(["search", "--db", db.path, "--query", str(world / "query.fa"), "--family_alpha", "0.01"], spark) == 0
    out = capsys.readouterr().out
    assert "!" not in out and "q1\t1.1a\tAB" in out and "N/A" in out


def test_fasta_compressions(spark, tmp_path):
    text = ">a one\r\nAC\r\nDE\r\n>b\nFG H\n\n>c\n"
    (tmp_path / "x.fa").write_text(text)
    with lzma.open(tmp_path / "x.fa.xz", "wt") as f:
        f.write(text)
    for name in ("x.fa", "x.fa.xz"):
        got = [(r.id, r.header, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / name)).orderBy("ord").collect()]
        assert got == [("a", "a one", "ACDE"), ("b", "b", "FGH"), ("c", "c", "")], name


def test_empty_results_have_no_header(spark, tmp_path):
    empty = spark.createDataFrame([], "ord long, rank int, " + ", ".join(f"{n} {t}" for n, t in __import__("cladeloom.sources.results", fromlist=["x"]).COLUMNS))
    save_results(empty, str(tmp_path / "e.tsv"), {"a": "b"})
    assert (tmp_path / "e.tsv").read_text() == ""


def test_value_with_colon(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("!k: a: b\nqseqid\thogid\nx\tN/A\n")
    rows, meta = read_results(spark, str(tmp_path / "r.tsv"))
    assert meta == {"k": "a: b"} and rows.collect()[0].hogid is None


def test_duplicate_entries_and_missing_sequences(spark, world, tmp_path):
    (tmp_path / "part.fa").write_text(">P001\nACDEFGHIKL\n")
    with pytest.raises(ValueError):
        engine.create_from_orthoxml(spark, str(tmp_path / "db"), str(world / "groups.orthoxml"), str(world / "tree.nwk"), [str(tmp_path / "part.fa")])
    text = (world / "groups.orthoxml").read_text().replace('protId="P011"', 'protId="P001"')
    (tmp_path / "dup.orthoxml").write_text(text)
    with pytest.raises(RuntimeError):
        engine.create_from_orthoxml(spark, str(tmp_path / "db5"), str(tmp_path / "dup.orthoxml"), str(world / "tree.nwk"), [str(world / "one.fa"), str(world / "two.fa.gz")])


def test_version_gate(spark, db, tmp_path):
    for version, ok in (("1.0", True), ("1.9", False), ("2.0", False)):
        path = str(tmp_path / version)
        spark.createDataFrame([("schema version", version)], "key string, value string").write.parquet(f"{path}/metadata")
        if ok:
            engine.Database.open(spark, path)
        else:
            with pytest.raises(ValueError):
                engine.Database.open(spark, path)


def test_column_functions(spark):
    from cladeloom.functions import identifiers as ids
    from cladeloom.functions import sequences as sq

    r = spark.createDataFrame([("acß BXzst", "a.b.c", "HOG:C0001234.1a.2b_99")], "s string, g string, h string").select(
        sq.sanitise(F.col("s")).alias("s"), sq.sanitise(F.col("s"), True).alias("red"), ids.prefixes(F.col("g")).alias("p"), ids.parent(F.col("g")).alias("up"),
        ids.depth(F.col("g")).alias("d"), ids.relabel(F.lit(7), F.col("g"), F.lit("a.b")).alias("rel"), ids.relabel(F.lit(7), F.lit("a"), F.lit("a")).alias("top"),
        ids.parse_group(F.col("h")).alias("h"), sq.kmer_code(F.lit("AY"), 2).alias("code"), ids.group_id(F.lit(12), F.lit("1a")).alias("gid"), ids.protein_id(F.lit("ABCDE"), F.lit(12)).alias("pid"),
        ids.is_descendant(F.lit("a.bc"), F.lit("a.b")).alias("no"), ids.is_descendant(F.lit("a.b.c"), F.lit("a.b")).alias("yes"),
    ).first()
    assert r.s == "ACXXXXST" and r.red == "ACXXXXAA" and r.p == ["a", "a.b", "a.b.c"] and r.up == "a.b" and r.d == 3
    assert r.rel == "7.c" and r.top == "7" and tuple(r.h) == ("HOG:C0001234.1a.2b", "C", 1234, "1a.2b", 99) and r.code == 20
    assert r.gid == "HOG:0000012.1a" and r.pid == "ABCDE00012" and not r.no and r.yes
