"""The browser's five tables as Parquet: sequences out of a chunked buffer, a
database built from them, by the command line too."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import PySparkException

from cladeloom.__main__ import main
from cladeloom.plans import engine
from cladeloom.sources import browser

AA = "ACDEFGHIKLMNPQRSTVWY"


def cut(buffer: str, sizes: list[int]) -> list[tuple[int, bytearray]]:
    out, at = [], 0
    while at < len(buffer):
        n = sizes[len(out) % len(sizes)]
        out.append((at, bytearray(buffer[at : at + n].encode())))
        at += n
    return out


@pytest.mark.parametrize("sizes", [[7], [1, 200, 3, 50], [10**6]])
def test_sequences_cross_chunks(spark, sizes):
    rng = random.Random(5)
    seqs = ["".join(rng.choice(AA) for _ in range(n)) for n in [0, 1, 6, 7, 8, 90, 0, 300, 15, 1]]
    rows, at = [], 0
    for i, s in enumerate(seqs):
        rows.append((i + 1, at, len(s), "kept"))
        at += len(s) + 1
    entries = spark.createDataFrame(rows, "entry_nr long, off long, n long, chunk string")
    chunks = [*cut(" ".join(seqs) + " ", sizes), (at, bytearray())]
    buffer = spark.createDataFrame(chunks, "start long, data binary").repartition(3)
    got = browser.cut_sequences(entries, buffer)
    assert {(r.entry_nr, r.seq, r.chunk) for r in got.collect()} == {(i + 1, s, "kept") for i, s in enumerate(seqs)}
    assert browser.cut_sequences(entries.limit(0), buffer).count() == 0


def test_lacking_chunk_is_an_error(spark):
    buffer = spark.createDataFrame([(0, bytearray(b"ACD")), (6, bytearray(b"GHI"))], "start long, data binary")
    for off, n in ((0, 5), (1, 7), (6, 4), (3, 2), (20, 1)):
        entries = spark.createDataFrame([(1, off, n)], "entry_nr long, off long, n long")
        with pytest.raises(PySparkException, match="does not hold entry 1"):
            browser.cut_sequences(entries, buffer).collect()
    double = buffer.unionByName(spark.createDataFrame([(2, bytearray(b"XX"))], buffer.schema))
    with pytest.raises(ValueError, match="overlap"):
        browser.cut_sequences(spark.createDataFrame([(1, 0, 2)], "entry_nr long, off long, n long"), double)


@pytest.fixture(scope="module")
def export(spark, tmp_path_factory):
    """Two genomes, one named by its code, two families and a lone entry."""
    d = tmp_path_factory.mktemp("export")
    rng = random.Random(6)
    base = {f: "".join(rng.choice(AA) for _ in range(120)) for f in "12"}
    groups = ["HOG:0000001", "HOG:0000001", "HOG:0000002", "", "HOG:0000001", "HOG:0000002", "HOG:0000002"]
    entries, buffer = [], ""
    for i, g in enumerate(groups):
        s = base[g[-1]][: 100 + i] if g else "MNPQ" * 10
        entries.append((i + 1, bytearray(g.encode()), len(buffer), len(s) + 1))
        buffer += s + " "
    levels = [(f, f"HOG:000000{f}", "ALL", 1.0, 3) for f in (1, 2)] + [(1, "HOG:0000001", "Genus one", 1.0, 2)]
    save = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}")
    save("hog_level", levels, "Fam int, ID string, Level string, CompletenessScore float, NrMemberGenes int")
    save("genome", [("AAAAA", "Genus one", 11, 0, 4), ("BBBBB", "Other two", 22, 4, 3)], "UniProtSpeciesCode string, SciName string, NCBITaxonId int, EntryOff long, TotEntries long")
    save("entries", entries, "EntryNr long, OmaHOG binary, SeqBufferOffset long, SeqBufferLength long")
    save("sequence_buffer", cut(buffer, [64]), "Start long, Bytes binary")
    save("taxonomy", [("Genus one", 11), ("ALL", 1)], "Name string, NCBITaxonId int")
    (d / "speciestree.nwk").write_text("('Genus one':1,BBBBB:1)ALL;")
    return d, base


def test_database_of_an_export(spark, export, tmp_path, capsys):
    d, base = export
    path = f"file://{tmp_path}/db"
    assert main(["mkdb", "--db", path, "--browser", f"file://{d}", "--min_fam_size", "1"], spark) == 0
    db = engine.Database.open(spark, path)
    hogs = {r.hog_id: r.source_id for r in db.groups.collect()}
    got = {(r.ext_id, r.species, hogs[r.hog_id], r.seq_len) for r in db.members.collect()}
    assert len(got) == 6 and ("AAAAA00001", "Genus one", "HOG:0000001", 100) in got and ("BBBBB00003", "BBBBB", "HOG:0000002", 106) in got
    assert {r.name: r.ncbi_id for r in db.taxa.collect()} == {"ALL": 1, "Genus one": 11, "BBBBB": 22}
    assert db.settings()["source"] == "browser"
    (tmp_path / "q.fa").write_text(f">q1\n{base['1'][:95]}\n>q2\n{base['2'][5:100]}\n")
    found = engine.search_file(db, f"file://{tmp_path}/q.fa", alpha=0.01)
    assert {(r.qseqid, r.hogid) for r in found.collect()} == {("q1", "1"), ("q2", "2")}  # families are numbered anew


def test_what_a_build_needs(spark, capsys):
    for args in (["--orthoxml", "x"], ["--browser", "d", "--sequences", "s"], ["--browser", "d", "--orthoxml", "x"], []):
        with pytest.raises(SystemExit):
            main(["mkdb", "--db", "nowhere", *args], spark)
