"""OrthoXML in one and in many splits, and its groups as text."""

from __future__ import annotations

import gzip
import lzma
import random
import tracemalloc
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cladeloom.sources import orthoxml


def random_group(rng, gene, depth=0):
    inner = []
    for _ in range(rng.randrange(1, 4)):
        if depth < 4 and rng.random() < 0.5:
            inner.append(random_group(rng, gene, depth + 1))
        else:
            gene[0] += 1
            inner.append(f'<x:geneRef id="{gene[0]}" />' if rng.random() < 0.2 else f'\n  <geneRef id="{gene[0]}"></geneRef>')
    if rng.random() < 0.3:
        inner.insert(0, "<!-- <orthologGroup> in > a --><!---->")
    kind = "paralogGroup" if depth and rng.random() < 0.4 else "orthologGroup"
    prop = f'<property name="TaxRange" value="T{depth} é"/>' if kind == "orthologGroup" else '<score id="distance" value="1.5"/>'
    return f"<{kind} ID>{prop}{''.join(inner)}</{kind}>".replace(" ID>", ">" if depth else ' id="N">')


def document(seed, n):
    rng, gene = random.Random(seed), [0]
    groups = [random_group(rng, gene).replace('id="N"', f'id="HOG:{i + 1:07d}"', 1) for i in range(n)]
    species = "".join(f'<species name="S{i}" NCBITaxId="{i}"><database><genes>' + "".join(f'<gene id="{g}" protId="P{g}"/>' for g in range(i + 1, gene[0] + 1, 3)) + "</genes></database></species>" for i in range(3))
    return f'<?xml version="1.0"?>\n<!-- <species> --><x:orthoXML xmlns:x="u">{species}<groups>{"".join(groups)}</groups><notes>a</notes></x:orthoXML>\n', groups


def plain_newick(el):
    kind, props = orthoxml.local(el), orthoxml.properties(el)
    label = el.get("id") if kind == "geneRef" else props.get("TaxRange", "")
    label += f":{float(orthoxml.scores(el)['distance']):f}" if "distance" in orthoxml.scores(el) else ""
    below = [plain_newick(c) for c in el if orthoxml.local(c) in orthoxml.NODES]
    return f"({', '.join(below)}){label}" if below else label


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda n: [spark.conf.set(k, str(n)) for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


def test_splits_change_nothing(spark, tmp_path, split_size):
    text, groups = document(1, 12)
    (tmp_path / "a.xml").write_text(text)
    path, results = str(tmp_path / "a.xml"), []
    size = len(text.encode())
    for n in (1, 64):
        split_size(-(-size // n))
        assert spark.read.option("lineSep", ">").text(path).select("_metadata.file_block_start").distinct().count() >= min(n, 2)
        members, rows = orthoxml.read_members(spark, path), orthoxml.read_groups(spark, path)
        order = [r.fam for r in members.groupBy("fam").agg(F.min("ord").alias("o")).orderBy("o").collect()]
        assert order == sorted(order)
        results.append((sorted(map(tuple, members.drop("ord").collect())), sorted(map(tuple, rows.drop("ord").collect())), sorted(map(tuple, orthoxml.read_genes(spark, path).drop("gene_id").collect()))))
        assert members.count() == members.select("ord").distinct().count()
    assert results[0] == results[1]
    bare = text.replace("<x:", "<").replace("</x:", "</")
    want, tops = [], list(ET.fromstring(bare).find("groups"))
    for top in tops:
        want += [(f, i, g) for f, i, _, g in orthoxml.group_rows(top, 0)[1]]
    assert results[0][0] == sorted(want) and len(tops) == len(groups)
    found = orthoxml.groups_newick(orthoxml.read_nodes(spark, path)).collect()
    assert [r.newick for r in sorted(found, key=lambda r: r.tree)] == [plain_newick(t) + ";" for t in tops]
    xml = sorted((r.tree, r.xml) for r in orthoxml.groups_xml(spark, path).collect())
    assert [orthoxml.group_rows(ET.fromstring(x), 0) for _, x in xml] == [orthoxml.group_rows(t, 0) for t in tops]
    named = orthoxml.groups_newick(orthoxml.read_nodes(spark, path), name=F.concat(F.lit("g"), "label"), taxa=False, distance=F.lit(None).cast("double")).collect()
    assert all("T" not in r.newick and ":" not in r.newick and "g" in r.newick for r in named)


def test_compressed_and_deep(spark, tmp_path):
    text, _ = document(3, 4)
    (tmp_path / "b.xml.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "c").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "d.xml").write_text(text)
    rows = [sorted(map(tuple, orthoxml.read_members(spark, str(tmp_path / n)).drop("ord").collect())) for n in ("b.xml.gz", "c", "d.xml")]
    assert rows[0] == rows[1] == rows[2] and rows[0]
    n = 5000
    (tmp_path / "deep.xml").write_text('<o><groups><orthologGroup id="7">' + "<orthologGroup>" * n + '<geneRef id="1"/>' + "</orthologGroup>" * n + "</orthologGroup></groups></o>")
    (r,) = orthoxml.groups_newick(orthoxml.read_nodes(spark, str(tmp_path / "deep.xml"))).collect()
    assert (r.fam, r.newick) == (7, "(" * (n + 1) + "1" + ")" * (n + 1) + ";")


def test_tags_give_what_trees_give():
    """Groups, members, nodes and species are read tag by tag as from a tree."""
    for seed in range(6):
        bare = document(seed, 5)[0].replace("<x:", "<").replace("</x:", "</")
        root = ET.fromstring(bare)
        for top in root.find("groups"):
            text = ET.tostring(top, encoding="unicode")
            groups, members = orthoxml.group_rows(top, 70)
            assert sorted(orthoxml.groups_of(text, 70)) == sorted(groups) and list(orthoxml.members_of(text, 70)) == members
            assert sorted(orthoxml.nodes_of(text, 70), key=lambda r: r[2]) == [(70, *r) for r in orthoxml.node_rows(top)]
        for el in root.iter("species"):
            assert list(orthoxml.species_of(ET.tostring(el, encoding="unicode"), 0)) == orthoxml.species_rows(el)
    late = '<orthologGroup id="HOG:0000003"><paralogGroup><geneRef id="1"/><orthologGroup><geneRef id="2"/><property name="TaxRange" value="b"/></orthologGroup></paralogGroup><property name="TaxRange" value="a"/></orthologGroup>'
    assert sorted(orthoxml.groups_of(late, 0)) == sorted(orthoxml.group_rows(ET.fromstring(late), 0)[0])


def test_memory_does_not_follow_the_tree():
    """A group of many genes is read in a small part of what its tree takes."""
    text = '<orthologGroup id="HOG:0000001">' + "".join(f'<geneRef id="{i}"/>' for i in range(200_000)) + "</orthologGroup>"
    tracemalloc.start()
    try:
        assert sum(1 for _ in orthoxml.groups_of(text, 0)) == sum(1 for _ in orthoxml.members_of(text, 0)) == 200_000
        assert tracemalloc.get_traced_memory()[1] < 8 << 20
    finally:
        tracemalloc.stop()
