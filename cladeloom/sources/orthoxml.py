"""OrthoXML: species, genes and nested groups as tables.

One file is read by many tasks (module splits): each species and each top-level
group is found by counting tags and parsed by itself, tag by tag: a task holds
the text of one group and a number for each of its genes, and no tree. Files
are read by Spark, whatever store they are in.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.identifiers import GROUP_PATTERN
from ..operators import tours
from .splits import elements

GENES = "species string, ncbi_id int, gene long, prot_id string, gene_id string"
GROUPS = "fam long, id string, level string, node int, ord long, gene long"
MEMBERS = "fam long, id string, ord long, gene long"
NODE_COLUMNS = "fam long, node int, kind string, label string, distance double, enter int, leave int, n_children int, first boolean"
TOPS = ("orthologGroup", "paralogGroup")
NODES = (*TOPS, "geneRef")


def local(el: ET.Element) -> str:
    return el.tag.rpartition("}")[2]


def letters(n: int) -> str:
    """0 -> a, 25 -> z, 26 -> aa: the branch letters in bijective base 26."""
    out = ""
    n += 1
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


def labelled(top: ET.Element) -> tuple[int, str, dict[ET.Element, str]]:
    """Family number, identifier, and the label of each group and gene below.

    A duplication adds a point and a number: how many duplications of that
    nesting depth came before in the whole group, plus one. Each of its
    branches adds its letter. All else inherits its parent's label."""
    name = top.get("id", "")
    m = re.match(GROUP_PATTERN, name)
    fam = int(m[3]) if m else int(name)
    head = m[1] if m else str(fam)
    label: dict[ET.Element, str] = {}
    seen: dict[int, int] = {}
    stack = [(top, head, 0)]
    while stack:
        el, at, depth = stack.pop()
        kind = local(el)
        if kind == "paralogGroup":
            seen[depth] = seen.get(depth, 0) + 1
            label[el] = f"{at}.{seen[depth]}"
            stack += [(c, label[el] + letters(i), depth + 1) for i, c in reversed(list(enumerate(el)))]
        elif kind == "orthologGroup":
            label[el] = at
            stack += [(c, at, depth) for c in reversed(list(el))]
        elif kind == "geneRef":
            label[el] = at
    return fam, head, label


def written(fam: int, label: str) -> str:
    return ".".join([f"HOG:{fam:07d}", *label.split(".")[1:]])


def properties(el: ET.Element) -> dict[str, str]:
    return {c.get("name"): c.get("value") for c in el if local(c) == "property"}


def scores(el: ET.Element) -> dict[str, str]:
    return {c.get("id"): c.get("value") for c in el if local(c) == "score"}


def levels_of(el: ET.Element) -> list[str]:
    """The taxa that the group and the groups below it stand for."""
    return [v for e in el.iter() if local(e) == "orthologGroup" and (v := properties(e).get("TaxRange")) is not None]


def annotations(el: ET.Element, level: str | None = None) -> list[dict[str, str]]:
    """Properties of the ortholog groups at or below (of one taxon)."""
    found = [properties(e) for e in el.iter() if local(e) == "orthologGroup"]
    return [p for p in found if level is None or p.get("TaxRange") == level]


def gene_of(el: ET.Element, gene: int) -> ET.Element | None:
    return next((e for e in el.iter() if local(e) == "geneRef" and e.get("id") == str(gene)), None)


def group_rows(top: ET.Element, ord_: int) -> tuple[list[tuple], list[tuple]]:
    """Rows (fam, id, level, node, ord, gene) for each ortholog group and gene
    at or below it, and (fam, id, ord, gene) for each gene; ord counts from
    ord_, groups before genes, each at most once for a tag of the group."""
    fam, _, label = labelled(top)
    groups, members, node = [], [], 0
    for el in top.iter():
        kind = local(el)
        if kind == "orthologGroup":
            level = properties(el).get("TaxRange")
            genes = [int(g.get("id")) for g in el.iter() if local(g) == "geneRef"]
            groups += [(fam, written(fam, label[el]), level, node, ord_ + node, g) for g in genes]
            node += 1
        elif kind == "geneRef":
            members.append((fam, written(fam, label[el]), len(members), int(el.get("id"))))
    return groups, [(fam, name, ord_ + node + i, gene) for fam, name, i, gene in members]


def node_rows(top: ET.Element) -> list[tuple]:
    """(fam, node, kind, label, distance, enter, leave, n_children, first) of a
    group's genes and groups in document order: its tour, read off the document."""
    fam, _, _ = labelled(top)
    out: list[list] = []
    at = 0
    stack: list = [(top, True)]
    while stack:
        el, first = stack.pop()
        if isinstance(el, int):
            out[el][6], at = at, at + 1
            continue
        kind = local(el)
        said = properties(el)
        got = said.get("distance") or scores(el).get("distance")
        below = [c for c in el if local(c) in NODES]
        label = el.get("id", "") if kind == "geneRef" else said.get("TaxRange", "")
        out.append([fam, len(out), kind, label, float(got) if got not in (None, "None") else None, at, 0, len(below), first])
        at += 1
        stack.append((len(out) - 1, False))
        stack += [(c, i == 0) for i, c in reversed(list(enumerate(below)))]
    return [tuple(x) for x in out]


def species_rows(el: ET.Element) -> list[tuple]:
    name, taxid = el.get("name"), el.get("NCBITaxId")
    return [(name, int(taxid) if taxid else None, int(g.get("id")), g.get("protId") or g.get("geneId"), g.get("geneId")) for g in el.iter() if local(g) == "gene"]


#: Characters that the parser is given at once.
FEED = 1 << 16


def tags(text: str) -> Iterator[tuple[str, dict[str, str] | None]]:
    """(name, attributes) where a tag opens and (name, None) where it closes,
    in order. No tree is made: memory does not follow the element."""
    found: list[tuple[str, dict[str, str] | None]] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.buffer_text = True
    parser.StartElementHandler = lambda name, said: found.append((name.rpartition("}")[2], said))
    parser.EndElementHandler = lambda name: found.append((name.rpartition("}")[2], None))
    for i in range(0, len(text), FEED):
        parser.Parse(text[i : i + FEED])
        yield from found
        found.clear()
    parser.Parse("", True)
    yield from found


def species_of(text: str, _: int) -> Iterator[tuple]:
    """The rows of species_rows."""
    found = tags(text)
    _, el = next(found)
    taxid = int(el["NCBITaxId"]) if el.get("NCBITaxId") else None
    for kind, g in found:
        if kind == "gene" and g is not None:
            yield el.get("name"), taxid, int(g["id"]), g.get("protId") or g.get("geneId"), g.get("geneId")


class Labels:
    """The labels of labelled, given out tag by tag: `opened` for every tag that
    opens, `closed` for every one that closes. Only groups give labels."""

    def __init__(self):
        self.fam, self.seen = 0, {}
        self.stack: list[list] = []  # kind, label, depth, how many children were opened

    def opened(self, kind: str, said: dict[str, str]) -> str | None:
        if not self.stack:
            name = said.get("id", "")
            m = re.match(GROUP_PATTERN, name)
            self.fam = int(m[3]) if m else int(name)
            at, depth = m[1] if m else str(self.fam), 0
        else:
            above = self.stack[-1]
            at, depth = above[1], above[2]
            if above[0] == "paralogGroup" and at is not None:
                at, depth = at + letters(above[3]), depth + 1
            elif above[0] != "orthologGroup":
                at = None  # below a gene or a property nothing is labelled
            above[3] += 1
        if at is not None and kind == "paralogGroup":
            self.seen[depth] = self.seen.get(depth, 0) + 1
            at = f"{at}.{self.seen[depth]}"
        self.stack.append([kind, at, depth, 0])
        return at

    def closed(self) -> None:
        self.stack.pop()


def groups_of(text: str, ord_: int) -> Iterator[tuple]:
    """The first rows of group_rows. What is held of the element: a number for
    each gene."""
    labels, genes, node = Labels(), array("q"), 0
    open_: list[list] = []  # number, label, taxon, how many genes came before
    for kind, said in tags(text):
        if said is None:
            labels.closed()
            if kind == "orthologGroup":
                number, label, level, first = open_.pop()
                name = written(labels.fam, label)
                for i in range(first, len(genes)):
                    yield labels.fam, name, level, number, ord_ + number, genes[i]
            continue
        above = labels.stack[-1][0] if labels.stack else None
        label = labels.opened(kind, said)
        if kind == "orthologGroup":
            open_.append([node, label, None, len(genes)])
            node += 1
        elif kind == "geneRef":
            genes.append(int(said["id"]))
        elif kind == "property" and above == "orthologGroup" and said.get("name") == "TaxRange":
            open_[-1][2] = said.get("value")


def members_of(text: str, ord_: int) -> Iterator[tuple]:
    """The second rows of group_rows. What is held of the element: a number
    and a reference to its label for each gene."""
    labels, genes, names, node = Labels(), array("q"), [], 0
    known: dict[str, str] = {}
    for kind, said in tags(text):
        if said is None:
            labels.closed()
            continue
        label = labels.opened(kind, said)
        if kind == "orthologGroup":
            node += 1
        elif kind == "geneRef":
            genes.append(int(said["id"]))
            if label not in known:
                known[label] = written(labels.fam, label)
            names.append(known[label])
    for i, gene in enumerate(genes):
        yield labels.fam, names[i], ord_ + node + i, gene


def nodes_of(text: str, ord_: int) -> Iterator[tuple]:
    """ord_ and the rows of node_rows, each given out where its tag closes."""
    labels, at, node = Labels(), 0, 0
    held: list[list] = []  # the element, whether it is a node, its row, properties and scores
    for kind, said in tags(text):
        if said is None:
            labels.closed()
            is_node, row, props, points = held.pop()
            if is_node:
                got = props.get("distance") or points.get("distance")
                row[3] = row[3] if kind == "geneRef" else props.get("TaxRange", "")
                row[4] = float(got) if got not in (None, "None") else None
                row[6], at = at, at + 1
                yield (ord_, labels.fam, *row[1:])
            continue
        labels.opened(kind, said)
        above = held[-1] if held else None
        is_node = kind in NODES and (above is None or above[0])
        row = None
        if is_node:
            first = above is None or above[1][7] == 0
            if above is not None:
                above[1][7] += 1
            row = [None, node, kind, said.get("id", ""), None, at, 0, 0, first]
            node, at = node + 1, at + 1
        elif above is not None and kind == "property":
            above[2][said.get("name")] = said.get("value")
        elif above is not None and kind == "score":
            above[3][said.get("id")] = said.get("value")
        held.append([is_node, row, {}, {}])


ROWS = 10_000


def _parsed(spark: SparkSession, path: str, names: tuple[str, ...], schema: str, rows_of: Callable[[str, int], Iterator[tuple]]) -> DataFrame:
    """rows_of(text, order number) over the outermost elements of the names."""
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for i in range(batch.num_rows) for row in rows_of(batch.column("text")[i].as_py(), batch.column("ord")[i].as_py()))
        while held := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return elements(spark, path, names).mapInArrow(run, schema)


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """species, ncbi_id, gene, prot_id, gene_id. What follows the species may
    be broken: it is not parsed."""
    return _parsed(spark, path, ("species",), GENES, species_of)


def read_species(spark: SparkSession, path: str) -> DataFrame:
    """species, ncbi_id, min_id, max_id of its genes."""
    return read_genes(spark, path).groupBy("species", "ncbi_id").agg(F.min("gene").alias("min_id"), F.max("gene").alias("max_id"))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """A row for every ortholog group and gene at or below it."""
    return _parsed(spark, path, TOPS, GROUPS, groups_of)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """A row for every gene with the label it stands under."""
    return _parsed(spark, path, TOPS, MEMBERS, members_of)


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """A row for every group and gene with its place in its top-level group's
    tour (tree), as operators.tours makes it for other forests."""
    return _parsed(spark, path, TOPS, "tree long, " + NODE_COLUMNS, nodes_of)


def read_references(spark: SparkSession, *paths: str) -> DataFrame:
    """(ref, xref) of tab-separated mapping files with # comments."""
    return spark.read.csv(list(paths), sep="\t", comment="#", schema="ref string, xref string")


def node_label(name: Column | None = None, taxa: bool = True, distance: Column | None = None) -> Column:
    """How a node stands in Newick: genes by number (or by name), groups by
    taxon, and the distance where there is one."""
    gene = F.col("kind") == "geneRef"
    label = F.when(gene, F.col("label") if name is None else name).otherwise(F.col("label") if taxa else F.lit(""))
    far = F.col("distance") if distance is None else distance
    return F.concat(label, F.when(far.isNotNull(), F.format_string(":%.6f", far)).otherwise(F.lit("")))


def groups_newick(nodes: DataFrame, name: Column | None = None, taxa: bool = True, distance: Column | None = None) -> DataFrame:
    """tree, fam, newick of all groups at once, from read_nodes."""
    return tours.newick(nodes, node_label(name, taxa, distance), ["tree", "fam"])


def groups_nhx(nodes: DataFrame, **options) -> DataFrame:
    """As NHX: no comments are attached, so it is the Newick text."""
    return groups_newick(nodes, **options).withColumnRenamed("newick", "nhx")


def groups_xml(spark: SparkSession, path: str) -> DataFrame:
    """tree, xml: each top-level group as its own document."""
    return elements(spark, path, TOPS).select(F.col("ord").alias("tree"), F.col("text").alias("xml"))
