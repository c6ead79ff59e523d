"""Species trees: Newick in, tables and Newick out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import with_paths
from .files import read_small


def tokens(text: str):
    """Punctuation as such; labels as ('label', text); comments are skipped."""
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c.isspace():
            i += 1
        elif c == "[":
            i = text.index("]", i) + 1
        elif c in "(),:;":
            yield c, None
            i += 1
        elif c in "'\"":
            out, i = [], i + 1
            while True:
                end = text.index(c, i)
                out.append(text[i:end])
                i = end + 1
                if text[i : i + 1] != c:
                    break
                out.append(c)
                i += 1
            yield "label", "".join(out)
        else:
            end = i
            while end < n and text[end] not in "(),:;[" and not text[end].isspace():
                end += 1
            yield "label", text[i:end]
            i = end


def parse(text: str) -> list[tuple[int, str, int | None, float]]:
    """(number, name, parent's number, branch length) of every node, from the root down."""
    nodes: list[list] = [[0, "", None, 0.0]]
    at, after_colon = 0, False
    for kind, label in tokens(text):
        if kind == "(":
            nodes.append([len(nodes), "", at, 0.0])
            at = len(nodes) - 1
        elif kind == ",":
            nodes.append([len(nodes), "", nodes[at][2], 0.0])
            at = len(nodes) - 1
        elif kind == ")":
            at = nodes[at][2]
        elif kind == ";":
            if at != 0:
                raise ValueError("the tree's brackets do not match")
            break
        elif kind == "label":
            if after_colon:
                nodes[at][3] = float(label)
            else:
                nodes[at][1] = label
        if at is None:
            raise ValueError("the tree's brackets do not match")
        after_colon = kind == ":"
    return [tuple(x) for x in nodes]


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """id, name, parent (id), length, path (ids), distance (from the root), name_path."""
    return tree_table(spark, parse(read_small(spark, path)))


def tree_table(spark: SparkSession, nodes: list[tuple]) -> DataFrame:
    rows = spark.createDataFrame(nodes, "id int, name string, parent int, length double")
    paths = with_paths(rows, "id", "parent")
    steps = paths.select("id", F.posexplode("path").alias("n", "at")).join(rows.select(F.col("id").alias("at"), F.col("length").alias("len"), F.col("name").alias("label")), "at")
    sums = steps.groupBy("id").agg(
        F.sum("len").alias("distance"), F.transform(F.array_sort(F.collect_list(F.struct("n", "label"))), lambda x: x["label"]).alias("name_path")
    )
    return paths.join(sums, "id")


def taxa_table(tree: DataFrame) -> DataFrame:
    """name, parent (name), level (whole part of the distance), path (names)."""
    up = tree.select(F.col("id").alias("parent"), F.col("name").alias("parent_name"))
    return tree.join(up, "parent", "left").select("name", F.col("parent_name").alias("parent"), F.col("distance").cast("int").alias("level"), F.col("name_path").alias("path"))


def write(nodes: list[tuple], root: int = 0, lengths: bool = True) -> str:
    """Newick of (number, name, parent, length) rows."""
    below: dict[int | None, list[tuple]] = {}
    for x in nodes:
        below.setdefault(x[2], []).append(x)
    out: list[str] = []
    top = next(x for x in nodes if x[0] == root)
    stack: list = [top]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        number, name, _, length = item
        tail = name + (f":{length:f}" if lengths and length is not None else "")
        own = below.get(number, [])
        stack.append(tail)
        if own:
            out.append("(")
            stack.append(")")
            for i, x in enumerate(reversed(own)):
                if i:
                    stack.append(", ")
                stack.append(x)
    return "".join(out) + ";"
