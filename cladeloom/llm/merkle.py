"""Merkle manifest of a dataset.

A row is a leaf; the leaves of a source, by identifier, are hashed in runs of
`fan` to one subroot, and the subroots, by source, likewise to the root. A
proof is the siblings of a leaf's path, from which anyone who has the row
computes the root again.

Method: rows get consecutive places within their source by a range sort. An
aligned block of `fan` to the `levels` places (6561) is one group; its tree is
traversed in postorder by recursion over places: a call returns its subtree's
digest, and on the way back each call appends the digests of its siblings to
all leaves that it contains. A source of one block ends at its subroot; else
the block roots are the leaves of another distributed traversal, until each
source has one node. The proofs of block roots are joined back to their
blocks' leaves, from the top down. No group exceeds a block, whatever share of
the rows a source holds.

Defined cases: a null value is `-` in a leaf; null sources form the first
source; rows that repeat an identifier stand side by side in the order of
their digests; null identifiers come first; a source of one row has its leaf
as subroot, a dataset of one source that subroot as root; an empty table gives
an empty manifest; the hashed columns are named, further ones are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import number_rows
from .common import join_hot, materialise, named_id

FAN = 3
LEVELS = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(c: Column) -> Column:
    """`-` for null, else byte count, colon and value."""
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The SHA-256 of the encoded columns, as 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.concat(*[encoded(c) for c in columns]), "UTF-8"), 256))


def parent(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def height(n: int, fan: int) -> int:
    """Levels from n nodes to one."""
    h, most = 0, 1
    while most < n:
        h, most = h + 1, most * fan
    return h


def traverse(nodes: list[bytes], levels: int, fan: int) -> tuple[bytes, list[bytearray]]:
    """The digest `levels` above nodes, and each node's siblings from below,
    left to right, joined."""
    proofs = [bytearray() for _ in nodes]

    def visit(low: int, level: int) -> bytes:
        if level == 0:
            return nodes[low]
        width = fan ** (level - 1)
        starts = range(low, min(low + fan * width, len(nodes)), width)
        run = [visit(s, level - 1) for s in starts]
        for i, s in enumerate(starts):
            siblings = b"".join(run[:i] + run[i + 1 :])
            for at in range(s, min(s + width, len(nodes))):
                proofs[at] += siblings
        return parent(run)

    return visit(0, levels), proofs


def fold(digest: bytes, proof: bytes, place: int, n: int, fan: int) -> tuple[bytes, int]:
    """The top of a tree of n leaves, recomputed from one leaf and its
    siblings; and the bytes of the proof that were used."""
    used = 0
    while n > 1:
        first = place - place % fan
        run = min(fan, n - first)
        own = [proof[used + 32 * i : used + 32 * (i + 1)] for i in range(run - 1)]
        used += 32 * (run - 1)
        own.insert(place - first, digest)
        digest, place, n = parent(own), place // fan, -(-n // fan)
    return digest, used


def _blocks(levels: int, fan: int):
    """Groups of (null, name, n, place, digest): each node's siblings within
    its block; and, marked by up, the block's root with the block as place."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("place").to_numpy(), kind="stable")
        place = table.column("place").to_numpy()[order]
        digests = table.column("digest").to_pylist()
        null, name, n, block = (table.column(c)[0].as_py() for c in ("null", "name", "n", "block"))
        top, proofs = traverse([digests[i] for i in order], min(levels, height(n, fan)), fan)
        k = len(place)
        return pa.table(
            {
                "null": pa.array([null] * (k + 1), pa.bool_()), "name": pa.array([name] * (k + 1), pa.string()), "n": pa.array([n] * k + [-(-n // fan**levels)], pa.int64()),
                "place": pa.array([*place.tolist(), block], pa.int64()), "block": pa.array([block] * (k + 1), pa.int64()), "up": pa.array([False] * k + [True]),
                "digest": pa.array([*(digests[i] for i in order), top], pa.binary()), "proof": pa.array([*map(bytes, proofs), b""], pa.binary()),
            }
        )

    return run


TIER = "null boolean, name string, n long, place long, block long, up boolean, digest binary, proof binary"


def tiers(nodes: DataFrame, levels: int = LEVELS, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """Trees of nodes(null, name, n, place, digest): for each traversal its
    nodes with the siblings within their block, and the tops (null, name, digest)."""
    out = []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        dealt = nodes.withColumn("block", F.floor(F.col("place") / fan**levels).cast("long"))
        done = materialise(dealt.groupBy("null", "name", "block").applyInArrow(_blocks(levels, fan), TIER), "merkle")
        out.append(done.filter("not up").drop("up"))
        nodes = done.filter("up").select("null", "name", "n", "place", "digest")
        most = -(-most // fan**levels)
        if most <= 1:
            return out, nodes.select("null", "name", "digest")


def _above(below: DataFrame, above: DataFrame) -> DataFrame:
    """below with the proofs of its blocks' roots appended. A root's place is
    the block's number; the blocks of a source spread its rows."""
    up = above.select(F.col("null").alias("u_null"), F.col("name").alias("u_name"), F.col("place").alias("u_place"), F.col("proof").alias("u_proof"))
    same = (below["null"] == up["u_null"]) & (below["name"] == up["u_name"]) & (below["block"] == up["u_place"])
    return below.join(up, same).select("null", "name", "n", "place", "block", "digest", F.concat("proof", "u_proof").alias("proof"))


def proved(nodes: DataFrame, levels: int = LEVELS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """nodes with their whole proof to their tree's top; and the tops."""
    made, tops = tiers(nodes, levels, fan)
    whole = made[-1]
    for t in reversed(made[:-1]):
        whole = _above(t, whole)
    return whole, tops


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves(id, source, digest, ..) with null, name, n and place within the
    source; and the sources (null, name, first, n)."""
    keyed = leaves.select("*", *named_id(F.col("source"), "null", "name"))
    order = [F.col("null").desc(), F.encode("name", "UTF-8"), F.col("id").asc_nulls_first(), F.col("digest")]
    numbered = materialise(number_rows(keyed, order, "number"), "leaves")
    sources = materialise(numbered.groupBy("null", "name").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n")), "sources")
    found = join_hot(numbered, sources, ["null", "name"], "n", numbered.count())
    return found.withColumn("place", F.col("number") - F.col("first")).drop("first"), sources


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", source_col: str = "source", levels: int = LEVELS, fan: int = FAN, changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of docs: id, source, leaf, subroot, root, and the proof
    (joined digests): place of n within the source, place of the source among
    n_sources. With `changed`, other expressions for some columns, also the
    leaf that the changed row has (`other`)."""
    now = [F.col(c) for c in columns]
    other = leaf(*[(changed or {}).get(c, F.col(c)) for c in columns])
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), leaf(*now).alias("digest"), *([other.alias("other")] if changed else []))
    rows, sources = placed(leaves)
    rows = materialise(rows, "placed")
    proofs, tops = proved(rows.select("null", "name", "n", "place", "digest"), levels, fan)
    # the sources are leaves of one more tree
    tops = tops.join(sources.select("null", "name", F.col("n").alias("rows")), ["null", "name"])
    ranked = materialise(number_rows(tops, [F.col("null").desc(), F.encode("name", "UTF-8")], "place"), "subroots")
    n_sources = ranked.count()
    upper = ranked.select(F.lit(False).alias("null"), F.lit("").alias("name"), F.lit(n_sources).cast("long").alias("n"), "place", "digest")
    source_proofs, root = proved(upper, levels, fan)
    subroots = ranked.select("null", "name", F.col("digest").alias("subroot"), F.col("place").alias("source_place"), F.lit(n_sources).cast("long").alias("n_sources"), "rows")
    above = source_proofs.select(F.col("place").alias("source_place"), F.col("proof").alias("source_proof"))
    top = materialise(subroots.join(above, "source_place").join(F.broadcast(root.select(F.col("digest").alias("root")))), "tops")
    whole = proofs.select("null", "name", "place", "proof").join(rows, ["null", "name", "place"])
    found = join_hot(whole, top, ["null", "name"], "rows", rows.count())
    return found.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("digest").alias("leaf"), *(["other"] if changed else []), "subroot", "root",
        F.concat("proof", "source_proof").alias("proof"), "place", "n", "source_place", "n_sources",
    )


def checked(rows: DataFrame, start: str = "leaf", fan: int = FAN) -> DataFrame:
    """rows of a manifest with folded (the root recomputed from the column
    `start` and the proof) and proof_digest (of the proof's digests)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded, digests = [], []
            for d, proof, place, n, above, m in zip(*(batch.column(c).to_pylist() for c in (start, "proof", "place", "n", "source_place", "n_sources"))):
                sub, used = fold(d, proof, place, n, fan)
                folded.append(fold(sub, proof[used:], above, m, fan)[0])
                digests.append(hashlib.sha256(proof.hex().encode()).digest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.binary()), pa.array(digests, pa.binary())], names=[*batch.schema.names, "folded", "proof_digest"])

    return rows.mapInArrow(run, rows.select("*", F.col("root").alias("folded"), F.col("root").alias("proof_digest")).schema)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    altered = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    text = F.when(altered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = checked(manifest(docs, changed={"text": text}), "other")
    shown = lambda c: F.lower(F.hex(c))
    return rows.select(
        "doc_id", *[shown(c).alias(c) for c in ("leaf", "subroot", "root")], shown("proof_digest").alias("proof_sha256"), shown("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _sql(depth: int = 12, fan: int = FAN) -> str:
    """The trees of up to fan ** depth leaves, level by level."""
    enc = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    row = lambda text: "sha256(" + " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bare = "replace(text, chr(10), '')"
    out = [
        "WITH crc AS (SELECT list_transform(range(256), lambda i: CAST(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS BIGINT)) AS t)",
        "digits AS (SELECT doc_id, source, lang, n_chars, text, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS b FROM documents)",
        "marked AS (SELECT d.*, xor(4294967295, list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[CAST(xor(c % 256, x) + 1 AS INT)]))) % 2 = 0 AS altered FROM digits d, crc)",
        f"leaves AS MATERIALIZED (SELECT doc_id, source, {row('text')} AS leaf, CASE WHEN altered THEN {row(bare)} ELSE {row('text')} END AS other FROM marked)",
        "first AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves)",
    ]

    def climb(tag: str, nodes: str, starts: str) -> None:
        """nodes: (tree, i, h); starts: (r, tree, i, f): folded digest, proof so far."""
        out.append(f"{tag}n0 AS MATERIALIZED ({nodes})")
        out.append(f"{tag}p0 AS MATERIALIZED ({starts})")
        for j in range(depth):
            out.append(f"{tag}r{j} AS MATERIALIZED (SELECT tree, i // {fan} AS i, list(h ORDER BY i) AS hs, sum(count(*)) OVER (PARTITION BY tree) AS n FROM {tag}n{j} GROUP BY tree, i // {fan})")
            left, right = f"array_to_string(hs[1:p.i % {fan}], '')", f"array_to_string(hs[p.i % {fan} + 2:{fan}], '')"
            # a tree of one node is at its top: nothing is hashed any more
            out.append(f"{tag}n{j + 1} AS MATERIALIZED (SELECT tree, i, CASE WHEN n = 1 AND len(hs) = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {tag}r{j})")
            out.append(
                f"{tag}p{j + 1} AS MATERIALIZED (SELECT p.r, p.tree, p.i // {fan} AS i, CASE WHEN n = 1 AND len(hs) = 1 THEN f ELSE sha256({left} || f || {right}) END AS f, "
                f"proof || CASE WHEN n = 1 AND len(hs) = 1 THEN '' ELSE {left} || {right} END AS proof FROM {tag}p{j} p JOIN {tag}r{j} q ON p.tree = q.tree AND p.i // {fan} = q.i)"
            )

    climb("a", "SELECT tree, i, leaf AS h FROM first", "SELECT r, tree, i, other AS f, '' AS proof FROM first")
    out.append(f"subs AS MATERIALIZED (SELECT tree AS source_tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i FROM an{depth})")
    climb("b", "SELECT 'all' AS tree, i, subroot AS h FROM subs", f"SELECT r, 'all' AS tree, s.i, f, proof FROM ap{depth} a JOIN subs s ON a.tree = s.source_tree")
    return ",\n".join(out) + (
        f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified "
        f"FROM first JOIN subs ON tree = source_tree JOIN bp{depth} p ON p.r = first.r, bn{depth}"
    )


OP13_SQL = _sql()
