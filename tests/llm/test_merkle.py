"""The Merkle manifest against a plain loop over levels."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cladeloom.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(nodes, fan=3):
    """The top, and each node's siblings level by level."""
    level, inside, proofs = list(nodes), [[i] for i in range(len(nodes))], [[] for _ in nodes]
    while len(level) > 1:
        up, held = [], []
        for a in range(0, len(level), fan):
            run = level[a : a + fan]
            for k in range(len(run)):
                for i in inside[a + k]:
                    proofs[i] += run[:k] + run[k + 1 :]
            up.append(h("".join(run)))
            held.append([i for s in inside[a : a + fan] for i in s])
        level, inside = up, held
    return level[0], proofs


def plain_manifest(rows, fan=3):
    """rows: (doc_id, source, lang, n_chars, text) -> Counter of (id, leaf, subroot, root, proof)"""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, plain_leaf(r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])], fan) for s in names}
    root, above = plain_tree([trees[s][0] for s in names], fan)
    out = Counter()
    for s, up in zip(names, above):
        for x, proof in zip(sorted(by[s], key=lambda x: x[:3]), trees[s][1]):
            out[(x[3][0], x[2], trees[s][0], root, "".join(proof + up))] += 1
    return out


@pytest.mark.parametrize("levels,fan", [(8, 3), (1, 3), (2, 3), (2, 2)])
def test_manifest(spark, levels, fan):
    rng = random.Random(levels)
    rows = [(i, rng.choice(["hot", "hot", "b", "é", "ze", None]), rng.choice(["en", None]), i % 7, f"text {i}\né") for i in range(150)]
    rows += [(200, "single", "en", 1, None), (201, "", "en", None, ""), (3, "hot", "en", 1, "again"), (3, "hot", "en", 1, "again"), (None, "hot", None, None, None), (None, None, None, None, None)]
    rows += [(300 + i, f"s{i}", "en", 1, "x" * i) for i in range(28)]
    schema = "doc_id long, source string, lang string, n_chars int, text string, name string, n int, `null` int, digest int"
    docs = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in rows], schema).repartition(4)
    changed = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, levels=levels, fan=fan, changed={"text": changed})
    sound, broken = merkle.checked(got, "leaf", fan).collect(), merkle.checked(got, "other", fan).collect()
    assert Counter((r.doc_id, r.leaf.hex(), r.subroot.hex(), r.root.hex(), r.proof.hex()) for r in sound) == plain_manifest(rows, fan)
    assert all(r.folded == r.root and r.proof_digest.hex() == h(r.proof.hex()) for r in sound)
    text = {r[0]: r[4] for r in rows}
    for r in broken:
        changes = r.doc_id is not None and r.doc_id % 2 == 0 and "\n" in (text[r.doc_id] or "")
        assert (r.folded != r.root) == changes == (r.other != r.leaf)


def test_small_datasets(spark):
    docs = spark.createDataFrame([(1, "s", "en", 3, "abc")], "doc_id long, source string, lang string, n_chars int, text string")
    (r,) = merkle.checked(merkle.manifest(docs)).collect()
    assert r.leaf == r.subroot == r.root == r.folded and r.proof == b""
    assert merkle.manifest(docs.limit(0)).count() == 0
