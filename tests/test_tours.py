"""Tours of forests against plain recursion, and very deep trees."""

from __future__ import annotations

import random
import sys

import pytest
from pyspark.sql import functions as F

from cladeloom.operators import tours


def plain(rows):
    """(id, parent, value) -> per node: tree, enter, leave, sum below, sum on the path; text of each tree; visits."""
    kids, value = {}, {i: v for i, _, v in rows}
    for i, p, _ in sorted(rows, key=lambda r: r[0]):
        kids.setdefault(p, []).append(i)
    out, text, visits = {}, {}, []
    for root in kids.get(None, []):
        at = 0

        def walk(v, path):
            nonlocal at
            enter, at = at, at + 1
            inner = v == root or v in kids
            visits.append((root, enter, "prefix" if inner else "leaf", v))
            parts = [walk(c, path + value[c]) for c in kids.get(v, [])]
            leave, at = at, at + 1
            if inner:
                visits.append((root, leave, "postfix", v))
            out[v] = (root, enter, leave, value[v] + sum(p[0] for p in parts), path)
            return out[v][3], f"({', '.join(p[1] for p in parts)}){v}" if parts else v

        text[root] = walk(root, value[root])[1] + ";"
    return out, text, sorted(visits)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forest(spark, seed):
    rng = random.Random(seed)
    names = [f"v{i:03d}" for i in range(120)]
    rows = [(n, None if i < 4 else rng.choice(names[max(0, i - 9) : i]), rng.randrange(10)) for i, n in enumerate(names)] + [("alone", None, 3)]
    t = tours.tour(spark.createDataFrame(rows, "id string, parent string, value long").repartition(3)).cache()
    want, text, visits = plain(rows)
    below = {r.id: r.total for r in tours.below_sums(t, "id", F.col("value")).collect()}
    path = {r.id: r.total for r in tours.path_sums(t, "id", F.col("value")).collect()}
    assert {r.id: (r.tree, r.enter, r.leave, below[r.id], path[r.id]) for r in t.collect()} == want
    assert {r.tree: r.newick for r in tours.newick(t, F.col("id")).collect()} == text
    got = tours.traverse(t, leaf=F.col("id"), prefix=F.col("id"), postfix=F.col("id"))
    assert sorted(map(tuple, got.collect())) == visits
    lists = {r.tree: r["values"] for r in tours.gathered(tours.traverse(t, leaf=F.col("id"))).collect()}
    assert all(lists.get(root, []) == [v for x, _, h, v in visits if x == root and h == "leaf"] for root in text)


def test_deep_chain(spark):
    """5,000 nested nodes: deeper than recursion goes; rows stay linear."""
    n = 5000
    assert n > sys.getrecursionlimit()
    rows = spark.range(n).select(F.col("id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    t = tours.tour(rows)
    (line,) = tours.newick(t, F.col("id").cast("string")).collect()
    assert line.newick == "(" * (n - 1) + str(n - 1) + "".join(f"){i}" for i in range(n - 2, -1, -1)) + ";"


@pytest.mark.parametrize("rows,what", [([(1, 2), (2, 1), (3, None)], "cycle"), ([(1, 9)], "not among"), ([(1, None), (1, None)], "more than once")])
def test_broken_forests(spark, rows, what):
    with pytest.raises(ValueError, match=what):
        tours.tour(spark.createDataFrame(rows, "id long, parent long"))
