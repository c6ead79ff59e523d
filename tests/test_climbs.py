"""Doubling over paths against plain walks, on random forests and one of depth 500."""

import random
import statistics

import pytest
from cladeloom.operators import build, climbs, index


def forest(rng, n, deep):
    parent = {i: (i - 1 if deep and i else None) if deep else (rng.randrange(i) if i and rng.random() < 0.9 else None) for i in range(n)}
    path = {}
    for i, p in parent.items():
        path[i] = [*path.get(p, []), i]
    return path


@pytest.mark.parametrize("n, deep", [(1, False), (80, False), (500, True)])
def test_chains_and_medians(spark, n, deep):
    rng = random.Random(n)
    path = forest(rng, n, deep)
    table = spark.createDataFrame(list(path.items()), "hog_id long, path array<long>").cache()
    far, depth = climbs.steps(table), max(map(len, path.values()))
    assert sum(far) + 1 >= depth and (not far or sum(far[:-1]) + 1 < depth)

    counts = {(q, i): rng.randrange(1, 9) for q in range(3) for i in path if rng.random() < 0.2 or i == n - 1}
    got = {(r.ord, r.hog_id): (r.before, r.cum) for r in index.heaviest_chains(spark.createDataFrame([(q, i, c) for (q, i), c in counts.items()], "ord int, hog_id long, n long"), table, ["ord"]).collect()}
    upto = {(q, i): sum(counts.get((q, j), 0) for j in path[i]) for q in range(3) for i in path}
    want = {}
    for q, leaf in counts:
        for i in path[leaf]:
            before = upto[q, i] - counts.get((q, i), 0)
            want[q, i] = (before, max(want.get((q, i), (0, 0))[1], upto[q, leaf] - before))
    assert got == want

    members = [(rng.randrange(n), rng.randrange(1, 30)) for _ in range(3 * n)]
    got = {r.hog_id: r.median_seqlen for r in build.median_lengths(spark.createDataFrame(members, "hog_id long, seq_len int"), table).collect()}
    below = {}
    for i, x in members:
        for j in path[i]:
            below.setdefault(j, []).append(x)
    assert got == {j: int(statistics.median(xs)) for j, xs in below.items()}


def test_empty(spark):
    table = spark.createDataFrame([], "hog_id long, path array<long>")
    assert climbs.steps(table) == []
    assert index.heaviest_chains(spark.createDataFrame([], "ord int, hog_id long, n long"), table, ["ord"]).count() == 0
