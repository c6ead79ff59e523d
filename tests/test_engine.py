"""The placement operators against naive restatements, and against SQL."""

from __future__ import annotations

import math
import os
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cladeloom.functions import statistics as st
from cladeloom.operators import hierarchy, index
from cladeloom.operators import search as srch
from cladeloom.queries import SQL
from compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", ["sanitise", "kmer_distinct", "kmer_first_pos", "family_hits_raw", "family_pvalue", "best_path", "search_full", "search_family_only", "tree_lca", "median_len_subtree", "root_filter", "group_table", "hog_taxa", "hidden_taxa", "taxon_numbers", "fasta_scan"])
def test_sql(spark, name):
    assert name in SQL and compare(spark, SF, name).startswith("equal")


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 40 and df.columns[0] == "qseqid"
    assert set(entry.oracle_sql()) <= set(entry.queries())


# ------------------------------------------------------------ ranking


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [10, 100])
def test_top_families(spark, seed, k):
    """Random results, ties planted on the first two and on all three keys."""
    rng = random.Random(seed)
    rows = [[c, f, rng.uniform(0, 100), rng.uniform(0, 10), rng.random()] for c in range(5) for f in range(100)]
    for r in rng.sample(rows, 60):
        o = rng.choice([x for x in rows if x[0] == r[0]])
        r[2:4] = o[2:4] if rng.random() < 0.5 else [o[2], r[3]]
    for r in rng.sample(rows, 30):
        r[2:] = rng.choice([x for x in rows if x[0] == r[0]])[2:]
    df = spark.createDataFrame(rows, "ord int, fam_id int, normcount double, overlap double, pvalue double")
    got = {(r.ord, r["rank"]): r.fam_id for r in srch.top_families(df, k).collect()}
    for c in range(5):
        want = sorted((x for x in rows if x[0] == c), key=lambda x: (-x[2], -x[3], -x[4], x[1]))[:k]
        assert [got[(c, i + 1)] for i in range(k)] == [x[1] for x in want]


# ------------------------------------------------------------ statistics


def exact_tail(x, n, p):
    p = Fraction(p)
    return sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(x, n + 1))


def neg_log(f: Fraction) -> float:
    return -(math.log(f.numerator) - math.log(f.denominator))


def test_binomial_tail(spark):
    cases = [(5, 5, 0.3), (3, 10, 0.1), (40, 200, 0.05), (10, 10, 0.999), (1, 300, 1e-6), (60, 300, 0.2), (7, 7, 1e-9), (0, 5, 0.2)]
    df = spark.createDataFrame(cases, "x long, n long, p double")
    for r, (x, n, p) in zip(df.select(st.neg_log_tail(F.col("x"), F.col("n"), F.col("p")).alias("v")).collect(), cases):
        assert r.v == pytest.approx(neg_log(exact_tail(x, n, p)), abs=1e-8, rel=1e-9)


def test_correction_and_gates(spark):
    r = spark.range(1).select(
        st.corrected(F.lit(30000.0), F.lit(10)).alias("top"), st.corrected(F.lit(1.0), F.lit(10)).alias("zero"),
        st.passes_alpha(F.lit(0.0), 1.0).alias("none"), st.passes_alpha(F.lit(1e-9), 1.0).alias("some"),
        st.covers(F.lit(0), F.lit(18), 6).alias("short"), st.covers(F.lit(0), F.lit(19), 6).alias("enough"),
    ).first()
    assert tuple(r) == (20000.0, 0.0, False, True, False, True)


# ------------------------------------------------------------ trees


def random_forest(rng, n):
    parent = {i: (None if i == 0 or rng.random() < 0.1 else rng.randrange(i)) for i in range(n)}
    path = {}
    for i in range(n):
        path[i] = [*path[parent[i]], i] if parent[i] is not None else [i]
    return parent, path


@pytest.mark.parametrize("seed", range(3))
def test_forest(spark, seed):
    rng = random.Random(seed)
    parent, path = random_forest(rng, 80)
    nodes = hierarchy.with_paths(spark.createDataFrame(list(parent.items()), "id int, parent int"))
    assert {r.id: (r.path, r.depth) for r in nodes.collect()} == {i: (p, len(p)) for i, p in path.items()}
    inner = {p for p in parent.values() if p is not None}
    assert {r.id for r in hierarchy.leaves(nodes, F.lit(0)).collect()} == {i for i in path if 0 in path[i] and i not in inner}
    assert [r.id for r in hierarchy.descendants(nodes, F.lit(0)).collect()] == [i for i in sorted(path, key=path.get) if 0 in path[i] and i]
    groups = [(g, rng.randrange(80)) for g in range(12) for _ in range(rng.randrange(1, 5))]
    df = spark.createDataFrame(groups, "g int, id int").join(nodes, "id")
    got = {r.g: r.lca for r in hierarchy.lowest_common_of(df, ["g"]).collect()}
    for g in range(12):
        ps = [path[i] for k, i in groups if k == g]
        common = [x[0] for x in zip(*ps) if len(set(x)) == 1]
        assert got[g] == (common[-1] if common else None)


def test_orphans_and_cycles(spark):
    with pytest.raises(ValueError):
        hierarchy.with_paths(spark.createDataFrame([(1, None), (2, 9)], "id int, parent int"))
    with pytest.raises(ValueError):
        hierarchy.with_paths(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent int"))


# ------------------------------------------------------------ placement


def naive_place(parent, path, own, prob, n, threshold):
    """Level by level: cumulate, score, follow the only best child."""
    kids = {i: [c for c in parent if parent[c] == i] for i in parent}
    cum = {}
    for i in sorted(parent, reverse=True):
        cum[i] = own.get(i, 0) + max((cum[c] for c in kids[i]), default=0)
    left = {0: n}
    score = {0: (cum[0] - prob[0] * n) / n}
    at, best = 0, [0]
    while kids[at]:
        for c in kids[at]:
            left[c] = left[at] - own.get(at, 0)
            score[c] = (cum[c] - prob[c] * left[c]) / left[c] if left[c] else -1.0
        top = max(score[c] for c in kids[at])
        winners = [c for c in kids[at] if score[c] == top and top > 0]
        if len(winners) != 1:
            break
        at = winners[0]
        best.append(at)
    good = [i for i in best if score[i] >= threshold]
    return (good[-1], score[good[-1]], cum[good[-1]]) if good else (0, None, None)


def test_placement_against_descent(spark):
    rng = random.Random(11)
    groups, counts, chosen, want = [], [], [], {}
    for case in range(150):
        size = rng.randrange(1, 9)
        parent = {i: (None if i == 0 else rng.randrange(i)) for i in range(size)}
        path = {}
        for i in range(size):
            path[i] = [*path[parent[i]], i] if parent[i] is not None else [i]
        prob = {i: rng.choice([0.0, 0.01, 0.2]) for i in parent}
        own = {i: rng.randrange(1, 5) for i in parent if rng.random() < 0.6} or {0: 1}
        n = sum(own.values()) + rng.randrange(1, 6)
        base = case * 100
        groups += [(base + i, case, None if p is None else base + p, len(path[i]), [base + x for x in path[i]], prob[i]) for i, p in parent.items()]
        counts += [(case, case, base + i, c) for i, c in own.items()]
        chosen.append((case, case, n))
        g, s, c = naive_place(parent, path, own, prob, n, 0.1)
        want[case] = (base + g, s, c)
    g = spark.createDataFrame(groups, "hog_id long, fam_id int, parent long, depth int, path array<long>, hog_prob double")
    scored = srch.scored_groups(spark.createDataFrame(chosen, "ord int, fam_id int, n long"), spark.createDataFrame(counts, "ord int, fam_id int, hog_id long, n long"), g)
    got = {r.ord: (r.hog_id, r.score, r.cum) for r in srch.place(srch.best_path(scored, g)).collect()}
    for case, (hog, s, c) in want.items():
        assert got[case][0] == hog, case
        assert got[case][1] == (None if s is None else pytest.approx(s)) and (got[case][2] == c or s == 0)


def test_chains_against_recursion(spark):
    rng = random.Random(4)
    parent, path = random_forest(rng, 60)
    own = {i: rng.randrange(1, 9) for i in parent if rng.random() < 0.4}
    nodes = spark.createDataFrame([(i, p) for i, p in path.items()], "hog_id int, path array<int>")
    got = {r.hog_id: r.cum for r in index.heaviest_chains(spark.createDataFrame([(1, i, n) for i, n in own.items()], "one int, hog_id int, n long"), nodes, ["one"]).collect()}
    cum = {}
    for i in sorted(parent, reverse=True):
        cum[i] = own.get(i, 0) + max((cum[c] for c in parent if parent[c] == i), default=0)
    assert got == {i: c for i, c in cum.items() if any(i in path[j] for j in own)}


def test_bound_test_rejects_what_the_exact_test_keeps(spark):
    """The divergence bound is part of the semantics: here the corrected exact
    p-value would pass, and the bound does not."""
    counts = spark.createDataFrame([(1, 1, 8, 0, 30)], "ord int, fam_id int, count long, low int, high int")
    sizes, lengths = spark.createDataFrame([(1, 40)], "ord int, n long"), spark.createDataFrame([(1, 45)], "ord int, len int")
    families = spark.createDataFrame([(1, 0.05)], "fam_id int, fam_prob double")
    p = float(exact_tail(8, 40, 0.05))
    alpha = p * 1.05
    kl = 0.2 * math.log(0.2 / 0.05) + 0.8 * math.log(0.8 / 0.95)
    assert kl <= -math.log(alpha) / 40 and -math.log(p) >= -math.log(alpha)
    assert srch.significant(counts, sizes, families, 6, alpha, lengths).count() == 0
    assert srch.significant(counts, sizes, families, 6, 0.05, lengths).count() == 1
