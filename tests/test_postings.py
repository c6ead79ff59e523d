"""Postings in buckets of an integer k-mer code, and the binomial tail."""

from __future__ import annotations

import glob
import random
from decimal import Decimal, getcontext

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cladeloom.functions import sequences as sq
from cladeloom.functions import statistics as st
from cladeloom.operators import index, kmers
from cladeloom.operators import search as srch


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("k,reduced", [(6, False), (7, False), (3, True)])
def test_codes(spark, k, reduced):
    rng, letters = random.Random(k), sq.alphabet(reduced)
    rows = [("".join(rng.choice(letters) for _ in range(n)),) for n in (k - 1, k, 30, 200)] + [("X" * k,), ("A" * (k + 1),)]
    df = spark.createDataFrame(rows, "seq string")
    want = sorted(s[i : i + k] for (s,) in rows for i in range(len(s) - k + 1))
    got = sq.explode_codes(df, "seq", k, [], reduced)
    assert sorted(r.kmer for r in got.select(sq.kmer_of(F.col("code"), k, reduced).alias("kmer")).collect()) == want
    number = lambda x: sum(letters.index(c) * len(letters) ** (k - 1 - i) for i, c in enumerate(x))
    assert sorted(r.code for r in got.collect()) == sorted(map(number, want))


@pytest.fixture(scope="module")
def postings(spark):
    rows = spark.range(4_000_000).select((F.col("id") * 17 % 9_000_011).alias("code"), (F.col("id") % 97).cast("int").alias("fam_id"), (F.col("id") % 1009).alias("hog_id"))
    path, buckets = index.store(rows)
    return index.stored(spark, path, buckets), rows, path


def test_postings_do_not_move(spark, postings, monkeypatch):
    """With broadcasts off and many queries the only exchange is the queries'."""
    monkeypatch.setattr(srch, "FEW_CODES", 0)
    stored, plain, _ = postings
    rng = random.Random(3)
    queries = spark.createDataFrame([(i, "".join(rng.choice("ACDEFG") for _ in range(120))) for i in range(40)], "ord long, seq string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = srch.hits(queries, stored)
        plan = plan_of(found)
        assert "ShuffledHashJoin" in plan and plan.count("Exchange") == 1 and "Bucketed: true" in plan
        assert plan.index("Exchange") < plan.index("Bucketed: true") and "Sort" not in plan
        got = sorted(tuple(r) for r in found.collect())
        assert got == sorted(tuple(r) for r in srch.hits(queries, plain).select(*found.columns).collect()) and got
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_few_queries_read_few_row_groups(spark, postings):
    stored, plain, path = postings
    codes = [5, 6, 7, 4_000_000, 4_000_017, 8_999_999]
    asked = spark.createDataFrame([(c,) for c in codes], "code long")
    near = srch.near(stored, asked)
    assert "PushedFilters: [Or(" in plan_of(near) and "GreaterThanOrEqual(code,6)" in plan_of(near)
    assert sorted(map(tuple, asked.join(near, "code").collect())) == sorted(map(tuple, asked.join(plain, "code").collect()))
    read = groups = 0
    for f in glob.glob(f"{path.removeprefix('file:').removeprefix('//')}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for i in range(meta.num_row_groups):
            s = meta.row_group(i).column(0).statistics
            groups += 1
            read += any(s.min <= c <= s.max for c in codes)
    assert groups > 8 and read < groups / 2
    assert srch.near(stored, asked.limit(0)) is stored


@pytest.mark.parametrize("most", [1, 3, 64])
def test_ranges_hold_all_codes(spark, monkeypatch, most):
    monkeypatch.setattr(srch, "RANGES", most)
    rng = random.Random(most)
    codes = sorted(rng.sample(range(10_000), 50))
    got = srch.near(spark.range(10_000).select(F.col("id").alias("code")), spark.createDataFrame([(c,) for c in codes], "code long"))
    assert set(codes) <= {r.code for r in got.collect()} and got.count() >= 50


def decimal_tail(x, n, p):
    getcontext().prec = 60
    q = 1 - p
    term = Decimal(1)
    for i in range(min(x, n - x)):
        term = term * (n - i) / (i + 1)
    term = term * p**x * q ** (n - x)
    total, t = Decimal(0), term
    for j in range(x, n + 1):
        total += t
        t = t * (n - j) / (j + 1) * p / q
        if t < total * Decimal(10) ** -40:
            break
    return -total.ln()


def test_tail_of_large_samples(spark):
    cases = []
    for n in (1, 2, 15, 16, 40, 1000, 30_000, 1_000_000):
        for p in ("0.000001", "0.003", "0.5", "0.9"):
            mean = n * float(p)
            sd = (mean * (1 - float(p))) ** 0.5
            cases += [(x, n, float(p), float(decimal_tail(x, n, Decimal(float(p))))) for x in {max(1, -int(-mean // 1)), int(mean + 2 * sd) + 1, int(mean + 12 * sd) + 1, n} if mean <= x <= n and not (x == n > 5000)]
    df = spark.createDataFrame(cases, "x long, n long, p double, want double")
    for r in df.withColumn("got", st.neg_log_tail(F.col("x"), F.col("n"), F.col("p"))).collect():
        assert abs(r.got - r.want) <= 1e-9 * max(r.want, 1e-3), r


@pytest.mark.parametrize("k,reduced,block", [(6, False, 64), (3, True, 7), (7, False, 1 << 20)])
def test_spans_are_combined_in_blocks(k, reduced, block):
    """Each block gives a k-mer of a family once, whatever the block cuts."""
    rng, letters = random.Random(block), sq.alphabet(reduced)
    rows = [(fam, pre, "".join(rng.choice(letters[:3]) for _ in range(n))) for fam, pre, n in [(2, 9, 40), (1, 3, 0), (1, 4, k), (2, 8, 300), (1, 3, k - 1), (1, 2, 90), (7, 1, 200)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.string()))], names=["fam_id", "pre", "seq"])
    want, at = {}, {}
    place = 0
    for fam, pre, s in rows:
        for i in range(len(s) - k + 1):
            key = (sum(letters.index(c) * len(letters) ** (k - 1 - j) for j, c in enumerate(s[i : i + k])), fam)
            want.setdefault(key, []).append(pre)
            at.setdefault(key, set()).add((place + i) // block)
        place += len(s)
    found = {}
    for out in kmers.spans_of(k, reduced, block)(iter([batch.slice(0, 3), batch.slice(7)])):
        assert out.num_rows
    for out in kmers.spans_of(k, reduced, block)(iter([batch])):
        for r in out.to_pylist():
            found.setdefault((r["code"], r["fam_id"]), []).append((r["low"], r["high"]))
    assert {c: (min(x)[0], max(y for _, y in x)) for c, x in found.items()} == {c: (min(x), max(x)) for c, x in want.items()}
    assert all(len(found[c]) == len(at[c]) for c in want)
    with pytest.raises(ValueError, match="sanitised"):
        list(kmers.spans_of(k, reduced)(iter([pa.RecordBatch.from_pydict({"fam_id": [1], "pre": [1], "seq": ["acdefgh"]})])))
