"""Importance resampling against a plain restatement."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from cladeloom.llm import resample


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_grams(text, least, most):
    w = plain_words(text)
    return [" ".join(w[i : i + n]) for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def plain_sample(rows, target, least, most, buckets, min_words, percent):
    h = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(map(h, plain_grams(x, least, most)))
    for x in target:
        t.update(map(h, plain_grams(x, least, most)))
    big, small = sum(s.values()), sum(t.values())
    out = []
    for i, x in rows:
        g = plain_grams(x, least, most)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (big + buckets) / ((s[b] + 1) * (small + buckets)))) for b in map(h, g))
        weight = math.floor(gain / len(g)) if g else 0
        u = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(plain_words(x)), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((u + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = [r[0] for r in able[: len(able) * percent // 100]]
    return out, drawn


def table(rng):
    rows = [(i, " ".join(rng.choice(["the", "The", "é", f"w{rng.randrange(60)}", "a-b", f"q{rng.randrange(10**6)}"]) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " . "), (403, "the " * 200_000 + "end"), (5, rows[5][1]), (5, rows[5][1]), (None, "the only " * 15), (None, "é")]
    target = [" ".join(f"w{rng.randrange(9)}" for _ in range(12)) for _ in range(20)] + [None, ""]
    return rows, target


@pytest.mark.parametrize("least,most,block", [(1, 1, 1 << 24), (1, 2, 3000), (2, 3, 500)])
def test_resample(spark, least, most, block):
    rows, target = table(random.Random(least * 10 + most))
    docs = spark.createDataFrame([(t, i, 1, 2) for i, t in rows], "text string, doc_id long, row int, total int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, wanted, min_words=3, percent=30, least=least, most=most, buckets=97, block_bytes=block).collect()
    out, drawn = plain_sample(rows, target, least, most, 97, 3, 30)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in got) == Counter(out)
    assert [r.doc_id for r in sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])] == drawn
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, len(drawn) + 1))


def test_nothing(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.select("text").limit(0)
    assert {(r.doc_id, r.n_features, r["rank"]) for r in resample.resample(docs, none, min_words=1, percent=100).collect()} == {(1, 2, 1), (2, 0, None)}
    assert resample.resample(docs.limit(0), docs.select("text")).count() == 0


def test_parts_of_a_long_text():
    rng = random.Random(2)
    raw = " ".join(f"w{rng.randrange(30)}" for _ in range(5000)).encode()
    for most in (1, 2, 3):
        found = Counter()
        for ws, known in resample.parts(raw, most, 700):
            found += resample.grams(ws, known, 1, most)
        assert found == Counter(x.encode() for x in plain_grams(raw.decode(), 1, most))
