"""The same pages give the same archives, however they are partitioned."""

from __future__ import annotations

import random

from cladeloom.llm import warc
from cladeloom.llm.common import scratch_path


def test_equal_archives(spark):
    rng = random.Random(4)
    big = 2**60
    rows = [(rng.choice([i, i, big + i]), f"http://a/{i}", "".join(rng.choice("abcdef") for _ in range(rng.choice([0, 20, 1500, 6000])))) for i in range(300)]
    rows += [(None, None, None), (None, "u", "n" * 3000), (5, "again", "n" * 3000), (5, "again", "n" * 3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    shard = 40_000
    found = []
    for parts in (1, 7, 3):
        path = scratch_path(spark, "warc-test")
        manifest = warc.write(pages.repartition(parts), path, roll_bytes=9_000, shard_bytes=shard)
        found.append(sorted((r.name, r.records, r.bytes, r.sha256) for r in manifest.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 10
    assert sum(r[1] for r in found[0]) == len(rows)
    first = warc.boundaries(pages, shard)
    size = lambda low, high: sum(len(h or "") for p, _, h in rows if p is not None and low <= p < high)
    cuts = [-1, *first, 2**62]
    assert len(first) > 8 and all(size(a, b) < shard + 20_000 for a, b in zip(cuts, cuts[1:]))
    assert [warc.shard_of(first) is not None, len(set(first))] == [True, len(first)]
