"""Line dedup against a plain restatement: ties, nulls, repeated ids, hot lines."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cladeloom.llm import lines

BLANK = " \t\n\x0b\x0c\r"


def plain_key(line):
    key = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    return key if len(key) >= 20 else None


def plain_lines(rows):
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if plain_key(x) is not None:
                held[plain_key(x)].add(i)
    last = {k: max(s, key=lambda i: (i is not None, i or 0)) for k, s in held.items() if len(s) >= 3}
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        stay = [x for x in ls if plain_key(x) not in last or last[plain_key(x)] == i]
        out.append((i, "\n".join(stay), len(ls), len(ls) - len(stay)))
    return Counter(out)


def table(rng):
    common = ["This line stands in nearly every text", "  And THIS one, with blanks around \t", "é" * 20, "é" * 19, "x" * 20, "y" * 19, "short"]
    rows = []
    for i in range(240):
        ls = [f"own line number {i} of {rng.random()}" for _ in range(rng.randrange(4))]
        ls += [rng.choice([c, c.upper(), c + "\r", "\x0b" + c]) for c in common if rng.random() < 0.4] + [""] * rng.randrange(2)
        rng.shuffle(ls)
        rows.append((i, "\n".join(ls)))
    rows += [(900, "in two texts only, so it stays here"), (901, "in two texts only, so it stays here")]
    rows += [(7, rows[7][1])] * 80 + [(7, common[0])] * 3 + [(None, None), (None, common[0] + "\n" + common[0]), (None, ""), (950, common[0] + "\n" + common[0]), (951, "\n"), (952, "long " * 300_000 + "\n" + common[1])]
    return rows


def test_lines(spark):
    rows = table(random.Random(5))
    schema = "doc_id long, text string, `__tag` string, rows int, digests int"
    docs = spark.createDataFrame([(i, t, "a", 1, 2) for i, t in rows], schema).repartition(5)
    got = lines.drop_repeated_lines(docs, counts=("n", "gone"))
    assert Counter((r.doc_id, r.text, r.n, r.gone) for r in got.collect()) == plain_lines(rows)
    assert lines.drop_repeated_lines(docs).columns == docs.columns
    assert lines.drop_repeated_lines(docs.limit(0)).count() == 0


def test_filter_misses_nothing():
    """Every hash of two tasks, or twice in one, has its bits in the merged filter; most others have not."""
    import pyarrow as pa

    rng, blocks = np.random.default_rng(1), 32
    once, both = rng.integers(0, 2**63, 8000).astype(np.uint64), rng.integers(0, 2**63, 500).astype(np.uint64)
    batches = []
    for part, again in ((np.concatenate([once[:4000], both]), False), (np.concatenate([once[4000:], both[:250]]), False), (both[250:], True)):
        own, bits = lines._by_block(np.unique(part), blocks)
        batches.append(pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(np.full(len(own), again)), bits], names=["block", "twice", "bits"]))
    for order in (batches, batches[::-1]):
        out = next(iter(lines._merge(iter(order))))
        table = np.zeros((blocks, lines.BLOCK_BITS // 8), np.uint8)
        for b, x in zip(out.column("block").to_pylist(), out.column("bits").to_pylist()):
            table[b] = np.frombuffer(x, np.uint8)
        def among(h):
            block, at = lines.places(h, blocks)
            return ((table[block[:, None], at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=1)
        assert among(both).all() and among(once).mean() < 0.05


@pytest.mark.parametrize("seed", [1, 2])
def test_small_filter(spark, monkeypatch, seed):
    """A full filter suspects more and changes nothing."""
    monkeypatch.setattr(lines, "LEAST_BITS", lines.BLOCK_BITS)
    monkeypatch.setattr(lines, "MAX_BITS", lines.BLOCK_BITS)
    rng = random.Random(seed)
    rows = [(i, "\n".join(f"line number {rng.randrange(2000)} of a large table" for _ in range(30))) for i in range(150)]
    got = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), counts=("n", "gone"))
    assert Counter((r.doc_id, r.text, r.n, r.gone) for r in got.collect()) == plain_lines(rows)
