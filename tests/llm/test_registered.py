"""The registered queries that have no SQL, held against plain restatements of
their contracts on a table with repeated, empty, long and shared texts."""

from __future__ import annotations

import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_small import plain_components, plain_cut, plain_fingerprint, plain_passages

from cladeloom.llm import binary, quality, registry, toxicity
from cladeloom.llm.common import scratch_path

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """sf0.001's documents with a skewed group, and its other tables."""
    where = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    own = [(r.doc_id, r.text) for r in docs.collect()]
    top = max(i for i, _ in own) + 1
    long = max((t for _, t in own if t), key=len)
    common = " ".join(f"w{rng.randrange(900)}" for _ in range(90))  # over 400 bytes in a third of all texts
    more = [None, "", "  \n", "one", long, long + " end", "é" * 900, own[3][1], own[3][1], "x" * 1200, " ".join(f"q{rng.randrange(10**6)}" for _ in range(6000))]
    more += [f"a{i} {rng.random()} {common} {rng.random()}" for i in range(100)] + [common[:399], common[1:402]]
    rows = own + [(top + i, t) for i, t in enumerate(more)]
    spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], docs.schema).repartition(5).write.parquet(f"{where}/documents.parquet")
    for t in ("benchmark", "labels", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{where}/{t}.parquet")
    return str(where), rows


def result(spark, sf, name):
    return registry.QUERIES[name](spark, sf[0])


def expected_ids(rows):
    import public_tokenizers
    import tokenizers

    full = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return {i: [*full.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_packing(spark, sf):
    """Every piece, its checksum, gapless places, and as few sequences as the bound allows."""
    got = result(spark, sf, "op3_best_fit_packing")
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got.columns)
    ids, by_doc, bins = expected_ids(sf[1]), defaultdict(list), defaultdict(list)
    for r in got.collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort()
        assert [p for p, _, _ in parts] == list(range(len(parts))) == list(range(-(-len(ids[i]) // 2048)))
        assert [s for _, s, _ in parts] == [sum(n for _, _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, _, n in parts) == len(ids[i])
        assert all(n == 2048 for _, _, n in parts[1:])
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))] and sum(n for _, n in places) <= 2048
    sizes = sorted((n for p in by_doc.values() for _, _, n in p), reverse=True)
    least = max(-(-sum(sizes) // 2048), sum(2 * n > 2048 for n in sizes))
    assert least <= len(bins) <= least + 1


def test_simhash(spark, sf):
    got = result(spark, sf, "op5_simhash_near_dedup").collect()
    fp = {i: plain_fingerprint(t) for i, t in sf[1]}
    root = plain_components(set(fp.values()), 2)
    least = defaultdict(list)
    for i, x in fp.items():
        least[root[x]].append(i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{x:016x}", min(least[root[x]])) for i, x in fp.items()} and len(got) == len(sf[1])


def test_repeated_strings(spark, sf):
    got = result(spark, sf, "op8_suffix_array_dedup")
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"]
    want, rows = plain_cut(sf[1], 400), got.collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    assert Counter((r.doc_id, r.n_passage_words) for r in rows) == plain_passages(sf[1], 51)
    assert sum(k[2] > 0 for k in want) > 100


def test_token_shards(spark, sf):
    """The pieces as read back from the shards are the tokenizer's ids, each once."""
    got = result(spark, sf, "op7_token_binary").collect()
    ids, found, places = {i: [*x[:-1], binary.END_ID] for i, x in expected_ids(sf[1]).items()}, defaultdict(list), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.sound and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        found[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for i, whole in ids.items():
        assert sum(n for _, n in found[i]) == len(whole) and len({s for s, _ in found[i]}) == len(found[i])
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048


def test_toxicity(spark, sf):
    """Scores are the sum over all pairs of the text's terms; folds and decisions."""
    got = {r.doc_id: r for r in result(spark, sf, "op9_toxicity").collect()}
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet")
    model = toxicity.learn(docs.select("doc_id", "text"), spark.read.parquet(f"{sf[0]}/labels.parquet"))
    place = {int(h): k for k, h in enumerate(model.table)}
    assert set(got) == {i for i, _ in sf[1]}
    for i, t in sf[1]:
        at = [place[int(h)] for h in toxicity.terms((t or "").encode()) if int(h) in place]
        z = model.bias + sum(model.weights[a] for a in at) + sum(float(model.vectors[a] @ model.vectors[b]) for n, a in enumerate(at) for b in at[:n])
        r = got[i]
        assert abs(r.score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6 and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    fold = {i: y for i, y in labels.items() if i in got and got[i].held_out}
    right = sum(got[i].predicted == y for i, y in fold.items())
    assert right >= 0.85 * len(fold)


def test_quality(spark, sf):
    """Votes restated, posteriors by a plain loop of the same estimate, scores by a plain sum."""
    got = {r.doc_id: r for r in result(spark, sf, "op2_quality").collect()}
    votes = {i: quality.votes(quality.measures((t or "").encode())) for i, t in sf[1]}
    assert {i: r.votes for i, r in got.items()} == {i: "".join("0+-"[x] for x in v) for i, v in votes.items()}
    n, patterns = len(quality.LABELLERS), list(votes.values())
    p = [0.05 if v.count(-1) >= 2 else 0.5 if v.count(-1) == 1 else 0.95 for v in patterns]
    for _ in range(200):
        prior = (sum(p) + 1) / (len(p) + 2)
        good, bad = [], []
        for k in range(n):
            up = sum(q for v, q in zip(patterns, p) if v[k] == 1)
            down = sum(q for v, q in zip(patterns, p) if v[k] == -1)
            good.append((up + 2) / (up + down + 2.5))
            up = sum(1 - q for v, q in zip(patterns, p) if v[k] == 1)
            down = sum(1 - q for v, q in zip(patterns, p) if v[k] == -1)
            bad.append((down + 1) / (up + down + 2))
        after = []
        for v in patterns:
            a, b = prior, 1 - prior
            for k in range(n):
                if v[k]:
                    a *= good[k] if v[k] == 1 else 1 - good[k]
                    b *= bad[k] if v[k] == -1 else 1 - bad[k]
            after.append(a / (a + b))
        moved = max(abs(x - y) for x, y in zip(p, after))
        if moved < 1e-9:
            break
        p = after
    for (i, _), q in zip(votes.items(), after):
        assert abs(got[i].posterior - q) < 1e-6
    _, scorer = quality.learn(spark.read.parquet(f"{sf[0]}/documents.parquet").select("doc_id", "text"))
    for i, t in sf[1][:40]:
        raw = (t or "").encode()
        x = quality.features(raw, quality.measures(raw))
        z = scorer.bias + sum(float(a) * float(b) for a, b in zip(x, scorer.weights))
        assert abs(got[i].score - 1 / (1 + np.exp(-z))) < 1e-3 and got[i].kept == (got[i].score >= 0.5)


def test_pipeline_survivors(spark):
    """Planted copies, near copies and leaks go, one of each group stays; nulls,
    repeated ids and rows, and columns with the names the stages use are kept."""
    import corpus_pipeline as p

    rng = random.Random(12)
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text and len(r.text.split()) > 12)
    words = lambda n: [f"{rng.choice('bcdfgklmn')}{rng.randrange(10**7)}" for _ in range(n)]
    clean = [" ".join(words(rng.randrange(60, 400))) for _ in range(40)]
    near = clean[1].split()
    near[30] = "other"
    rows = [(i, t) for i, t in enumerate(clean)]
    rows += [(100, clean[0].replace(" ", "\n")), (101, " ".join(near)), (102, clean[2] + " " + item + " " + clean[3][:100]), (103, None), (104, ""), (105, "  ")]
    rows += [(5, " ".join(words(90))), (6, clean[6]), (6, clean[6]), (None, " ".join(words(80))), (None, clean[7]), (106, clean[8] + " " + " ".join(words(8)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, `__tag` string, rows int, stay int, root long, `__k` string"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", 1, 2, 3, "k") for i, t in rows], schema).repartition(4)
    for _, stage in p.STAGES[1:4]:
        docs = stage(spark, docs, SF)
        docs.write.parquet(path := scratch_path(spark, "test-stage"))
        docs = spark.read.parquet(path)
        assert len(docs.columns) == 10
    kept = Counter((r.doc_id, r.text) for r in docs.collect())
    want = Counter((i, t) for i, t in enumerate(clean) if i != 7)
    want += Counter([(105, "  "), rows[46], rows[49], (None, clean[7])])
    assert kept == want
    packed = p.STAGES[4][1](spark, docs, SF)
    assert packed.count() >= sum(want.values())
