"""Brute-force twins and edge cases of the text operators on small tables."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeloom.llm import bestfit, binary, components, decontam, exact_dedup, lmscore, quality, simhash, suffixes, tokens, toxicity, warc
from cladeloom.llm.common import scratch_path

DOCS = "doc_id long, text string, n_words string, spans int, score double, kept string, `__tag` string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau über ñandú".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [text(rng, rng.randrange(1, 120)) for _ in range(40)]
    long = text(rng, 30_000)
    out = [(i, t) for i, t in enumerate(base)]
    out += [(100, base[3]), (101, base[3].replace(" ", "\n\t ")), (102, base[3] + "  "), (103, ""), (104, None), (105, " \x0b\x0c\r\n"), (106, long), (107, long + " end")]
    out += [(108, base[5]), (108, base[5]), (None, base[7]), (None, "only here"), (109, "x" * 900), (110, "é" * 700), (111, base[9] + " extra words"), (5, "other text under a used id")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 0.5, "k", "t") for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# ------------------------------------------------------------ exact dedup


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is not None, i or 0, i))
    out = Counter()
    for norm, g in groups.items():
        keep = min(g)[3]
        for _, _, _, i in g:
            out[(i, keep, len(g), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


def test_exact_dedup(docs, rows, empty):
    got = exact_dedup.assign(docs)
    assert bag(got.drop("kept")) == plain_exact(rows)
    assert got.filter("kept").count() == len({re.sub("[\x20\x09-\x0d]", "", t or "") for _, t in rows})
    stays = exact_dedup.deduplicate(docs)
    assert stays.columns == docs.columns
    texts = Counter(re.sub("[\x20\x09-\x0d]", "", r.text or "") for r in stays.collect())
    assert set(texts.values()) == {1} and len(texts) == got.filter("kept").count()
    assert exact_dedup.assign(empty).count() == 0 and exact_dedup.deduplicate(empty).count() == 0


def test_index_in_batches(spark, rows):
    """Ten batches over several compactions: what is seen, what wins, how many."""
    rng = random.Random(8)
    every = [(i, t) for i, (_, t) in enumerate(rows * 2)]
    rng.shuffle(every)
    index, seen = exact_dedup.DigestIndex(spark), set()
    for part in range(10):
        batch = every[part::10]
        before = index.made
        got = index.insert(spark.createDataFrame(batch, "doc_id long, text string"))
        digest = {i: hashlib.sha256(re.sub("[\x20\x09-\x0d]", "", t or "").encode()).digest() for i, t in batch}
        assert {r.best.id for r in got.collect()} == {i for i, d in digest.items() if d in seen}
        assert index.made > before and len({r.path for r in index.runs}) == len(index.runs)
        seen |= set(digest.values())
    assert max(r.level for r in index.runs) == 1 and index.made == 12
    want = {}
    for (i, keep, n, sha), _ in plain_exact(every).items():
        want[sha] = (keep, n)
    level = {bytes(r.digest).hex(): (r.best.id, r.rows) for r in index.level().collect()}
    assert level == want
    assert {bytes(r.digest).hex(): (r.best.id, r.rows) for r in index.hits().collect()} == {k: v for k, v in want.items() if v[1] > 1}


def test_exact_dedup_collision(docs, rows, monkeypatch):
    """With a digest that collides for all texts the bytes decide."""
    real = F.sha2
    monkeypatch.setattr(F, "sha2", lambda c, n: real(F.encode(F.lit("same"), "UTF-8"), n))
    got = exact_dedup.assign(docs)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got.collect()) == Counter({k[:3]: 0 for k in ()}) + Counter(
        e for k, n in plain_exact(rows).items() for e in [k[:3]] * n)


# ------------------------------------------------------------ SimHash


def plain_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    c = [0] * 64
    for x in s:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        for b in range(64):
            c[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * c[b] > len(s))


def plain_components(fps, radius):
    left, out = set(fps), {}
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= radius}
            left -= near
            todo += near
        for x in group:
            out[x] = min(group)
    return out


def test_simhash(docs, rows, empty):
    got = simhash.assign(docs).collect()
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components({f for _, f in fp}, 2)
    least = defaultdict(list)
    for i, f in fp:
        if i is not None:
            least[comp[f]].append(i)
    want = Counter((i, f, min(least[comp[f]], default=None)) for i, f in fp)
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    stays = simhash.near_deduplicate(docs, seeds=0)
    assert stays.columns == docs.columns
    assert Counter(comp[plain_fingerprint(r.text)] for r in stays.collect()) == Counter({c: 1 for c in set(comp.values())})
    assert simhash.assign(empty).count() == 0 and simhash.near_deduplicate(empty).count() == 0


def test_similar_texts_are_linked(spark):
    """Copies with a few edits go, texts below 0.8 stay, the smallest id stays."""
    rng, rows = random.Random(12), []
    gram = lambda t: {tuple(t.split()[j : j + 5]) for j in range(max(1, len(t.split()) - 4))}
    for k in range(40):
        w = text(rng, 200).split()
        for c, edits in enumerate((0, 1, 2, 30)):
            v = list(w)
            for at in rng.sample(range(200), edits):
                v[at] = f"new{rng.randrange(10**6)}"
            rows.append((k * 10 + c, " ".join(v)))
    docs = spark.createDataFrame([*rows, (None, rows[0][1] + " tail"), (None, None), (None, "")], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_deduplicate(docs).collect()}
    told = dict(rows)
    for i, t in rows:
        near = [j for j in range(i // 10 * 10, i) if j in told and len(gram(told[j]) & gram(t)) >= 0.8 * len(gram(told[j]) | gram(t))]
        if not near:
            assert i in kept, i
    gone = sum(i not in kept for i, _ in rows if i % 10 in (1, 2))
    assert gone >= 76 and all(k * 10 in kept and k * 10 + 3 in kept for k in range(40))


def five(t):
    w = t.split()
    return {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}


def test_failed_representative_stands_for_nobody(spark):
    """R holds the words of X and Y in another order: R-X and R-Y fail, X-Y is linked."""
    rng, told = random.Random(31), []
    for k in range(12):
        w = [f"w{k}x{i}" for i in range(200)]
        r, y = rng.sample(w, 200), w[:50] + [w[51], w[50]] + w[52:]
        told += [" ".join(v) for v in (r, w, y)]
        r, x, y = map(five, told[-3:])
        assert not r & x and not r & y and len(x & y) >= 0.8 * len(x | y)
    kept = {d.doc_id for d in simhash.near_deduplicate(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).collect()}
    assert kept == {i for i in range(36) if i % 3 < 2}


def test_every_similar_pair_is_found(spark):
    """Added, removed and moved passages, short texts and a common passage:
    what stays is what an all-pairs search leaves."""
    rng, told = random.Random(32), []
    common = text(rng, 60)
    for k in range(30):
        w = text(rng, rng.choice([3, 5, 8, 20, 200, 400])).split()
        new = text(rng, rng.randrange(1, max(2, len(w) // 4))).split()
        at = rng.randrange(len(w) + 1)
        told += [" ".join(v) for v in (w, w[:at] + new + w[at:], new + w, w + new, w[: -max(1, len(w) // 10)], w[len(w) // 5 :], [*w[:-1], "last"], [common, *w[:12]])]
    sets, root = [five(t) for t in told], list(range(len(told)))
    for y in range(len(told)):
        for x in range(y):
            if root[x] != root[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                low, high = sorted((root[x], root[y]))
                root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")
    for r in simhash.assign(docs).collect():  # the two-bit rule links as well
        low, high = sorted((root[r.doc_id], root[r.component_id]))
        root = [low if v == high else v for v in root]
    assert len(set(root)) < 200
    assert {d.doc_id for d in simhash.near_deduplicate(docs.repartition(3)).collect()} == set(root)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover(radius):
    rng = random.Random(radius)
    masks = simhash.covering_masks(list(range(64)), radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    for _ in range(500):
        x = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & x == 0 for m in masks)


def test_crowded_buckets(spark):
    """Fingerprints that differ in few places overfill the first tables."""
    rng = random.Random(9)
    fps = {rng.getrandbits(12) << 5 for _ in range(700)} | {rng.getrandbits(63) for _ in range(50)}
    table = spark.createDataFrame([(3, f) for f in fps], "space long, fp long")
    edges = simhash.links(table, 2, split=16)
    assert {r.space for r in edges.select("space").distinct().collect()} == {3}
    roots = {r.node: r.root for r in components.components(edges.select("a", "b")).collect()}
    assert {f: roots.get(f, f) for f in fps} == plain_components(fps, 2)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 105: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ decontamination


def test_repeated_short_item_is_no_leak(spark):
    """A short item that stands often in a row makes no run of a whole window."""
    bench = spark.createDataFrame([(1, "tiny little benchmark item"), (2, "alpha"), (3, "one two three four five six seven eight")], "item_id long, text string")
    told = [(1, "so tiny little benchmark item tiny little benchmark item so"), (2, "alpha " * 9), (3, "x one two three four five six seven eight y"), (4, "alpha tiny little benchmark item")]
    docs = spark.createDataFrame(told, "doc_id long, text string")
    for block in (decontam.BLOCK_BYTES, 10):
        assert {r.doc_id for r in decontam.decontaminate(docs, bench, block_bytes=block).collect()} == {1, 2}


def plain_leaks(t, items):
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    w, hit, names = pat.findall(low(t)), set(), set()
    for i, x in items:
        v = pat.findall(low(x))
        for k in range(max(1, len(v) - 7) if v else 0):
            win = v[k : k + 8]
            for j in range(len(w) - len(win) + 1):
                if w[j : j + len(win)] == win:
                    hit |= set(range(j, j + len(win)))
                    names.add(str(i))
    return len(w), len(hit), sorted(names)


ITEMS = [(1, "One two three, four five SIX seven eight nine."), (2, "tiny item"), (3, None), (4, ""), (10, "four five six seven eight nine ten eleven"), (None, "alpha"), (2, "second text of two")]


@pytest.mark.parametrize("block", [1 << 19, 40])
def test_decontamination(spark, docs, rows, block):
    extra = [(500, "x one TWO three (four) five six\nseven eight nine ten eleven y"), (501, "a tiny, item"), (502, "tiny itemx"), (503, "ß one two three four five six seven eight")]
    table = spark.createDataFrame([(i, t) for i, t in rows] + extra, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    known = [(i, t) for i, t in ITEMS if i is not None]
    for r in decontam.scan(table, bench, block_bytes=block).collect():
        assert (r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), r["items"]) == plain_leaks(r.text, known), r.doc_id
        for s in r.spans:
            part = r.text.encode()[s["start"] : s["end"]].decode()
            assert len(decontam.words(part.encode())) == s["last"] - s["first"] + 1
    stays = {r.doc_id for r in decontam.decontaminate(table, bench).collect()}
    assert 500 not in stays and 503 not in stays and {501, 502, 0, 104} <= stays


def test_decontamination_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs, none).count() == docs.count()
    assert decontam.decontaminate(empty, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
    assert decontam.decontaminate(docs, none).columns == docs.columns


# ------------------------------------------------------------ packing


def test_packing(docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for items, slack in ((100_000, 1), (20, 4)):  # many tiny partitions leave some bins that exchange cannot fill
        got = bestfit.pack(docs, part_items=items).collect()
        want = Counter()
        for i, x in rows:
            ids = t.encode(x or "", add_special_tokens=False).ids + [0]
            for k, (s, n) in enumerate(bestfit.cut(len(ids))):
                want[(i, k, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()))] += 1
        assert Counter(tuple(r)[:5] for r in got) == want
        by = defaultdict(list)
        for r in got:
            by[r.sequence_id].append((r.offset, r.length))
        for v in by.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:j]) for j in range(len(v))] and sum(n for _, n in v) <= 2048
        bound = bestfit.lower_bound(np.array([r.length for r in got]))
        assert bound <= len(by) <= bound + slack
    assert bestfit.pack(empty).count() == 0


def test_bounds_are_bounds():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([7, 10, 16])
        sizes = [rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 8))]

        def fits(items, bins):
            if not items:
                return True
            tried = set()
            for b in range(len(bins)):
                if bins[b] >= items[0] and bins[b] not in tried:
                    tried.add(bins[b])
                    bins[b] -= items[0]
                    if fits(items[1:], bins):
                        bins[b] += items[0]
                        return True
                    bins[b] += items[0]
            return False

        best = next(k for k in range(1, 9) if fits(sorted(sizes, reverse=True), [cap] * k))
        assert bestfit.lower_bound(np.array(sizes), cap) <= best <= len(bestfit.best_fit(sorted(sizes, reverse=True), cap)[2])


def test_token_engines_agree():
    enc = tokens.encoder(tokens.default_path())
    rng = random.Random(2)
    cases = ["", " ", "a" * 3000, "  x  \n\n y's 12 345!? ", "<|endoftext|> x", "日本語 текст", "été Ñ ß ſ", "\x1c a", text(rng, 40_000), "word " * 30_000, " " * 5000 + "z"]
    for c in cases:
        assert enc.ids(c).tolist() == enc.full.encode(c, add_special_tokens=False).ids, c[:40]


# ------------------------------------------------------------ binary shards


def test_capacity_tree():
    rng, tree, plain = random.Random(4), binary.CapacityTree(100), []
    for n in range(3000):
        if rng.random() < 0.5 or not plain:
            free = rng.randrange(1, 101)
            tree.add(free, n)
            plain.append(free)
        else:
            s = rng.randrange(1, 101)
            want = min((f for f in plain if f >= s), default=None)
            got = tree.take(s)
            assert (got and got[0]) == want
            if want:
                plain.remove(want)


def test_shards(spark, docs, rows, empty):
    path = scratch_path(spark, "test-shards")
    manifest = binary.write(docs, path, shard_tokens=5000)
    assert manifest.count() > 1
    enc = tokens.encoder(tokens.default_path())
    want = Counter()
    for i, x in rows:
        ids = np.append(enc.ids(x or ""), np.array([binary.END_ID], "<u4"))
        for k, (s, n) in enumerate(binary.split(len(ids))):
            want[(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes()))] += 1
    got = binary.read_pieces(spark, path).collect()
    assert Counter((r.doc, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want and all(r.sound for r in got)
    nothing = scratch_path(spark, "test-shards")
    binary.write(empty, nothing)
    assert binary.read_pieces(spark, nothing).count() == 0


def test_shard_bytes():
    import pyarrow as pa

    ids = [np.arange(1, 6, dtype="<u4"), np.arange(70_000, 70_012, dtype="<u4"), np.array([9], "<u4")]
    got = binary.decode_shard(binary.encode_shard(ids, pa.array([1, None, 3]), 8, 0))
    assert got["ids"].dtype == np.uint32 and got["ids"].shape[1] == 8
    back = defaultdict(dict)
    for p in got["pieces"].to_pylist():
        back[p["doc"]][p["start"]] = got["ids"][p["row"], p["offset"] : p["offset"] + p["length"]].tolist()
        assert got["positions"][p["row"], p["offset"]] == 0
    assert {k: sum((v[s] for s in sorted(v)), []) for k, v in back.items()} == {1: ids[0].tolist(), None: ids[1].tolist(), 3: [9]}
    assert all(s[0] == 0 and (np.diff(s) > 0).all() for s in got["cu_seqlens"])


# ------------------------------------------------------------ language model


def plain_scores(rows, order=3, alpha=0.4, least=2):
    ws = [(i, (t or "").encode().lower().split()) for i, t in rows]
    c = Counter(tuple(w[j : j + n]) for _, w in ws for n in range(1, order + 1) for j in range(len(w) - n + 1))
    total = sum(len(w) for _, w in ws)
    out = Counter()
    for i, w in ws:
        s = 0.0
        for j in range(len(w)):
            m = min(j + 1, order)
            while m > 1 and c[tuple(w[j - m + 1 : j + 1])] < least:
                s += np.log(alpha)
                m -= 1
            top = c[tuple(w[j - m + 1 : j + 1])]
            s += np.log(top) - np.log(c[tuple(w[j - m + 1 : j])] if m > 1 else total)
        out[(i, len(w), round(s, 5))] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000, "bucket_bytes": 3_000}, {"order": 2, "min_count": 1}])
def test_lm_scores(docs, rows, options, monkeypatch):
    if "block_bytes" in options:
        monkeypatch.setattr(lmscore.chunks, "__defaults__", (500,))
    got = lmscore.score(docs, **options).collect()
    want = plain_scores(rows, options.get("order", 3), least=options.get("min_count", 2))
    assert Counter((r.doc_id, r.n_words, round(r.log_score, 5) + 0.0) for r in got) == want


def test_lm_packing(empty):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 64, 5000, dtype=np.uint64))
    assert (lmscore.unpack_keys(lmscore.pack_keys(keys)) == keys).all()
    v = np.array([0, 1, 254, 255, 256, 1 << 40])
    assert (lmscore.unpack_counts(lmscore.pack_counts(v), len(v)) == v).all()
    assert lmscore.score(empty).count() == 0


# ------------------------------------------------------------ repeated strings


def plain_cut(rows, length):
    ts = [(i, (t or "").encode()) for i, t in rows]
    n = Counter(x[j : j + length] for _, x in ts for j in range(len(x) - length + 1))
    out = Counter()
    for i, x in ts:
        gone = np.zeros(len(x), bool)
        for j in range(len(x) - length + 1):
            if n[x[j : j + length]] > 1:
                gone[j : j + length] = True
        rest = bytes(np.frombuffer(x, np.uint8)[~gone])
        out[(i, len(x), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(rest).hexdigest())] += 1
    return out


def test_difference_cover():
    for r in (1, 2, 3):
        v, residues = suffixes.difference_cover(r)
        assert {(a - b) % v for a in residues for b in residues} == set(range(v)) and len(residues) == 6 * r + 4


@pytest.mark.parametrize("bucket, cover, length", [(16384, "content", 60), (2, "content", 60), (16384, "difference", 100)])
def test_repeats(spark, bucket, cover, length, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 150)  # longer texts are sampled in pieces
    rng = random.Random(8)
    part = [text(rng, 12) for _ in range(6)]
    rows = [(k, " ".join(rng.choice([*part, text(rng, 5)]) for _ in range(rng.randrange(1, 9)))) for k in range(60)]
    rows += [(70, "ab" * 200), (71, "ab" * 30 + "c" + "ab" * 90), (72, None), (73, ""), (None, part[0] + part[1]), (74, rows[0][1]), (75, rows[0][1]), (75, rows[0][1]), (76, "z" * 59), (77, "ü" * 50)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(4)
    got = suffixes.cut_repeats(table, length=length, gram=16, block_rows=20, bucket_rows=bucket, cover=cover, kept=True)
    assert Counter(tuple(r)[:5] for r in got.collect()) == plain_cut(rows, length)
    assert suffixes.cut_repeats(table.limit(0)).count() == 0


def plain_passages(rows, words):
    """How many words of each row stand in runs of `words` words that another row has."""
    ts = [(i, re.findall(rb"[0-9a-z\x80-\xff]+", bytes(t or "", "utf-8").lower())) for i, t in rows]
    found = defaultdict(set)
    for k, (_, w) in enumerate(ts):
        for j in range(len(w) - words + 1):
            found[tuple(w[j : j + words])].add(k)
    out = Counter()
    for i, w in ts:
        hit = np.zeros(len(w), bool)
        for j in range(len(w) - words + 1):
            if len(found[tuple(w[j : j + words])]) > 1:
                hit[j : j + words] = True
        out[(i, int(hit.sum()))] += 1
    return out


@pytest.mark.parametrize("piece", [40, 1 << 19])
def test_passages(spark, piece, monkeypatch):
    """Ends of passages, copies, a passage twice in one text only, other case and
    punctuation, repeated ids, null, empty and long texts."""
    monkeypatch.setattr(suffixes, "PIECE", piece)
    rng = random.Random(9)
    new = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    part = [new(n) for n in (11, 12, 13, 20, 60, 200)]
    rows = [(k, " ".join(rng.choice([*part, new(4), new(15)]) for _ in range(rng.randrange(1, 6)))) for k in range(50)]
    own = new(30)
    rows += [(60, f"{own} x {own}"), (61, f"{own} x {new(3)} {own}".replace(own[:40], "y")), (62, (new(9) + " " + part[2]).upper().replace(" ", " -- ")), (63, None), (64, ""), (None, part[3])]
    rows += [(65, part[0]), (66, new(40)), (67, rows[0][1]), (67, rows[0][1]), (68, "a " * 300), (69, "ü " * 90 + part[5]), (70, new(12)), (70, part[4])]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string").repartition(4)
    got = suffixes.cut_repeats(table, length=5000, passage=12)
    assert Counter((r.doc_id, r.n_passage_words) for r in got.collect()) == plain_passages(rows, 12)
    assert suffixes.cut_repeats(table.limit(0), passage=12).count() == 0


# ------------------------------------------------------------ toxicity and quality


def test_machine_learns_pairs():
    """Two terms together are toxic, each alone is not: only a product shows it."""
    rng = np.random.default_rng(3)
    names = np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in (b"insult", b"group", b"filler")], np.uint64))
    x = rng.integers(0, 2, (3000, 3)).astype(bool)
    i, g = (int(np.flatnonzero(names == xxhash.xxh3_64_intdigest(w))[0]) for w in (b"insult", b"group"))
    y = (x[:, i] & x[:, g]).astype(float)
    m = toxicity.fit([names[r] for r in x], y, steps=600)
    s = [m.score(np.sort(np.array(k, np.uint64))) for k in ([], [names[i]], [names[g]], [names[i], names[g]])]
    assert max(s[:3]) < 0.1 and s[3] > 0.9


def test_toxicity_on_small_tables(spark, docs, empty):
    labels = spark.createDataFrame([(i, int(i % 2), None) for i in range(40)] + [(None, 1, 1), (500, None, 1)], "doc_id long, toxic int, quality int")
    none = labels.limit(0)
    got = toxicity.score(docs.drop("score"), toxicity.learn(docs, none)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == docs.count()
    model = toxicity.learn(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs.drop("score"), model).collect())
    kept = toxicity.filter_toxic(docs, model, threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.filter_toxic(empty, model).count() == 0


def test_toxicity_found(spark):
    rng = random.Random(6)
    rows = [(i, text(rng, 80) + (" vile scoundrel" if i % 9 == 0 else "") + text(rng, 20)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 9 == 0)) for i in range(900)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.learn(docs, labels)).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all((r.score >= 0.3) == (r.doc_id % 9 == 0) for r in held) and len(held) > 100


def test_labellers_are_estimated():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    right = np.linspace(0.6, 0.95, len(quality.LABELLERS))
    v = np.where(rng.random((len(truth), len(right))) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    v[rng.random(v.shape) < 0.3] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    m = quality.estimate(patterns, counts)
    assert abs(m.prior - 0.8) < 0.03 and np.abs(m.good - right).max() < 0.05
    assert ((m.posterior(v) > 0.5) == truth).mean() > 0.95


def test_quality_keeps_and_drops(spark, docs, empty):
    rng = random.Random(7)
    good = [(i, " ".join(rng.choice(["the", "of", "and", "to", *(w + str(rng.randrange(50)) for w in WORDS[:12])]) for _ in range(90)) + ".") for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS).upper() + "!!" for _ in range(90))) for i in range(40)] + [(2000 + i, "spam, " * 200) for i in range(20)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(table, *quality.learn(table)).collect()}
    assert all(got[i] >= 0.5 for i, _ in good) and all(got[i] < 0.5 for i, _ in bad)
    assert quality.score(docs, *quality.learn(docs)).count() == docs.count()
    assert quality.score(empty, *quality.learn(empty)).count() == 0


# ------------------------------------------------------------ WARC


def test_warc_round_trip(spark):
    big, rng = "<p>" + "é" * 700, random.Random(3)
    rows = [(i, f"http://x.example/{i}?a b", "<html>" + text(rng, 300)) for i in range(30)]
    rows += [(40, "u", big), (41, None, big), (45, "http://x/\r\nWARC-Type: no", big), (42, "s", "short"), (43, "s", "short"), (44, "n", None), (46, "e", ""), (None, "z", big), (47, "r", big), (47, "r", big), (48, "crlf", "a\r\n\r\nWARC/1.1\r\n" * 90)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, kind string").repartition(3)
    path = scratch_path(spark, "test-warc")
    manifest = warc.write(pages, path, roll_bytes=2000, shard_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read(spark, path).collect()
    want = Counter()
    for p, _, h in rows:
        raw = (h or "").encode()
        want[(p, len(raw), hashlib.sha1(raw).hexdigest())] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == want
    copies = sorted((str(r.page_id), r.record_type, r.refers_to) for r in got if r.payload_bytes == len(big.encode()))
    assert copies == sorted([("40", "revisit", 47), ("41", "revisit", 47), ("45", "revisit", 47), ("None", "revisit", 47), ("47", "response", None), ("47", "revisit", 47)])
    assert all(r.record_type == "response" for r in got if r.payload_bytes < 1000)
    again = scratch_path(spark, "test-warc")
    other = warc.write(pages.repartition(5), again, roll_bytes=2000, shard_bytes=20_000)
    assert bag(manifest.select("records", "bytes", "sha256").distinct()) and sum(r.records for r in other.collect()) == len(rows)
    nothing = scratch_path(spark, "test-warc")
    warc.write(pages.limit(0), nothing)
    assert warc.read(spark, nothing).count() == 0


# ------------------------------------------------------------ removal of rows


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    none = sc._jvm.java.util.ArrayList
    stages = sc._jsc.sc().statusStore().stageList(none(), False, False, sc._gateway.new_array(sc._jvm.double, 0), none())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_removal_shuffles_only_what_may_go(spark):
    """The texts of rows that stay are not shuffled to find the few that go."""
    from cladeloom.llm import common

    rng = random.Random(8)
    docs = common.materialise(spark.createDataFrame([(i, rng.randbytes(2000).hex()) for i in range(2000)], "doc_id long, text string").repartition(4), "test-docs")
    verdict = docs.select(F.col("doc_id").alias("id"), common.text_tag(F.col("text")).alias("tag"), (F.col("doc_id") % 100 != 7).cast("long").alias("stay"), F.lit(1).cast("long").alias("rows"))
    verdict = common.materialise(verdict, "test-verdict")
    least = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to be broadcast
    try:
        before = shuffled_bytes(spark)
        left = [r.doc_id for r in common.keep_rows(docs, verdict).collect()]
        moved = shuffled_bytes(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", least)
    assert sorted(left) == [i for i in range(2000) if i % 100 != 7]
    assert moved < 1_000_000, moved  # the texts have 8 MB


@pytest.mark.parametrize("bits", [64, 1 << 26])
def test_removal_under_any_filter(spark, docs, rows, bits, monkeypatch):
    """A filter that is full lets every row pass and changes nothing."""
    from cladeloom.llm import common

    monkeypatch.setattr(common, "FILTER_BITS", bits)
    held = Counter((i, t or "") for i, t in rows)
    for every in (1, 2, 3):  # all texts, every second, every third go but for one row, or wholly
        go = {key: n % 2 for n, key in enumerate(sorted(held, key=str)) if not n % every}
        verdict = spark.createDataFrame([(i, hashlib.sha256(t.encode()).digest(), go.get((i, t), held[i, t]), held[i, t]) for i, t in held], "id long, tag binary, stay long, rows long")
        got = Counter((r.doc_id, r.text or "") for r in common.keep_rows(docs, verdict).collect())
        assert got == Counter({key: n for key in held if (n := min(held[key], go.get(key, held[key])))})


# ------------------------------------------------------------ very long texts


@pytest.mark.parametrize("limit", [1, 40, 300])
def test_pieces_change_nothing(rows, limit, monkeypatch):
    """Texts split in many pieces give what whole texts give."""
    from cladeloom.llm import common

    texts = [(t or "").encode() for _, t in rows] + [b"", b"  ", b"one", "Ü ß x\ny ".encode() * 40, b"x" * 900 + b" " + b"y" * 900, b"a a\na a\n" * 60]
    machine = decontam.automaton(decontam.windows([(1, "One two three, four five SIX seven eight nine."), (2, "tau"), (3, "über"), (4, " ".join(texts[3].decode().split()[4:30]))]))

    def all_of(t, limit):
        return (
            simhash.fingerprint(t), simhash.grams(t).tolist(), quality.measures(t), toxicity.terms(t).tolist(), decontam.scan_text(t, machine, limit=limit),
            [x for c in lmscore.chunks([t], 3, 10**9) for _, lead, part in c for x in part[lead:]],
        )

    want = [all_of(t, 1 << 30) for t in texts]
    monkeypatch.setattr(common.pieces, "__defaults__", (limit,))
    assert all(b"".join(common.pieces(t)) == t for t in texts)
    assert [all_of(t, limit) for t in texts] == want


def test_memory_of_a_long_text():
    """The words of a text of 30 MB are never all held."""
    import tracemalloc

    t = b" ".join(b"word%d" % (i % 9000) for i in range(3_200_000))
    tracemalloc.start()
    simhash.fingerprint(t), quality.measures(t), toxicity.terms(t), decontam.scan_text(t, None)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6, peak  # a list of the words alone has 170 MB, its five shifted copies as much again
