"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints that differ in at most `radius` = r bits are linked. Every bit i
gets a vector m(i) of r + 1 bits; table v (each nonzero vector of r + 1 bits,
so 2^(r+1) - 1 tables) keeps the bits whose product with v is odd. For any r
bits some v has even products with all of them, so that table masks all of
them out: each pair within the radius meets in some table, with certainty.

Only distinct fingerprints enter the tables. A bucket of more than `split`
fingerprints is covered again over the bits that its table masks out; what is
left then differs in about 12 bits, so no second-level bucket can hold more
than some thousand distinct fingerprints, however many documents there are.
Inside a bucket links are found by breadth-first search with population
counts, and one edge to each component's least member is given, not all pairs.

Defined cases: null text counts as empty; no words give fingerprint zero,
linked like any other; texts of fewer words than a shingle are one shingle;
repeated rows share a component; a null id never names a component unless the
component has no other id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, join_hot, keep_rows, materialise, pieces, released, slices, text_tag
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
SPLIT = 512
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
TURNS = (range(1), range(1, 25))  # orders in which texts stand for their shingles, by round
CELLS = 20  # bits of the cells that shingles are counted in
_PART = 1 << 15
_EMIT = 1 << 18
_CHUNK = 1 << 14
_SPACE = 10_000  # table numbers of one space


def shingles(raw: bytes, size: int, hashed) -> Iterator[np.ndarray]:
    """Hashes of all of a text's word shingles (fewer words: the whole
    sequence), piece after piece of the text."""
    rest: list[bytes] = []
    found = False
    for piece in pieces(raw):
        w = rest + piece.lower().split()
        n = max(0, len(w) - size + 1)
        rest = w[n:]
        if n:
            found = True
            yield np.fromiter(map(hashed, map(b" ".join, zip(*(w[i:] for i in range(size))))), "<u8", n)
    if rest and not found:
        yield np.array([hashed(b" ".join(rest))], "<u8")


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash: a bit is set if over half the shingles' hashes have it."""
    import xxhash

    counts, n = np.zeros(64, np.int64), 0
    for hashes in shingles(raw, size, partial(xxhash.xxh64_intdigest, seed=SEED)):
        n += len(hashes)
        for first in range(0, len(hashes), _PART):
            h = hashes[first : first + _PART]
            counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def grams(raw: bytes, size: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Distinct hashes of a text's word shingles (no words: that of nothing)."""
    import xxhash

    found = [*shingles(raw, size, xxhash.xxh3_64_intdigest)] or [np.array([xxhash.xxh3_64_intdigest(b"")], np.uint64)]
    return np.unique(np.concatenate(found)).view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, tag: bool = False) -> DataFrame:
    """id and fp (the fingerprint as a signed long) for each row of docs; if
    asked for also the text's tag."""
    rows = docs.select(F.col(id_col), F.col(text_col), *([text_tag(F.col(text_col)).alias("tag")] if tag else []))
    carried = [id_col, *(["tag"] if tag else [])]
    schema = rows.select(*carried, F.lit(0).cast("long").alias("fp")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            raw = as_bytes(batch.column(text_col)).to_pylist()
            fp = np.array([fingerprint(x, size) for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), pa.array(fp.view(np.int64))], names=[*carried, "fp"])

    return rows.mapInArrow(released(run), schema)


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """For each nonzero v of radius + 1 bits, the kept ones of `bits` as a mask."""
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << b for i, b in enumerate(bits) if bin(v & (1 + i % vectors)).count("1") % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _free(mask: int) -> list[int]:
    return [b for b in range(64) if not mask >> b & 1]


def bucket_edges(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, least member) for each component of the fingerprints (signed,
    ascending, distinct) under the radius."""
    bits, left, out = fps.view(np.uint64), np.arange(len(fps)), []
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = np.array([root])
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(front), 64):
                near |= (np.bitwise_count(bits[front[i : i + 64], None] ^ bits[left][None, :]) <= radius).any(axis=0)
            front, left = left[near], left[~near]
            out += [(int(fps[m]), int(fps[root])) for m in front]
    return out


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], keys: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sorted rows as one array (a line for each name) that ends with a whole
    run of equal first `keys` names, and the places where new runs start."""
    rest = None
    for batch in batches:
        part = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names])
        rest = part if rest is None else np.concatenate((rest, part), axis=1)
        if not rest.shape[1]:
            continue
        cut = np.flatnonzero((np.diff(rest[:keys], axis=1) != 0).any(axis=0)) + 1
        if len(cut):
            yield rest[:, : cut[-1]], cut[:-1]
            rest = rest[:, cut[-1] :]
    if rest is not None and rest.shape[1]:
        yield rest, np.array([], np.int64)


def _edges_of(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cuts in _runs(batches, ("t", "key", "fp"), 2):
            yield _batch(rows, cuts, radius)

    return run


def _batch(rows: np.ndarray, cuts: np.ndarray, radius: int) -> pa.RecordBatch:
    starts = np.concatenate(([0], cuts))
    sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
    t, fp = rows[0], rows[2]
    two = starts[sizes == 2]
    two = two[np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius]
    more = [(int(t[s]), *e) for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()) for e in bucket_edges(fp[s : s + n], radius)]
    x = np.concatenate((np.stack((t[two], fp[two], fp[two + 1])), np.array(more, np.int64).reshape(-1, 3).T), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x[0] // _SPACE), pa.array(x[1]), pa.array(x[2])], names=["space", "a", "b"])


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Edges (space, a, b) that connect exactly what links within the radius
    connect. fps: distinct fingerprints (space, fp); those of different
    spaces never meet."""
    masks = covering_masks(list(range(64)), radius)
    table = fps.select("space", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("at", "key")).select(
        (F.col("space") * _SPACE + F.col("at")).alias("t"), "key", "fp"
    )
    sizes = table.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = table.join(sizes, ["t", "key"])
    deeper = None  # the second covering, over the bits that the row's table masks out
    for at, m in enumerate(masks):
        again = [
            F.struct((F.col("t") + 1000 + at * 100 + u).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m | extra))).alias("key"))
            for u, extra in enumerate(covering_masks(_free(m), radius))
        ]
        here = F.col("t") % _SPACE == at
        deeper = F.when(here, F.array(*again)) if deeper is None else deeper.when(here, F.array(*again))
    crowded = shared.filter(F.col("n") > split).select("fp", F.explode(deeper).alias("d")).select("d.t", "d.key", "fp")
    rows = shared.filter(F.col("n") <= split).select("t", "key", "fp").unionByName(crowded)
    dealt = rows.repartition("t", "key").sortWithinPartitions("t", "key", "fp")
    return dealt.mapInArrow(released(_edges_of(radius)), "space long, a long, b long").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, tag: bool = False) -> tuple[DataFrame, DataFrame, int]:
    """id and fp for each row; fp, n (rows), least (id) and root (one
    fingerprint that names the component) for each fingerprint; number of rows."""
    fps = materialise(fingerprints(docs, id_col, text_col, size, tag), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("least")), "distinct")
    roots = components(links(distinct.select(F.lit(0).cast("long").alias("space"), "fp"), radius).select("a", "b"))
    named = materialise(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "named")
    return fps, named, named.agg(F.sum("n")).first()[0] or 0


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """id, fp and component_id (the least id) for each row of docs."""
    fps, named, rows = classes(docs, id_col, text_col, size, radius)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    known = join_hot(named.select("fp", "n", "root"), least, ["root"], "m", named.count()).select("fp", "n", "component_id")
    return join_hot(fps, known, ["fp"], "n", rows).select(id_col, "fp", "component_id")


def _count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles of the task's texts fall into each cell, in chunks of packed counts."""
    total = np.zeros(1 << CELLS, np.int64)
    for batch in batches:
        total += np.bincount(_cell(batch.column("grams").flatten().to_numpy()), minlength=len(total))
    parts = [(i, x) for i, x in enumerate(total.reshape(-1, _CHUNK)) if x.any()]
    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int64()), pa.array([x.astype("<u4").tobytes() for _, x in parts], pa.binary())], names=["chunk", "counts"])


def _sum_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, x in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(x, "<u4").astype(np.int64)
    for i, x in total.items():
        at = np.flatnonzero(x)
        yield pa.RecordBatch.from_arrays([pa.array(at + i * _CHUNK), pa.array(x[at])], names=["cell", "n"])


def _cell(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - CELLS)).astype(np.int64)


def crowded_cells(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Cells (ascending) that hold clearly more shingles than chance puts there, and how many."""
    parts = sets.select("grams").mapInArrow(released(_count_cells), "chunk long, counts binary").repartition("chunk")
    cells = materialise(parts.mapInArrow(released(_sum_cells), "cell long, n long"), "cells")
    mean = (cells.agg(F.sum("n")).first()[0] or 0) / (1 << CELLS)
    got = cells.filter(F.col("n") > mean + 4 * mean**0.5 + 4).orderBy("cell").toArrow()
    return got.column("cell").to_numpy(), got.column("n").to_numpy()


def _prefixes(cells: np.ndarray, counts: np.ndarray, least: float):
    """The rows (t, no, n, room) of each text's first shingles in the order of
    (crowdedness of the cell, hash): n is the size of its set, room the number
    of shingles from this one on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(1 << CELLS, np.int64)
        weight[cells] = counts
        for batch in batches:
            out = []
            for no, held in zip(batch.column("no").to_pylist(), batch.column("grams")):
                g = held.values.to_numpy()
                first = g[np.lexsort((g, weight[_cell(g)]))[: int((1 - least) * len(g) + 1e-6) + 1]]
                out.append(np.stack((first, np.full(len(first), no), np.full(len(first), len(g)), len(g) - np.arange(len(first)))))
            if out:
                x = np.concatenate(out, axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2].astype(np.int32)), pa.array(x[3].astype(np.int32))], names=["t", "no", "n", "room"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the shingles that at least two texts have among their first,
    each text once."""
    for rows, _ in _runs(batches, ("t", "no", "n", "room"), 1):
        rows = rows[:, np.concatenate(([True], (np.diff(rows[:2], axis=1) != 0).any(axis=0)))]
        starts = np.flatnonzero(np.concatenate(([True], np.diff(rows[0]) != 0)))
        sizes = np.diff(np.concatenate((starts, [rows.shape[1]])))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows[:, np.repeat(sizes > 1, sizes)]], names=["t", "no", "n", "room"])


def _stars(turns: range, least: float):
    """Each text with the texts of its shingle that come first in the turns'
    orders, where their roots differ and they may reach `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _runs(batches, ("t", "no", "n", "room", "root"), 1):
            t, no, n, room, root = rows
            starts = np.flatnonzero(np.concatenate(([True], np.diff(t) != 0)))
            own = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(t))))
            for turn in turns:
                mixed = (no.view(np.uint64) ^ np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
                rep = np.lexsort((mixed ^ (mixed >> np.uint64(31)), t))[starts][own]
                ok = (root != root[rep]) & _enough(room, room[rep], n, n[rep], least)
                yield pa.RecordBatch.from_arrays([pa.array(no[rep][ok]), pa.array(no[ok])], names=["x", "y"])

    return run


def _enough(room, other_room, n, other_n, least: float):
    """Whether texts that share this shingle and none before it can reach `least`."""
    return (room >= least / (1 + least) * (n + other_n) - 1e-6) & (other_room >= least / (1 + least) * (n + other_n) - 1e-6)


def _pairs(least: float):
    """All pairs of texts of different roots that may meet in their first common shingle here."""

    def once(x: list[np.ndarray]) -> np.ndarray:
        both = np.concatenate(x, axis=1)
        both = both[:, np.lexsort(both)]
        return both[:, np.concatenate((np.ones(min(1, both.shape[1]), bool), (np.diff(both, axis=1) != 0).any(axis=0)))]

    def pack(both: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in _runs(batches, ("t", "no", "n", "room", "root"), 1):
            t, no, n, room, root = rows
            left, d, out, held = np.arange(len(t)), 0, [], 0
            while len(left):
                d += 1
                left = left[left + d < len(t)]
                left = left[t[left] == t[left + d]]
                far = left + d
                ok = (root[left] != root[far]) & _enough(room[left], room[far], n[left], n[far], least)
                out.append(np.stack((no[left[ok]], no[far[ok]])))
                held += out[-1].shape[1]
                if held > _EMIT:
                    yield pack(once(out))
                    out, held = [], 0
            if held:
                yield pack(once(out))

    return run


def sketch(hashes: np.ndarray) -> bytes:
    """For each of about three cells a shingle whether an odd number fell into
    it. Sketches of two sets differ in no more bits than the sets in shingles."""
    size = max(64, 1 << int(2 * len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (size - 1), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _close(least: float):
    """Only pairs whose sketches do not rule the similarity out."""

    def differ(x: bytes, y: bytes) -> int:
        u, v = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
        return int(np.bitwise_count(np.bitwise_xor.reduce(v.reshape(-1, len(u)), axis=0) ^ u).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([differ(x, y) for x, y in zip(batch.column("sx").to_pylist(), batch.column("sy").to_pylist())], np.int64)
            total = batch.column("nx").to_numpy().astype(np.int64) + batch.column("ny").to_numpy()
            ok = pa.array(bits <= (1 - least) / (1 + least) * total + 1e-6)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(ok) for c in "xyab"], names=list("xyab"))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the roots of those pairs (x, y) that reach `least`."""
    known = sets.select("no", "n", "sketch").dropDuplicates(["no"]).join(roots, "no")
    ends = pairs.join(known.toDF("x", "nx", "sx", "a"), "x").join(known.toDF("y", "ny", "sy", "b"), "y").filter("a <> b")
    open_ = materialise(ends.mapInArrow(released(_close(least)), "x long, y long, a long, b long"), "pairs")
    asked = open_.select(F.explode(F.array("x", "y")).alias("no")).distinct()
    held = sets.select("no", "grams").join(asked, "no", "left_semi").dropDuplicates(["no"])
    both = open_.join(held.toDF("x", "gx"), "x").join(held.toDF("y", "gy"), "y")
    shared = F.size(F.array_intersect("gx", "gy"))
    return materialise(both.filter(shared >= least * (F.size("gx") + F.size("gy") - shared)).select("a", "b").distinct(), "edges")


def similar(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, shingle: int = SIMILAR_SHINGLE, least: float = SIMILARITY) -> DataFrame:
    """Root and over (the root of all that it is connected with) for the
    roots of rows(id, tag, root) that change: connected is what pairs of texts
    of at least `least` Jaccard similarity of their shingle sets (and equal
    roots) connect.

    Prefix filter: in any one order of all shingles, two such texts share one
    of the first (1 - least) n + 1 of each, and from their first common one on
    both have room for the common shingles that the similarity needs. Shingles
    in crowded cells come last, so that common passages make few pairs. Each
    text is first compared with one text of each of its shingles, then with some
    others, which links large groups without all their pairs; then every pair
    that still has different roots is compared, so no failed comparison stands
    for another."""
    texts = materialise(rows.groupBy("tag").agg(F.min(id_col).alias("id"), F.first("root").alias("root")), "texts")
    salt, n_texts = 0, texts.count()
    while texts.select(F.xxhash64("tag", F.lit(salt))).distinct().count() < n_texts:
        salt += 1  # two texts of one number: number them anew
    number = F.xxhash64("tag", F.lit(salt)).alias("no")
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_tag(F.col(text_col)).alias("tag"))
    if rows.count() > n_texts:  # a repeated text is read once for each repetition of its least id
        held = held.join(texts.select(F.col("tag").alias("t"), F.col("id").alias("i")), F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            found = [grams(x, shingle) for x in as_bytes(batch.column("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("no"), pa.array(map(len, found), pa.int64()), pa.array([sketch(x) for x in found], pa.binary()), pa.array(found, pa.list_(pa.int64()))], names=["no", "n", "sketch", "grams"]
            )

    sets = materialise(held.select(number, "text").mapInArrow(released(run), "no long, n long, sketch binary, grams array<long>"), "grams")
    prefixes = sets.select("no", "grams").mapInArrow(released(_prefixes(*crowded_cells(sets), least)), "t long, no long, n int, room int")
    met = materialise(prefixes.repartition("t").sortWithinPartitions("t", "no").mapInArrow(released(_shared), "t long, no long, n long, room long"), "shared")
    now = materialise(texts.select(number, "root", F.col("root").alias("over")), "roots")
    for turns in (*TURNS, None):
        known = now.select("no", F.col("over").alias("root"))
        dealt = met.join(known, "no").repartition("t").sortWithinPartitions("t", "no")
        pairs = dealt.mapInArrow(released(_stars(turns, least) if turns else _pairs(least)), "x long, y long").distinct()
        near = _verified(pairs, sets, known, least)
        more = components(near, "stars").select(F.col("node").alias("over"), F.col("root").alias("further"))
        sizes = now.groupBy("over").agg(F.count(F.lit(1)).alias("n"))
        before, now = now, materialise(join_hot(now, more.join(sizes, "over"), ["over"], "n", n_texts, how="left").select("no", "root", F.coalesce("further", "over").alias("over")), "roots")
        discard(before)
        discard(near)
    changed = materialise(now.filter("root <> over").select("root", "over").distinct(), "changed")
    for table in (sets, met, texts, now):
        discard(table)
    return changed


def near_deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: int = 1, **options) -> DataFrame:
    """docs with one row of each group: that of the smallest id (null ids come
    last), and of rows that repeat it the first by text digest. A group is
    connected by fingerprints within the radius, or (unless seeds = 0) by texts
    of 0.8 similarity of five-word shingles."""
    fps, named, n_rows = classes(docs, id_col, text_col, tag=True, **options)
    rows = materialise(join_hot(fps, named.select("fp", "n", "root"), ["fp"], "n", n_rows).select(id_col, "tag", "root"), "classes")
    if seeds:
        more = similar(docs, rows, id_col, text_col)
        sizes = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        rows = join_hot(rows, more.join(sizes, "root"), ["root"], "n", n_rows, how="left").select(id_col, "tag", F.coalesce("over", "root").alias("root"))
    rank = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "tag")
    best = rows.groupBy("root").agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"))
    once = rows.groupBy("root", F.col(id_col).alias("id"), "tag").agg(F.count(F.lit(1)).alias("rows"))
    verdict = join_hot(once, best, ["root"], "n", n_rows).select(
        "id", "tag", "rows", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("tag") == F.col("best.tag"))).cast("long").alias("stay")
    )
    return keep_rows(docs, materialise(verdict, "near"), id_col, text_col)


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assign(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
