"""Removal of long repeated byte strings by blockwise suffix sorting.

A byte goes if a string of `length` bytes that covers it starts at any other
place too. Sorting every suffix of the corpus is not needed for that: suffixes
are compared to a depth of `length` only, and only those near a repeated
anchor can have an equal partner.

1. Cover sample. Difference-cover construction compares two suffixes through
   a sampled place at the same distance in both. `cover="difference"` samples
   by place: the residues of a difference cover modulo v, in which any two
   windows have a common distance below v. By default the cover follows the
   content: the sampled place of a window is the leftmost least hash of its
   `gram`-byte strings (its anchor), so equal windows sample equal places, at
   two places in `length - gram + 2` instead of the arithmetic cover's one in
   seven. The windows of one sampled place form a run.
2. Ranks. Runs whose anchor string is found once cannot repeat. Runs whose
   whole stretch of text (first byte of the first window to last of the last)
   is found twice repeat throughout. Both follow from counts of digests.
3. Blocks. What is left, about the ends of repeated passages, goes to suffix
   buckets by anchor. A task takes one block of buckets at a time, sorts the
   stretches once by what follows the anchor and once by what precedes it,
   and resolves the suffixes that start x bytes before the anchor from the
   two orders' ranks: equal head of x bytes, equal tail of length - x bytes.
   A bucket with more stretches than a block may hold is not gathered; its
   windows are counted by digest instead, which splits it by content.

`passages` does the same for words: which words stand in a run of `words`
words that another text has too, or a copy of the text. Anchors are the least
hashes of PASSAGE_GRAM-word strings; runs of windows whose stretch of words is
found in several texts are settled by counts, and only the windows of the other
stretches of such anchors are compared one by one, by digest. Words are those
of [0-9A-Za-z] and bytes from 0x80, A-Z lower-cased; hashes have 64 bits
(a stretch: 128 with its anchor's), texts are told apart by 64 bits.

Long texts are cut into overlapping pieces for the sample. A stretch is known
by 192 bits (a 128-bit digest and the hash of its anchor), a text by 128 bits
of its SHA-256; windows inside a bucket are compared byte by byte.

Defined cases: null text is empty; texts shorter than `length` bytes keep
everything; copies of a text repeat each other; strings may overlap
themselves; matches never cross texts; an empty table gives an empty result.
A passage that stands twice in one text only is no shared passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, fresh, join_hot, materialise, maybe_among, named_id, pieces, released, slices

LENGTH = 400
GRAM = 96
BLOCK_ROWS = 4096
BUCKET_ROWS = 16384
PASSAGE = 51  # words
PASSAGE_GRAM = 12
PIECE = 1 << 19  # windows of a text sampled at once
_PLACE = 20  # bits of a place in what is sampled at once
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(11).integers(1, 1 << 64, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.cumprod(have)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every gram-byte string of data."""
    n = len(data)
    h = np.empty(n + 1, np.uint64)
    h[0] = 0
    np.cumsum(_TABLE[data] * _power(_BASE, n), out=h[1:])
    return _mixed((h[gram:] - h[: n - gram + 1]) * _power(_INV, n - gram + 1))


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours, from block-wise running minima."""
    n = len(keys)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(keys.dtype).max, keys.dtype)
    padded[:n] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def difference_cover(r: int = 1) -> tuple[int, list[int]]:
    """A modulus v = 24 r^2 + 36 r + 13 and 6 r + 4 residues whose differences
    are all residues modulo v (Colbourn and Ling, 2000)."""
    steps = [1] * r + [r + 1] + [2 * r + 1] * r + [4 * r + 3] * (2 * r + 1) + [2 * r + 2] * (r + 1) + [1] * r
    return 24 * r * r + 36 * r + 13, [0, *np.cumsum(steps).tolist()]


def anchored(h: np.ndarray, n: int, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows of the pieces that end at `ends` among n places (fewer
    than 2^20), h the hash of every gram: piece number, first and last window,
    anchor (all places among the n), anchor's hash. Hashes are compared by
    their high 44 bits, then by place, so that the choice in a window depends
    on its content alone."""
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    low = np.uint64((1 << _PLACE) - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    least = window_minima(keys, length - gram + 1)
    at = (least & low).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    lasts = ends - length
    fits = lasts >= starts
    valid = np.zeros(len(at) + 1, np.int32)
    np.add.at(valid, starts[fits], 1)
    np.add.at(valid, lasts[fits] + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new = np.empty(len(at), bool)
    new[0] = True
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[starts[fits]] = True
    first = np.flatnonzero(new & inside)
    if not len(first):
        return none, none, none, none, np.zeros(0, np.uint64)
    text = np.searchsorted(ends, first, side="right")
    following = np.concatenate((first[1:], [np.iinfo(np.int64).max]))
    last = np.minimum(following - 1, lasts[text])
    anchor = at[first]
    return text, first, last, anchor, h[anchor]


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The runs of the windows of `length` bytes of the pieces of data."""
    return anchored(gram_hashes(data, gram) if len(data) >= length else np.zeros(0, np.uint64), len(data), ends, length, gram)


def cover_runs(data: np.ndarray, ends: np.ndarray, length: int, r: int = 1) -> tuple[np.ndarray, ...]:
    """The same for the places of a difference cover, counted from each
    piece's start; the hash is that of the string that all windows of a run
    have in common. Windows lie in several runs."""
    v, residues = difference_cover(r)
    gram = length - v + 1
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)
    place = np.arange(len(data)) - starts[text]
    anchor = np.flatnonzero(np.isin(place % v, residues) & (np.arange(len(data)) + gram <= ends[text]))
    text = text[anchor]
    first, last = np.maximum(anchor - v + 1, starts[text]), np.minimum(anchor, ends[text] - length)
    ok = first <= last
    text, first, last, anchor = text[ok], first[ok], last[ok], anchor[ok]
    return text, first, last, anchor, gram_hashes(data, gram)[anchor] if len(anchor) else np.zeros(0, np.uint64)


_RUN = "key binary, hash long, head int, tail int, stretch binary, first long"


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, place in the text, bytes) of about PIECE bytes;
    neighbouring pieces of a text share length - 1 bytes, so no window is lost."""
    held, size = [], 0
    for i, x in enumerate(texts):
        for at in range(0, len(x) - length + 1, PIECE):
            held.append((i, at, x[at : at + PIECE + length - 1]))
            size += len(held[-1][2])
            if size >= PIECE // 2:
                yield held
                held, size = [], 0
    if held:
        yield held


def _runs_of(text_col: str, length: int, gram: int, cover: str = "content"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 18):
            raw = [x for x in as_bytes(batch.column(text_col)).to_pylist() if len(x) >= length]
            keys = [hashlib.sha256(x).digest()[:16] for x in raw]
            for part in _pieces(raw, length):
                data = b"".join(x for _, _, x in part)
                ends = np.cumsum([len(x) for _, _, x in part])
                view = np.frombuffer(data, np.uint8)
                text, first, last, anchor, h = cover_runs(view, ends, length) if cover == "difference" else runs(view, ends, length, gram)
                bytes_ = memoryview(data)
                digests = [hashlib.blake2b(bytes_[a:b], digest_size=16).digest() for a, b in zip(first.tolist(), (last + length).tolist())]
                shift = np.array([at for _, at, _ in part]) - np.concatenate(([0], ends[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i, _, _ in part], pa.binary()).take(pa.array(text)), pa.array(h.view(np.int64)),
                        pa.array((anchor - first).astype(np.int32)), pa.array((anchor - last).astype(np.int32)),
                        pa.array(digests, pa.binary()), pa.array(first + shift[text]),
                    ],
                    names=["key", "hash", "head", "tail", "stretch", "first"],
                )

    return run


def packed_texts(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """id, key and compressed bytes of the texts that are long enough: what is
    shuffled when texts have to meet their spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "text", 4 << 20):
            raw = as_bytes(batch.column("text")).to_pylist()
            keep = [i for i, x in enumerate(raw) if len(x) >= length]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(keep, pa.int64())), pa.array([hashlib.sha256(raw[i]).digest()[:16] for i in keep], pa.binary()), pa.array([z.compress(raw[i]) for i in keep], pa.binary())],
                names=["id", "key", "packed"],
            )

    return rows.mapInArrow(run, rows.selectExpr("id", "binary('') as key", "binary('') as packed").schema)


def _unpack(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def _stretches(length: int):
    """Runs with their bytes: the text from the first window's start to the last one's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, hashes, head, tail, first, data = [], [], [], [], [], []
            for k, packed, wanted in zip(batch.column("key").to_pylist(), batch.column("packed"), batch.column("wanted").to_pylist()):
                text = _unpack(packed.as_py())
                for w in wanted:
                    key.append(k)
                    hashes.append(w["hash"])
                    head.append(w["head"])
                    tail.append(w["tail"])
                    first.append(w["first"])
                    data.append(text[w["first"] : w["first"] + w["head"] - w["tail"] + length])
                if len(data) >= 2000:
                    yield _stretch_batch(key, hashes, head, tail, first, data)
                    key, hashes, head, tail, first, data = [], [], [], [], [], []
            if data:
                yield _stretch_batch(key, hashes, head, tail, first, data)

    return run


def _stretch_batch(key, hashes, head, tail, first, data) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.binary()), pa.array(hashes, pa.int64()), pa.array(head, pa.int32()), pa.array(tail, pa.int32()), pa.array(data, pa.binary()), pa.array(first, pa.int64())],
        names=["key", "hash", "head", "tail", "stretch", "first"],
    )


def _ranked(bucket: list[int], parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of (bucket, bytes) and, for each place in it, the number of bytes
    shared with the place before (-1: another bucket)."""
    order = sorted(range(len(parts)), key=lambda i: (bucket[i], parts[i]))
    grid = np.zeros((len(parts), width + 1), np.uint8)
    for row, i in enumerate(order):
        grid[row, : len(parts[i])] = np.frombuffer(parts[i], np.uint8)
    sizes = np.array([len(parts[i]) for i in order])
    differ = grid[1:] != grid[:-1]
    differ[:, width] = True
    shared = np.minimum(np.minimum(differ.argmax(axis=1), sizes[1:]), sizes[:-1])
    own = np.array([bucket[i] for i in order])
    return np.array(order), np.concatenate(([-1], np.where(own[1:] == own[:-1], shared, -1)))


def repeated_windows(bucket: list[int], head: np.ndarray, tail: np.ndarray, stretch: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For one block: which windows are found again in their bucket, as (row,
    first, last) with places counted from the stretch's start."""
    n = len(bucket)
    right, right_lcp = _ranked(bucket, [s[h:] for s, h in zip(stretch, head.tolist())], length)
    left, left_lcp = _ranked(bucket, [s[:h][::-1] for s, h in zip(stretch, head.tolist())], int(head.max()))
    top = int(head.max())
    hit = np.zeros((n, top + 2), bool)
    name_r, name_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for x in range(int(tail.min()), top + 1):
        rows = np.flatnonzero((tail <= x) & (x <= head))
        if len(rows) < 2:
            continue
        name_r[right] = np.cumsum(right_lcp < length - x)
        name_l[left] = np.cumsum(left_lcp < x)
        pair = name_r[rows] * (n + 1) + name_l[rows]
        _, where, count = np.unique(pair, return_inverse=True, return_counts=True)
        again = rows[count[where] > 1]
        hit[again, head[again] - x] = True  # by the place of the window's start
    edge = np.diff(np.concatenate((np.zeros((n, 1), np.int8), hit.view(np.int8)), axis=1), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return row, first, stop - 1


def _blocks(length: int, block_rows: int):
    """Buckets in order of their hash, a block of whole buckets at a time."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        seen = {(r[0], r[5]): r for r in rows}
        rows = list(seen.values())
        head, tail = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
        row, first, last = repeated_windows([r[1] for r in rows], head, tail, [r[4] for r in rows], length) if len(rows) > 1 else ([], [], [])
        base = np.array([r[5] for r in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][0] for i in row], pa.binary()), pa.array(base[row] + first if len(row) else [], pa.int64()), pa.array(base[row] + last if len(row) else [], pa.int64())],
            names=["key", "first", "last"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "hash", "head", "tail", "stretch", "first"))):
                if len(held) >= block_rows and r[1] != held[-1][1]:
                    yield solve(held)
                    held = []
                held.append(r)
        if held:
            yield solve(held)

    return run


def _window_digests(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data, first in zip(batch.column("key").to_pylist(), batch.column("stretch").to_pylist(), batch.column("first").to_pylist()):
                n = len(data) - length + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * n, pa.binary()), pa.array([hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in range(n)], pa.binary()), pa.array(range(first, first + n), pa.int64())],
                    names=["key", "digest", "first"],
                )

    return run


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_rows: int = BLOCK_ROWS, bucket_rows: int = BUCKET_ROWS, cover: str = "content") -> tuple[DataFrame, DataFrame]:
    """rows: id, key, sha256, n_bytes, copies of each row of docs; spans: for
    the key of each text that is there once, first and last repeated windows."""
    rows = materialise(
        docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("t")).select(
            "id", F.sha2(F.encode("t", "UTF-8"), 256).alias("sha256"), F.octet_length("t").cast("long").alias("n_bytes")
        ).withColumn("key", F.unhex(F.substring("sha256", 1, 32))),
        "texts",
    )
    texts = rows.filter(F.col("n_bytes") >= length).groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("pick"))
    every = materialise(docs.select(F.col(text_col)).mapInArrow(_runs_of(text_col, length, gram, cover), _RUN), "runs")

    same = ["hash", "head", "tail", "stretch"]
    total = every.count()
    groups = every.groupBy(*same).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first")).alias("one"))
    groups = materialise(groups, "groups")
    buckets = groups.groupBy("hash").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    open_ = materialise(join_hot(groups, buckets, ["hash"], "m", groups.count()).select("hash", "head", "tail", "m", F.col("one.key").alias("key"), F.col("one.first").alias("first")), "open")
    several = materialise(groups.filter("n > 1").select(*same, "n"), "several")
    whole = join_hot(every, several, same, "n", total).groupBy("key", "first").agg(F.max(F.col("first") + F.col("head") - F.col("tail")).alias("last"))

    wanted = open_.groupBy("key").agg(F.collect_list(F.struct("hash", "head", "tail", "first")).alias("wanted")).join(texts, "key").select("key", F.col("pick").alias("id"), "wanted")
    packed = packed_texts(docs, id_col, text_col, length)
    met = packed.join(wanted, (packed.key == wanted.key) & packed.id.eqNullSafe(wanted.id)).select(packed.key, "packed", "wanted")
    large = materialise(open_.filter(F.col("m") > bucket_rows).select("hash").distinct(), "large")
    cut = materialise(met.mapInArrow(_stretches(length), _RUN), "stretches")
    small = cut if large.isEmpty() else cut.join(large, "hash", "left_anti").select(*cut.columns)
    dealt = small.repartition("hash").sortWithinPartitions("hash")
    found = whole.unionByName(dealt.mapInArrow(_blocks(length, block_rows), "key binary, first long, last long"))
    if not large.isEmpty():
        split = cut.join(large, "hash", "left_semi").select(*cut.columns).dropDuplicates(["key", "first"])
        windows = split.mapInArrow(_window_digests(length), "key binary, digest binary, first long")
        windows = materialise(windows, "windows")
        twice = windows.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        found = found.unionByName(join_hot(windows, twice, ["digest"], "n", windows.count()).select("key", "first", F.col("first").alias("last")))
    spans = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    once = texts.filter("copies = 1").select("key", F.col("pick").alias("id"))
    counted = join_hot(rows.filter(F.col("n_bytes") >= length), texts.select("key", "copies"), ["key"], "copies", rows.count())
    short = rows.filter(F.col("n_bytes") < length).withColumn("copies", F.lit(1).cast("long"))
    out = materialise(counted.unionByName(short), "counted"), materialise(spans.join(once, "key"), "spans")
    for done in (every, groups, open_, several, cut, large):
        discard(done)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def _sums(values: np.ndarray) -> np.ndarray:
    h = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(_BASE, len(values)), out=h[1:])
    return h


def _between(sums: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of what stands from first to stop, wherever that is."""
    return _mixed((sums[stop] - sums[first]) * _power(_INV, len(sums))[first])


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of the texts, one text after the other, and
    the number of words up to the end of each text."""
    found, at, base = [], [], 0
    for part in pieces(b"\n".join(texts), PIECE):
        data = _LOWER[np.frombuffer(part, np.uint8)]
        edge = np.flatnonzero(np.diff(_IN_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        found.append(_between(_sums(_TABLE[data]), edge[::2], edge[1::2]))
        at.append(edge[::2] + base)
        base += len(part)
    return np.concatenate(found), np.searchsorted(np.concatenate(at), np.cumsum([len(x) + 1 for x in texts]))


_PASSAGE_RUN = "key binary, text long, hash long, stretch long, first long, last long"


def _passage_runs(text_col: str, words: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 1 << 18):
            raw = [x for x in as_bytes(batch.column(text_col)).to_pylist() if len(x) >= 2 * words - 1]
            if not raw:
                continue
            keys = [hashlib.sha256(x).digest()[:16] for x in raw]
            short = np.frombuffer(b"".join(k[:8] for k in keys), "<i8")
            hashes, ends = word_hashes(raw)
            starts = np.concatenate(([0], ends[:-1]))
            for at in range(0, len(hashes), PIECE):  # neighbours share words - 1 words
                sums = _sums(hashes[at : at + PIECE + words - 1])
                n = len(sums) - 1
                places = np.arange(max(0, n - gram + 1))
                text, first, last, _, h = anchored(_between(sums, places, places + gram), n, np.clip(ends - at, 0, n), words, gram)
                stretch = _between(sums, first, last + words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.binary()).take(pa.array(text)), pa.array(short[text]), pa.array(h.view(np.int64)), pa.array(stretch.view(np.int64)),
                        pa.array(first + at - starts[text]), pa.array(last + at - starts[text]),
                    ],
                    names=["key", "text", "hash", "stretch", "first", "last"],
                )

    return run


def _passage_windows(words: int):
    """The windows of the wanted runs with a digest of their words."""

    def of(key: bytes, data: bytes, wanted: list[dict]) -> Iterator[pa.RecordBatch]:
        hashes, _ = word_hashes([data])
        first = np.unique(np.concatenate([np.arange(w["first"], w["last"] + 1) for w in wanted]))
        for at in range(0, len(hashes), PIECE):
            here = first[(first >= at) & (first < at + PIECE)]
            if len(here):
                digest = _between(_sums(hashes[at : at + PIECE + words - 1]), here - at, here - at + words)
                text = int.from_bytes(key[:8], "little", signed=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(here), pa.binary()), pa.array(np.full(len(here), text)), pa.array(digest.view(np.int64)), pa.array(here)],
                    names=["key", "text", "digest", "first"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for key, packed, wanted in zip(batch.column("key").to_pylist(), batch.column("packed"), batch.column("wanted").to_pylist()):
                for part in of(key, _unpack(packed.as_py()), wanted):
                    held.append(part)
                    rows += part.num_rows
                if rows >= 1 << 14:
                    yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                    held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def _covered(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(b - a for a, b in merged([(s["first"], s["last"]) for s in spans], words)) for spans in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64())], names=["key", "n"])

    return run


def passages(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = PASSAGE, gram: int = PASSAGE_GRAM) -> DataFrame:
    """key, copies, n: how many words of a text stand in a run of `words`
    words that is in another text or a copy; texts without such are left out.
    rows: id and key of each row of docs."""
    texts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("pick")), "passage_texts")
    every = materialise(docs.select(F.col(text_col)).mapInArrow(released(_passage_runs(text_col, words, gram)), _PASSAGE_RUN), "passage_runs")
    same, two = ["hash", "stretch"], F.col("a") < F.col("b")
    count, least, most = F.count(F.lit(1)), F.min("text").alias("a"), F.max("text").alias("b")
    groups = materialise(every.groupBy(*same).agg(count.alias("n"), least, most), "passage_groups")
    buckets = materialise(groups.groupBy("hash").agg(count.alias("m"), F.min("a").alias("a"), F.max("b").alias("b")).filter((F.col("m") > 1) & two).select("hash", "m"), "passage_buckets")
    told = join_hot(groups, buckets, ["hash"], "m", groups.count(), how="left").select(*same, "n", two.alias("settled"), F.col("m").isNotNull().alias("open"))
    needed = materialise(told.filter("settled or open"), "passage_needed")
    met = materialise(join_hot(every, needed, same, "n", every.count()).select("key", *same, "first", "last", "settled", "open"), "passage_met")

    settled = met.filter("settled").groupBy("key", "first").agg(F.max("last").alias("last"))
    alone = met.filter("open and not settled").groupBy("key", "first").agg(F.max("last").alias("last"))
    partner = met.filter("open and settled").groupBy(*same).agg(F.min(F.struct("key", "first", "last")).alias("one")).select("one.*")
    wanted = alone.unionByName(partner).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("wanted")).join(texts, "key").select("key", F.col("pick").alias("id"), "wanted")
    wanted = materialise(wanted, "passage_wanted")
    names = fresh([id_col, text_col], "__null", "__name")
    _, asked = maybe_among(docs.select(id_col, text_col), wanted.select(*named_id(F.col("id"), *names)), names, id_col)
    packed = packed_texts(asked, id_col, text_col, 2 * words - 1)
    found = packed.join(wanted, (packed.key == wanted.key) & packed.id.eqNullSafe(wanted.id)).select(packed.key, "packed", "wanted")
    windows = materialise(found.mapInArrow(released(_passage_windows(words)), "key binary, text long, digest long, first long"), "passage_windows")
    twice = materialise(windows.groupBy("digest").agg(count.alias("n"), least, most).filter(two).select("digest", "n"), "passage_twice")
    single = join_hot(windows, twice, ["digest"], "n", windows.count()).groupBy("key", "first").agg(F.max("first").alias("last"))
    copied = every.groupBy("key").agg(F.max("last").alias("last")).join(texts.filter("copies > 1"), "key").select("key", F.lit(0).cast("long").alias("first"), "last")
    spans = settled.unionByName(single).unionByName(copied).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    out = materialise(spans.mapInArrow(_covered(words), "key binary, n long").join(texts.select("key", "copies"), "key"), "passage_words")
    for done in (every, groups, buckets, needed, met, wanted, windows, twice):
        discard(done)
    return out


def merged(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of the bytes under windows (first, last)."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(windows):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last + length))
        else:
            out.append((first, last + length))
    return out


def _cut(length: int, kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist()):
                text = memoryview(_unpack(packed.as_py()))
                gone = merged([(s["first"], s["last"]) for s in spans], length)
                edges = [0, *(x for g in gone for x in g), len(text)]
                parts = [text[a:b] for a, b in zip(edges[::2], edges[1::2])]
                sha = hashlib.sha256()
                for p in parts:
                    sha.update(p)
                out.append((sum(b - a for a, b in gone), len(gone), sha.hexdigest(), b"".join(parts) if kept else None))
            n, k, sha, rest = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array(rest, pa.binary())],
                names=["key", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, kept: bool = False, passage: int = 0, **options) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256
    and, if asked for, the kept bytes (null: nothing was removed) and, with
    passage > 0, n_passage_words, the words in runs of `passage` words that
    another row has too (a report; it removes nothing)."""
    rows, spans = repeated(docs, id_col, text_col, length, gram, **options)
    packed = packed_texts(docs, id_col, text_col, length)
    met = packed.join(spans, (packed.key == spans.key) & packed.id.eqNullSafe(spans.id)).select(packed.key, "packed", "spans")
    done = materialise(met.mapInArrow(_cut(length, kept), "key binary, n_removed long, n_spans long, kept_sha256 string, kept binary"), "cut")
    more = ["n_passage_words"] if passage else []
    if passage:
        of = passages(docs, rows, id_col, text_col, passage).withColumnRenamed("copies", "same")
        rows = join_hot(rows, of, ["key"], "same", rows.count(), how="left").withColumn("n_passage_words", F.coalesce("n", F.lit(0)).cast("long")).drop("n", "same")
    copied, long = F.col("copies") > 1, F.col("n_bytes") >= length
    gone = hashlib.sha256(b"").hexdigest()
    settled = rows.filter(copied | ~long).select(
        F.col("id").alias(id_col), "n_bytes", F.when(copied, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(copied, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(copied, F.lit(gone)).otherwise(F.col("sha256")).alias("kept_sha256"), *([F.when(copied, F.lit(b"")).alias("kept")] if kept else []), *more,
    )
    others = rows.filter(~copied & long).join(done, "key", "left").select(  # texts that are there once
        F.col("id").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), *(["kept"] if kept else []), *more,
    )
    return settled.unionByName(others)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), passage=PASSAGE)
