"""Benchmark decontamination with one Aho-Corasick automaton.

The automaton holds every window of eight consecutive item words (an item of
fewer words is one window) framed by single spaces. Each text is lower-cased
(A-Z), its words joined by single spaces, and scanned once; the places of the
hits are mapped back to words and to byte offsets of the original text.

The items are a stated query set, not the corpus. Their automaton is shipped
to the tasks in blocks of at most `block_bytes` of item text: a larger set is
scanned block after block in the same pass over the documents, each block
adding to the spans that the row carries, so no automaton outgrows a worker.

Defined cases: null text has no words; a text or item without words hits
nothing; items with a null id are ignored; rows with one item_id are one item;
repeated documents are judged each by itself; an empty table on either side
gives rows without hits or no rows; further columns pass through `decontaminate`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, fresh, released, slices

WINDOW = 8
MIN_ITEMS = 2
BLOCK_BYTES = 1 << 19

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def windows(items: list[tuple[str, str | None]], size: int = WINDOW) -> dict[str, tuple[int, list[str]]]:
    """Framed window (bytes read as Latin-1) -> its number of words, the items that hold it."""
    found: dict[str, tuple[int, set[str]]] = {}
    for item, text in items:
        w = words((text or "").encode("utf-8", "surrogatepass"))
        for i in range(max(1, len(w) - size + 1) if w else 0):
            part = w[i : i + size]
            key = (b" " + b" ".join(part) + b" ").decode("latin-1")
            found.setdefault(key, (len(part), set()))[1].add(item)
    return {k: (n, sorted(s)) for k, (n, s) in found.items()}


def automaton(table: dict[str, tuple[int, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, value in table.items():
        a.add_word(key, value)
    if table:
        a.make_automaton()
    return a if table else None


Span = tuple[int, int, int, int]  # first and last word, start and end byte


def _merge(spans: set[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]), out[-1][2], max(out[-1][3], s[3]))
        else:
            out.append(s)
    return out


def _edges(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw start and end."""
    inside = np.frombuffer(raw.translate(_WORD), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def scan_text(raw: bytes, machine, known: list[Span] = (), items: set[str] = frozenset(), span_words: int = 1, window: int = WINDOW, limit: int = 1 << 22):
    """Words, merged word spans (of hits of at least span_words words) with
    their bytes in the original, items of all hits. A text beyond `limit`
    bytes is scanned in parts that have window - 1 words in common."""
    spans, hit, first, at, done = set(known), set(items), 0, 0, 0
    while True:
        blank = _BLANK.search(raw, done + limit) if len(raw) - done > limit else None
        done = blank.start() if blank else len(raw)
        part = raw[at:done] if at or blank else raw
        w = words(part)
        norm = b" " + b" ".join(w) + b" "
        found = list(machine.iter(norm.decode("latin-1"))) if machine is not None and w else []
        starts, ends = _edges(part) if found or blank else (None, None)
        if found:
            blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
            for end, (_, (n, names)) in zip(np.searchsorted(blanks, [e for e, _ in found]).tolist(), found):
                if n >= span_words:
                    spans.add((first + end - n, first + end - 1, at + int(starts[end - n]), at + int(ends[end - 1])))
                hit.update(names)
        if not blank:
            return first + len(w), [dict(zip(("first", "last", "start", "end"), s)) for s in _merge(spans)], hit
        back = min(len(w), window - 1)
        first += len(w) - back
        at = at + int(starts[len(w) - back]) if back else done


def _pass(text: str, table: dict[str, tuple[int, list[str]]], columns: list[str], added: tuple[str, str, str], span_words: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(table)
        for batch in slices(batches, text, 8 << 20):
            n_words, spans, items = [], [], []
            old = zip(batch.column(added[1]).to_pylist(), batch.column(added[2]).to_pylist())
            for raw, (s, i) in zip(as_bytes(batch.column(text)).to_pylist(), old):
                n, s, i = scan_text(raw, machine, [tuple(x[k] for k in ("first", "last", "start", "end")) for x in s], set(i), span_words, window)
                n_words.append(n)
                spans.append(s)
                items.append(sorted(i))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(n_words, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(items, pa.list_(pa.string()))],
                names=[*columns, *added],
            )

    return run


def scan(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES, added: tuple[str, str, str] = ("n_words", "spans", "items"), span_words: int = 1,
) -> DataFrame:
    """docs with three `added` columns: number of words, hit runs (first and
    last word, start and end byte in the original) of hits of at least
    span_words words, sorted ids of all items hit."""
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("i is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    columns = docs.columns
    out = docs.select("*", F.lit(0).cast("long").alias(added[0]), F.array().cast(SPANS).alias(added[1]), F.array().cast("array<string>").alias(added[2]))
    schema = out.schema
    for b in range(blocks):  # each block's rows are bounded by block_bytes on average
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        table = windows([(r.i, r.t) for r in part.toLocalIterator()], window)
        out = out.mapInArrow(released(_pass(text_col, table, columns, added, span_words, window)), schema)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", min_items: int = MIN_ITEMS, min_run: int = WINDOW, **options) -> DataFrame:
    """The rows of docs without a leak. A leak is a hit run of `min_run` words
    - a whole window of one item - or hits of `min_items` different items; a
    single item too short for a window is no leak by itself, however often it
    stands in a row."""
    added = tuple(fresh(docs.columns, "n_words", "spans", "items"))
    leak = (F.size(added[2]) >= min_items) | F.exists(added[1], lambda s: s["last"] - s["first"] + 1 >= min_run)
    whole = min(min_run, options.get("window", WINDOW))
    return scan(docs, benchmark, text_col, added=added, span_words=whole, **options).filter(~leak).select(*docs.columns)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("items") >= MIN_ITEMS).alias("contaminated"),
    )


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(8, len(w)) AS n, array_to_string(w[i:i + 7], ' ') AS key
  FROM iw, unnest(range(1, greatest(2, len(w) - 6))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT g.doc_id, g.i, g.n, win.item FROM grams g JOIN win ON g.key = win.key AND g.n = win.n),
marked AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM hits), unnest(range(i, i + n)) AS t(p) GROUP BY 1),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_items, 0) >= 2 AS contaminated
FROM dw d LEFT JOIN marked USING (doc_id) LEFT JOIN named USING (doc_id)
"""
