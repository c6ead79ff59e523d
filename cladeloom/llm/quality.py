"""Quality by weak labels: heuristic labellers vote on each text, expectation
maximisation estimates how accurate each one is, and the posteriors train a
hashed linear scorer.

The labellers see whole texts, every text votes, and the votes of all texts
enter the estimate: texts are counted by vote pattern, of which there are at
most 3 ** number of labellers, so the counts fit the driver at any corpus
size. The scorer is fitted to at most `max_rows` texts (those of the smallest
hash of id and text) and their posteriors, which weigh each row's two
possible labels. Scoring is one pass without a shuffle.

Defined cases: null and empty texts have no words, draw one vote (too short)
and are scored like any other; repeated rows vote each and score the same; an
empty table gives an empty result; ids may be null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, pieces, slices

MAX_ROWS = 6_000
DIMENSIONS = 1 << 12
THRESHOLD = 0.5

#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    w.encode()
    for w in (
        "a an and are as at be by for from in is it of on or that the this to was with "
        "als auch auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
        "au aux ce ces dans de des du en est et il la le les ne pas pour que qui sur un une "
        "al como con del el es las lo los no para por se su una y"
    ).split()
)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


def measures(raw: bytes) -> dict[str, float]:
    """What the labellers look at, over the whole text, taken piece by piece."""
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if len(raw) < 1 << 22 else sum(
        np.bincount(np.frombuffer(raw, np.uint8, min(1 << 22, len(raw) - i), i), minlength=256) for i in range(0, len(raw), 1 << 22)
    )
    n = stutters = known = 0
    kinds: set[bytes] = set()
    last = None
    for piece in pieces(raw):
        w = piece.split()
        n += len(w)
        stutters += sum(map(eq, w, w[1:])) + (bool(w) and w[0] == last)
        known += sum(map(FUNCTION_WORDS.__contains__, piece.lower().split()))
        kinds.update(w)
        last = w[-1] if w else last
    letters = int(count[_UPPER].sum() + count[_LOWER].sum()) or 1
    lines = again = at = 0
    seen: set[bytes] = set()
    while at <= len(raw):
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end]
        at = end + 1
        if line.strip():
            lines += 1
            mark = line if len(line) < 64 else hashlib.blake2b(line, digest_size=16).digest()
            again += mark in seen
            seen.add(mark)
    return {
        "words": n,
        "symbols": float(count[_SYMBOL].sum()) / (n or 1),
        "upper": float(count[_UPPER].sum()) / letters,
        "shouts": float(count[33]) / (n or 1),
        "stutter": stutters / (n or 1),
        "again": again / (lines or 1),
        "function": known / (n or 1),
        "length": len(raw) / (n or 1),
        "variety": len(kinds) / (n or 1),
    }


#: name, measure, votes good up to, votes bad from (good > bad: the other way round), words needed for a vote
LABELLERS = (
    ("short", "words", 40, 12, 0),
    ("symbols", "symbols", 0.02, 0.1, 1),
    ("upper", "upper", 0.15, 0.35, 1),
    ("shouts", "shouts", 0.01, 0.08, 1),
    ("stutter", "stutter", 0.01, 0.05, 5),
    ("again", "again", 0.05, 0.3, 20),
    ("function", "function", 0.12, 0.05, 20),
    ("length", "length", 9.0, 14.0, 5),
    ("variety", "variety", 0.35, 0.2, 60),
)


def votes(m: dict[str, float]) -> list[int]:
    """1 good, -1 bad, 0 none, by labeller."""
    out = []
    for _, what, good, bad, least in LABELLERS:
        x = m[what]
        if m["words"] < least:
            out.append(0)
        elif good <= bad:
            out.append(1 if x <= good else -1 if x >= bad else 0)
        else:
            out.append(1 if x >= good else -1 if x <= bad else 0)
    return out


@dataclass
class Accuracies:
    prior: float  # share of good texts
    good: np.ndarray  # of each labeller: P(vote good | good text, a vote)
    bad: np.ndarray  # P(vote bad | bad text, a vote)

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        up, down = pattern > 0, pattern < 0
        a = np.log(self.prior) + up @ np.log(self.good) + down @ np.log1p(-self.good)
        b = np.log1p(-self.prior) + up @ np.log1p(-self.bad) + down @ np.log(self.bad)
        return 1 / (1 + np.exp(np.clip(b - a, -700, 700)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Accuracies:
    """Expectation maximisation over vote patterns and how often they occur,
    from the start that two bad votes outweigh the good ones."""
    patterns, counts = np.asarray(patterns, float).reshape(-1, len(LABELLERS)), np.asarray(counts, float)
    up, down = patterns > 0, patterns < 0
    p = np.where(down.sum(axis=1) >= 2, 0.05, np.where(down.sum(axis=1) == 1, 0.5, 0.95))
    model = Accuracies(0.5, np.full(len(LABELLERS), 0.8), np.full(len(LABELLERS), 0.8))
    if not counts.sum():
        return model
    for _ in range(rounds):
        g, b = counts * p, counts * (1 - p)
        model = Accuracies(
            float((g.sum() + 1) / (counts.sum() + 2)),
            (g @ up + 2) / (g @ up + g @ down + 2.5),
            (b @ down + 1) / (b @ up + b @ down + 2),
        )
        after = model.posterior(patterns)
        if np.abs(after - p).max() < 1e-9:
            break
        p = after
    return model


def features(raw: bytes, m: dict[str, float], size: int = DIMENSIONS) -> np.ndarray:
    """Hashed byte trigrams (logarithms, unit length) and hashed terms for
    the measures' magnitudes."""
    d = np.frombuffer(raw, np.uint8)
    x = np.zeros(size, np.float32)
    bits = np.uint32(32 - (size.bit_length() - 1))
    for i in range(0, max(0, len(d) - 2), 1 << 20):
        part = d[i : i + (1 << 20) + 2].astype(np.uint32)
        h = ((part[:-2] << np.uint32(16)) + (part[1:-1] << np.uint32(8)) + part[2:]) * np.uint32(2654435761) >> bits
        x += np.bincount(h, minlength=size).astype(np.float32)
    x = np.log1p(x)
    x /= np.sqrt(float(x @ x)) or 1
    for k, (name, what, good, bad, _) in enumerate(LABELLERS):
        step = int(np.clip(np.floor(8 * (m[what] - min(good, bad)) / (abs(bad - good) or 1)), -8, 16))
        x[((k * 64 + step + 8) * 2654435761 & 0xFFFFFFFF) >> int(bits)] += 0.5
    return x


@dataclass
class Scorer:
    bias: float
    weights: np.ndarray

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + x @ self.weights, -30, 30))))


def fit(x: np.ndarray, p: np.ndarray, steps: int = 300, rate: float = 0.1, l2: float = 1e-5) -> Scorer:
    """Logistic regression on posterior labels by full-batch Adam."""
    n, size = x.shape if len(x) else (0, DIMENSIONS)
    if not n:
        return Scorer(0.0, np.zeros(size, np.float32))
    share = (p.sum() + 1) / (n + 2)
    w, b = np.zeros(size, np.float32), float(np.log(share / (1 - share)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        e = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - p
        g = np.append(x.T @ e.astype(np.float32) / n + l2 * w, e.mean())
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        w, b = (w - step[:-1]).astype(np.float32), b - float(step[-1])
    return Scorer(b, w)


def vote(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and votes (a character + - 0 for each labeller) of each row."""
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            v = ["".join("0+-"[x] for x in votes(measures(t))) for t in as_bytes(batch.column(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(v, pa.string())], names=[id_col, "votes"])

    return rows.mapInArrow(run, rows.selectExpr(id_col, "'' as votes").schema)


def _numbers(patterns: list[str]) -> np.ndarray:
    return np.array([["0+-".index(c) if c != "-" else -1 for c in p] for p in patterns], float).reshape(-1, len(LABELLERS))


def learn(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> tuple[Accuracies, Scorer]:
    counted = vote(docs, id_col, text_col).groupBy("votes").agg(F.count(F.lit(1)).alias("n")).orderBy("votes").collect()
    model = estimate(_numbers([r.votes for r in counted]), np.array([r.n for r in counted]))
    total = sum(r.n for r in counted)
    # The hash's share bounds what is turned into features; the limit makes the bound exact.
    order = F.xxhash64(F.col(id_col), F.col(text_col))
    share = min(1.0, 1.2 * max_rows / total) if total else 1.0
    rows = docs.select(order.alias("order"), F.col(text_col).alias("text")).filter(
        F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            out, p = [], []
            for raw in as_bytes(batch.column("text")).to_pylist():
                m = measures(raw)
                out.append(features(raw, m).astype("<f2").tobytes())
                p.append("".join("0+-"[x] for x in votes(m)))
            yield pa.RecordBatch.from_arrays([batch.column("order"), pa.array(out, pa.binary()), pa.array(p, pa.string())], names=["order", "x", "votes"])

    got = rows.mapInArrow(run, "order long, x binary, votes string").orderBy("order", "x").limit(max_rows).toArrow()
    x = np.stack([np.frombuffer(b, "<f2") for b in got.column("x").to_pylist()]).astype(np.float32) if got.num_rows else np.zeros((0, DIMENSIONS), np.float32)
    return model, fit(x, model.posterior(_numbers(got.column("votes").to_pylist())) if got.num_rows else np.zeros(0))


def score(docs: DataFrame, model: Accuracies, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, votes, posterior, score for each row of docs."""
    rows = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            v, s = [], []
            for raw in as_bytes(batch.column(text_col)).to_pylist():
                m = measures(raw)
                v.append(votes(m))
                s.append(scorer.score(features(raw, m)))
            p = model.posterior(np.array(v, float)) if v else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(["".join("0+-"[x] for x in y) for y in v], pa.string()), pa.array(p, pa.float64()), pa.array(s, pa.float64())],
                names=[id_col, "votes", "posterior", "score"],
            )

    return rows.mapInArrow(run, rows.selectExpr(id_col, "'' as votes", "0D as posterior", "0D as score").schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs, *learn(docs)).select("doc_id", "votes", "posterior", "score", (F.col("score") >= THRESHOLD).alias("kept"))
