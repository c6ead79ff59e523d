"""Toxicity by a factorization machine over hashed terms.

A term is a lower-cased word's 64-bit hash. The terms that the labelled rows
tie to the label (chi-squared, counted where the rows are) form the model's
table; the machine has a
weight and a vector of `factors` numbers for each, so that two terms together
- an insult and the mention of a group - can weigh more than their sum. It is
fitted by full-batch Adam on the logistic loss.

Learning uses at most `max_rows` labelled rows (those of the smallest hash of
the id, so any cluster takes the same ones; of rows that repeat an id the one
of the least text digest); of their terms only those of the table reach the
driver. Scoring covers every row and whole texts in one pass without a
shuffle; the shipped table has at most `max_terms` terms.

Defined cases: null and empty texts have no terms and get the intercept's
score; a row's score depends on its text alone, so repeated rows get the same;
several labels of one id count as toxic if any is; null labels and labels of
null ids are ignored; without labelled rows, or with one label only, every
score is the smoothed share of label 1; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, discard, fresh, materialise, pieces, released, slices, text_tag
from .decontam import words

MAX_ROWS = 12_000
MAX_TERMS = 8_192
THRESHOLD = 0.3
LEAST_CHI2 = 24.0


def terms(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit term hashes of a text."""
    import xxhash

    found: set[bytes] = set()
    for piece in pieces(raw):
        found.update(words(piece))
    return np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in found], np.uint64))


@dataclass
class Machine:
    table: np.ndarray  # ascending term hashes
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def score(self, found: np.ndarray) -> float:
        z = self.bias
        if len(self.table) and len(found):
            at = np.searchsorted(self.table, found)
            at = at[self.table[np.minimum(at, len(self.table) - 1)] == found] if len(at) else at
            if len(at):
                v = self.vectors[at]
                s = v.sum(axis=0)
                z += float(self.weights[at].sum() + 0.5 * (s @ s - (v * v).sum()))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def select_terms(sets: list[np.ndarray], y: np.ndarray, max_terms: int) -> np.ndarray:
    """The terms of the greatest chi-squared with the label, LEAST_CHI2 at least."""
    if not sets:
        return np.zeros(0, np.uint64)
    every = np.concatenate(sets)
    label = np.repeat(y, [len(s) for s in sets])
    names, where = np.unique(every, return_inverse=True)
    df = np.bincount(where, minlength=len(names)).astype(float)
    pos = np.bincount(where, weights=label, minlength=len(names))
    n, p = float(len(y)), float(y.sum())
    expected = df * p / n
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = (pos - expected) ** 2 * n**3 / (df * (n - df) * p * (n - p))
    chi2 = np.where((df > 0) & (df < n), chi2, 0)
    good = np.flatnonzero((chi2 >= LEAST_CHI2) & (df >= 3))
    good = good[np.argsort(-chi2[good], kind="stable")][:max_terms]
    return np.sort(names[good])


def fit(sets: list[np.ndarray], y: np.ndarray, max_terms: int = MAX_TERMS, factors: int = 8, steps: int = 400, rate: float = 0.05, l2: float = 2e-4, seed: int = 7, table: np.ndarray | None = None) -> Machine:
    """The machine of term sets (ascending) and labels, over a given table or
    the terms that select_terms takes."""
    y = np.asarray(y, float)
    share = (y.sum() + 1) / (len(y) + 2)
    prior = float(np.log(share / (1 - share)))
    if table is None:
        table = select_terms(sets, y, max_terms) if 0 < y.sum() < len(y) else np.zeros(0, np.uint64)
    rng = np.random.default_rng(seed)
    model = Machine(table, prior, np.zeros(len(table)), rng.normal(0, 0.05, (len(table), factors)))
    if not len(table):
        return model
    row, col = [], []
    for i, s in enumerate(sets):
        at = np.searchsorted(table, s)
        at = at[table[np.minimum(at, len(table) - 1)] == s]
        row.append(np.full(len(at), i))
        col.append(at)
    row, col = np.concatenate(row), np.concatenate(col)
    params = [np.array([prior]), model.weights, model.vectors]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    n = len(y)

    def by_row(values):
        return np.stack([np.bincount(row, weights=values[:, f], minlength=n) for f in range(values.shape[1])], axis=1)

    def by_col(values):
        return np.stack([np.bincount(col, weights=values[:, f], minlength=len(table)) for f in range(values.shape[1])], axis=1)

    for t in range(1, steps + 1):
        b, w, v = params
        vc = v[col]
        s = by_row(vc)
        z = b[0] + np.bincount(row, weights=w[col], minlength=n) + 0.5 * ((s * s).sum(axis=1) - np.bincount(row, weights=(vc * vc).sum(axis=1), minlength=n))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        gc = g[row]
        grads = [np.array([g.sum()]), np.bincount(col, weights=gc, minlength=len(table)) + l2 * w, by_col(gc[:, None] * (s[row] - vc)) + l2 * v]
        for i, gr in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * gr
            second[i] = 0.999 * second[i] + 0.001 * gr * gr
            params[i] = params[i] - rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
    return Machine(table, float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """y and terms of at most max_rows labelled rows that are not held out."""
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__y"))
        .orderBy(F.xxhash64("__id"), "__id").limit(max_rows)
    )
    # max_rows bounds what is broadcast.
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__id").withColumn("__tag", text_tag(F.col("__text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", 4 << 20):
            sets = [terms(x).view(np.int64) for x in as_bytes(batch.column("__text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__y"), batch.column("__tag"), pa.array(sets, pa.list_(pa.int64()))], names=["__id", "__y", "__tag", "__terms"])

    found = rows.mapInArrow(released(run), rows.selectExpr("__id", "__y", "__tag", "array(0L) as __terms").schema)
    one = found.groupBy("__id").agg(F.max("__y").alias("y"), F.min(F.struct("__tag", "__terms")).alias("first"))
    return materialise(one.select(F.col("__id").alias("id"), "y", F.col("first.__terms").alias("terms")), "labelled")


def tied_terms(rows: DataFrame, max_terms: int = MAX_TERMS) -> np.ndarray:
    """select_terms of rows (y, terms), counted by an aggregate over the terms."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).first()
    n, p = float(total.n), float(total.p or 0)
    if not 0 < p < n:
        return np.zeros(0, np.uint64)
    counts = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos"))
    chi2 = F.pow(F.col("pos") - F.col("df") * F.lit(p / n), F.lit(2.0)) * F.lit(n**3 / (p * (n - p))) / (F.col("df") * (F.lit(n) - F.col("df")))
    best = counts.filter((F.col("df") >= 3) & (F.col("df") < n)).select("term", chi2.alias("chi2")).filter(F.col("chi2") >= LEAST_CHI2)
    got = best.orderBy(F.desc("chi2"), "term").limit(max_terms).toArrow()
    return np.sort(got.column("term").to_numpy().view(np.uint64))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS, **options) -> Machine:
    rows = training_rows(docs, labels, max_rows, **options)
    table = tied_terms(rows, max_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.values.to_numpy() for x in batch.column("terms")]
            kept = [x[np.isin(x.view(np.uint64), table)] for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.array(kept, pa.list_(pa.int64()))], names=["id", "y", "terms"])

    got = rows.mapInArrow(released(run), rows.schema).toArrow()
    order = np.argsort(np.array([str(x) for x in got.column("id").to_pylist()]), kind="stable") if got.num_rows else []
    column = got.column("terms").to_pylist()
    sets = [np.array(column[int(i)], np.int64).view(np.uint64) for i in order]
    y = got.column("y").to_numpy()[order] if got.num_rows else np.zeros(0)
    discard(rows)
    return fit(sets, np.asarray(y, float), table=table)


def score(docs: DataFrame, model: Machine, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a score column; one pass, no shuffle."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col, 8 << 20):
            s = [model.score(terms(x)) for x in as_bytes(batch.column(text_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(s, pa.float64())], names=[*columns, name])

    return docs.mapInArrow(released(run), docs.withColumn(name, F.lit(0.0)).schema)


def filter_toxic(docs: DataFrame, model: Machine, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold."""
    (name,) = fresh(docs.columns, "score")
    return score(docs, model, text_col, name).filter(F.col(name) < threshold).select(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
