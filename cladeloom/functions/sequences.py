"""Sequence columns: alphabets, sanitising, k-mers and their integer codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The residue alphabets in code order, and the merged residues.
ALPHABET_21 = "ACDEFGHIKLMNPQRSTVWXY"
ALPHABET_13 = "ACDEFGHIKLPWX"
MERGED_FROM = "STNQYVRM"
MERGED_INTO = "AADEFIKL"

#: Digits of numbers in bases up to 36.
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"

K = 6
MAX_K = 7


def check_k(k: int) -> None:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be from 1 to {MAX_K}, not {k}")


def alphabet(reduced: bool = False) -> str:
    return ALPHABET_13 if reduced else ALPHABET_21


def sanitise(seq: Column, reduced: bool = False) -> Column:
    """Drop what is not ASCII, then upper-case; any other letter becomes X.
    The reduced alphabet merges its residues first, so none is lost to X."""
    ascii_only = F.upper(F.regexp_replace(seq, r"[^\x00-\x7F]", ""))
    clean = F.regexp_replace(ascii_only, f"[^{ALPHABET_21}]", "X")
    return reduce_alphabet(clean) if reduced else clean


def strip_residues(text: Column) -> Column:
    """Only the twenty residues of a text, everything else removed."""
    ascii_only = F.upper(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.regexp_replace(ascii_only, f"[^{ALPHABET_21.replace('X', '')}]", "")


def reduce_alphabet(seq: Column) -> Column:
    return F.translate(seq, MERGED_FROM, MERGED_INTO)


def radix_weights(k: int, reduced: bool = False) -> list[int]:
    n = len(alphabet(reduced))
    return [n ** (k - 1 - i) for i in range(k)]


def digits(seq: Column, reduced: bool = False) -> Column:
    """Each residue as the digit that conv reads in base of the alphabet's size."""
    letters = alphabet(reduced)
    return F.translate(seq, letters, DIGITS[: len(letters)])


def kmer_code(kmer: Column, k: int, reduced: bool = False) -> Column:
    """The k-mer as a number in base of the alphabet's size."""
    check_k(k)
    return F.conv(digits(kmer, reduced), len(alphabet(reduced)), 10).cast("long")


def kmer_of(code: Column, k: int, reduced: bool = False) -> Column:
    """The k-mer of a code."""
    letters = alphabet(reduced)
    return F.concat(*[F.substring(F.lit(letters), (F.floor(code / w) % len(letters)).cast("int") + 1, F.lit(1)) for w in radix_weights(k, reduced)])


def explode_codes(rows: DataFrame, seq: str, k: int, keep: list[str], reduced: bool = False) -> DataFrame:
    """keep, code: a row for every place of every sequence of at least k residues."""
    places = explode_kmers(rows.withColumn(seq, digits(F.col(seq), reduced)), seq, k, keep)
    return places.select(*keep, F.conv("kmer", len(alphabet(reduced)), 10).cast("long").alias("code"))


def explode_kmers(rows: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """keep, pos (from 0), kmer: one row for every place of every sequence of
    at least k residues. Bytes are sliced, so a place costs the same wherever
    it is; sequences are ASCII after sanitising."""
    check_k(k)
    data = rows.filter(F.length(seq) >= k).select(*keep, F.encode(F.col(seq), "UTF-8").alias("__bytes"))
    places = data.select(*keep, "__bytes", F.explode(F.sequence(F.lit(0), F.length("__bytes") - k)).alias("pos"))
    return places.select(*keep, "pos", F.substring("__bytes", F.col("pos") + 1, F.lit(k)).cast("string").alias("kmer"))


def distinct_kmers(rows: DataFrame, seq: str, k: int, keep: list[str]) -> DataFrame:
    """keep, kmer, pos: the distinct k-mers with their first place."""
    return explode_kmers(rows, seq, k, keep).groupBy(*keep, "kmer").agg(F.min("pos").alias("pos"))


def with_x(kmer: Column) -> Column:
    return F.contains(kmer, F.lit("X"))


def reported_length(seq: Column, compatible: bool = True) -> Column:
    """The length that results report: one more than the residues where the
    established output format is followed."""
    return F.length(seq) + (1 if compatible else 0)
