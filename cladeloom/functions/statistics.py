"""Significance of k-mer counts, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LOG_P = 20000.0
EPSILON = 1e-10
ALPHA = 1e-6
COVERAGE = 25


def expected(p: Column, n: Column) -> Column:
    return p * n


def overlap(low: Column, high: Column, k: int, length: Column) -> Column:
    return (high - low + k) / length


def covers(low: Column, high: Column, k: int) -> Column:
    """The coverage threshold in residues, free of rounding."""
    return high - low + k >= COVERAGE


def divergence(count: Column, n: Column, p: Column) -> Column:
    """Kullback-Leibler divergence of the observed share from p."""
    share = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), count / n))
    return share * F.ln(share / p) + (1 - share) * F.ln((1 - share) / (1 - p))


def passes_divergence(count: Column, n: Column, p: Column, alpha: float = ALPHA) -> Column:
    return divergence(count, n, p) > F.lit(-math.log(alpha)) / n


#: Ln n! less Stirling's approximation of it, for n below 16.
STIRLING = [0.0, *(math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16))]


def stirling_error(n: Column) -> Column:
    """ln n! less Stirling's approximation."""
    z = n.cast("double")
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680) / (z * z)) / (z * z)) / (z * z)) / z
    return F.when(n < len(STIRLING), F.element_at(F.array(*[F.lit(x) for x in STIRLING]), F.least(n, F.lit(len(STIRLING) - 1)).cast("int") + 1)).otherwise(series)


def deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x; the mean itself for x = 0."""
    return F.when(x > 0, x * F.log1p((x - mean) / mean) - (x - mean)).otherwise(mean)


def log_term(x: Column, n: Column, p: Column) -> Column:
    """ln P(X = x) for X ~ Binomial(n, p), 0 < x < n: the saddle-point form, in
    which no large logarithms cancel."""
    q = 1 - p
    return (
        stirling_error(n) - stirling_error(x) - stirling_error(n - x) - deviance(x, n * p) - deviance(n - x, n * q)
        + 0.5 * F.ln(n / (2 * math.pi * x * (n - x)))
    )


def neg_log_tail(x: Column, n: Column, p: Column) -> Column:
    """-ln P(X >= x) for X ~ Binomial(n, p), where x is at least n p: the first
    term times the continued fraction of the regularised incomplete beta
    function with a = x and b = n - x + 1, evaluated from its end. It needs
    some 10 cube roots of n steps near the mean and ends by itself after 2 b."""
    a, b = x.cast("double"), (n - x + 1).cast("double")
    steps = F.least(2 * b, 40 + F.ceil(10 * F.cbrt(n.cast("double")))).cast("int")

    def coefficient(j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * p / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * p / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd)

    inside = (x > 0) & (x < n)
    fraction = F.aggregate(F.sequence(F.when(inside, steps).otherwise(F.lit(1)), F.lit(1), F.lit(-1)), F.lit(1.0), lambda c, j: 1 + coefficient(j) / c)
    tail = -(log_term(x, n, p) + F.log1p(-p) - F.ln(fraction))
    return F.when((x <= 0) | (p >= 1), F.lit(0.0)).when(x >= n, -n * F.ln(p)).otherwise(tail)


def corrected(neg_log_p: Column, n_families: Column) -> Column:
    return F.least(F.lit(MAX_LOG_P), F.greatest(F.lit(0.0), neg_log_p - F.ln(n_families)))


def passes_alpha(p: Column, alpha: float = ALPHA) -> Column:
    least = -math.log(alpha)
    return p >= least if least > 0 else (p >= least) & (p > 0)


def normalised_count(count: Column, n: Column, p: Column) -> Column:
    return (count - p * n) / (n - p * n)


def group_score(cumulated: Column, p: Column, left: Column) -> Column:
    return (cumulated - p * left) / left
