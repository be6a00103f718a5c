"""Normal tails and the tests built on them, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational Chebyshev fit of erfc (relative error < 1.2e-7).
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)
SQRT2 = math.sqrt(2.0)


def erfc(x: Column) -> Column:
    """Complementary error function with usable deep tails."""
    t = F.lit(1.0) / (F.lit(1.0) + F.abs(x) * 0.5)
    poly: Column = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = F.lit(c) + t * poly
    tail = t * F.exp(-x * x + poly)
    return F.when(x >= 0, tail).otherwise(F.lit(2.0) - tail)


def upper_tail(z: Column) -> Column:
    return erfc(z / F.lit(SQRT2)) * 0.5


def normal_cdf(z: Column) -> Column:
    return erfc(-z / F.lit(SQRT2)) * 0.5


def binomial_upper_p(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) by the normal approximation with continuity correction; 1 if k does not exceed n*p."""
    z = (k - 0.5 - n * p) / F.sqrt(n * p * (F.lit(1.0) - p))
    return F.when(k <= n * p, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), upper_tail(z))))


def mean_shift_p(mean: Column, mu: Column, sigma: Column, n: Column) -> Column:
    """Two-sided p-value of a window mean against a known mean and deviation."""
    z = F.abs(mean - mu) / (sigma / F.sqrt(n))
    return F.when((sigma <= 0) | (n <= 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), erfc(z / F.lit(SQRT2))))


def two_sided_p(z: Column) -> Column:
    return erfc(F.abs(z) / F.lit(SQRT2))


def binomial_z(k: Column, n: Column, p: Column) -> Column:
    """Plain binomial z-score without continuity correction."""
    return (k - n * p) / F.sqrt(n * p * (F.lit(1.0) - p))
