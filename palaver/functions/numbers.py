"""Column functions for scores and logarithms."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def log2_or_zero(p: Column) -> Column:
    """Base 2 logarithm where the logarithm of 0 is 0."""
    return F.when(p == 0, 0.0).otherwise(F.log2(F.when(p != 0, p)))


def log2_or_minus_inf(p: Column) -> Column:
    """Base 2 logarithm where the logarithm of 0 is minus infinity."""
    return F.when(p == 0, F.lit(float("-inf"))).otherwise(F.log2(F.when(p != 0, p)))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b != 0, b))


def round_to(x: Column, base: float) -> Column:
    return F.round(x / F.lit(base)) * F.lit(base)


def precision(tp: Column, fp: Column) -> Column:
    return safe_div(tp.cast("double"), tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return safe_div(tp.cast("double"), tp + fn)


def f_score(tp: Column, fp: Column, fn: Column) -> Column:
    return safe_div(2.0 * tp, 2 * tp + fp + fn)


def segmentation_error(tp: Column, fp: Column, fn: Column) -> Column:
    """Wrong boundaries per 100 reference boundaries; 0 without errors. Without reference boundaries it is null if there are errors."""
    return F.when(fp + fn == 0, 0.0).otherwise(F.try_divide((fp + fn) * F.lit(100.0), tp + fn))


def nist_percentile(sorted_values: Column, p: Column) -> Column:
    """Percentile of an ascending array: rank = p / 100 * n; the first value below rank 1, the last from rank n - 1 on, else between the
    two values around the rank."""
    n = F.size(sorted_values)
    rank = p / F.lit(100.0) * n
    k = F.floor(rank).cast("int")
    low, high = F.get(sorted_values, k - 1), F.get(sorted_values, k)
    return F.when(n == 0, None).when(k == 0, F.get(sorted_values, F.lit(0))).when(k >= n - 1, F.element_at(sorted_values, -1)).otherwise(low + (rank - k) * (high - low))


#: Terms of the continued fraction of ``incomplete_beta``; it converges within some dozens for the arguments that it is given.
BETA_TERMS = 200
# fixed values: Lanczos' coefficients of the gamma function (g = 7)
GAMMA = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Natural logarithm of the gamma function for x >= 0.5."""
    terms = F.lit(GAMMA[0])
    for k, c in enumerate(GAMMA[1:]):
        terms = terms + F.lit(c) / (x + F.lit(float(k)))
    t = x + F.lit(6.5)
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - F.lit(0.5)) * F.log(t) - t + F.log(terms)


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 0.5 and x from 0 to 1."""

    def fraction(p: Column, q: Column, z: Column) -> Column:
        # 1 / (1 + d1 / (1 + d2 / ...)), folded from the last term; d(2m) and d(2m + 1) are the terms of the power series' fraction
        def step(value: Column, k: Column) -> Column:
            m = F.floor(k / 2).cast("double")
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return 1 + F.when(k % 2 == 0, even).otherwise(odd) / value

        return 1 / F.aggregate(F.sequence(F.lit(BETA_TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), step)

    def below(p: Column, q: Column, z: Column) -> Column:
        front = F.exp(p * F.log(z) + q * F.log(1 - z) + log_gamma(p + q) - log_gamma(p) - log_gamma(q))
        return front * fraction(p, q, z) / p

    # the fraction converges fast on the side of the mean that x is on
    inside = F.when(x < (a + 1) / (a + b + 2), below(a, b, x)).otherwise(1 - below(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inside)


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided probability of a correlation at least as large as ``r`` by chance, from Student's t with n - 2 degrees of freedom; null for fewer than three pairs."""
    free = (n - 2).cast("double")
    return F.when(n > 2, incomplete_beta(free / 2, F.lit(0.5), F.greatest(F.lit(0.0), 1 - r * r)))
