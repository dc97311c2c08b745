"""Normal distribution helpers. Spark has no erf, so tails are written as column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

#: Below this a power series gives the tail, from it on a continued fraction; both have enough
#: terms for an absolute error below 1e-14 and, from the boundary on, a relative one of 1e-12.
_BOUNDARY, _SERIES_TERMS, _FRACTION_TERMS = 3.0, 50, 60


def _upper(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2.0))


def _from_innermost(terms: int, start: Column, step) -> Column:
    """``step(inner, k)`` for k = terms, ..., 1, beginning with ``start`` inside."""
    return F.aggregate(F.sequence(F.lit(terms), F.lit(1), F.lit(-1)), start,
                       lambda inner, k: step(inner, k.cast("double")))


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def upper_tail(x: Column | str) -> Column:
    """P(Z > x) for a standard normal Z."""
    x = _column(x)
    size = F.abs(x).cast("double")
    density = F.exp(-size * size / 2.0) / math.sqrt(2.0 * math.pi)
    # 1/2 - density * (a + a^3/3 + a^5/(3*5) + ...)
    low = F.least(size, F.lit(_BOUNDARY))
    series = _from_innermost(_SERIES_TERMS, F.lit(1.0),
                             lambda inner, k: 1.0 + low * low / (2.0 * k + 1.0) * inner)
    # density / (a + 1/(a + 2/(a + 3/...)))
    high = F.greatest(size, F.lit(_BOUNDARY))
    fraction = _from_innermost(_FRACTION_TERMS, high, lambda inner, k: high + k / inner)
    tail = F.when(size < _BOUNDARY, 0.5 - density * low * series).otherwise(density / fraction)
    return F.when(x < 0, 1.0 - tail).otherwise(tail)


def chi_square_1_tail(value: Column | str) -> Column:
    """P(X > value) for a chi-square X with one degree of freedom."""
    return 2.0 * upper_tail(F.sqrt(_column(value)))


def two_sided_critical(alpha: float) -> float:
    return NormalDist().inv_cdf(1.0 - alpha / 2.0)


def two_sided_power(delta: Column | str, alpha: float) -> Column:
    """Power of a two-sided z-test whose statistic is shifted by ``delta``."""
    z, delta = two_sided_critical(alpha), _column(delta)
    return upper_tail(F.lit(z) - delta) + upper_tail(F.lit(z) + delta)


def shift_for_power(alpha: float, power: float) -> float:
    """The smallest shift that gives a two-sided z-test the wanted power.

    Power grows with the shift, so comparing shifts with this one number is the same as
    comparing powers, and needs no tail function per row.
    """
    z = two_sided_critical(alpha)
    low, high = 0.0, 2.0 * z + 10.0
    while True:
        middle = (low + high) / 2.0
        if middle in (low, high):
            return high
        if _upper(z - middle) + _upper(z + middle) >= power:
            high = middle
        else:
            low = middle
