"""Column expressions that Spark has no single function for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_days(later: Column, earlier: Column) -> Column:
    """Completed 24-hour periods between two timestamps; midnights crossed do not count."""
    return F.date_part(F.lit("DAY"), later - earlier).cast("bigint")


def money(column: Column) -> Column:
    """A decimal total as double, for ratios and models."""
    return column.cast("double")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division in double; null where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ln_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0.

    Stirling's series at z + 8, brought back to z by the recurrence. Good to about 1e-13.
    """
    shift = 8
    far = z + shift
    inverse = F.lit(1.0) / far
    square = inverse * inverse
    # Bernoulli terms B(2k) / (2k (2k-1)) of the series
    terms = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
    series = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        series = series * square + F.lit(term)
    product = z
    for i in range(1, shift):
        product = product * (z + i)
    return (
        (far - 0.5) * F.ln(far) - far + F.lit(0.5 * math.log(2 * math.pi)) + series * inverse - F.ln(product)
    )


def _series(terms: list[float], square: Column) -> Column:
    total = F.lit(terms[-1])
    for term in reversed(terms[:-1]):
        total = total * square + F.lit(term)
    return total


def digamma(z: Column) -> Column:
    """First derivative of `ln_gamma`, for z > 0; good to about 1e-13."""
    shift = 8
    far = z + shift
    inverse = F.lit(1.0) / far
    # Bernoulli terms B(2k) / 2k of the series
    series = _series([1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760], inverse * inverse)
    near = sum((F.lit(1.0) / (z + i) for i in range(1, shift)), F.lit(1.0) / z)
    return F.ln(far) - inverse / 2 - series * inverse * inverse - near


def trigamma(z: Column) -> Column:
    """Second derivative of `ln_gamma`, for z > 0; good to about 1e-12."""
    shift = 8
    far = z + shift
    inverse = F.lit(1.0) / far
    # Bernoulli numbers B(2k) of the series
    series = _series([1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730], inverse * inverse)
    near = sum((F.lit(1.0) / ((z + i) * (z + i)) for i in range(1, shift)), F.lit(1.0) / (z * z))
    return inverse + inverse * inverse / 2 + series * inverse * inverse * inverse + near
