"""Tail probabilities of the normal, chi-square and Student t distributions.

Spark SQL has no error, gamma or beta function. These expressions evaluate the
classical series and continued fractions (Abramowitz & Stegun 6.5, 26.5) from the
last term backwards with ``aggregate``, so they need no Python worker. They are
meant for result tables (one row per test), not for raw data.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _countdown(n: Column) -> Column:
    return F.sequence(n.cast("int"), F.lit(1), F.lit(-1))


def _terms(size: Column) -> Column:
    return F.lit(200.0) + F.lit(10.0) * F.sqrt(size)


def log_gamma(x: Column) -> Column:
    """log Gamma(x) for x > 0: Stirling's series after a shift by eight."""

    def stirling(z: Column) -> Column:
        z2 = z * z
        tail = (
            F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / z2) / z2) / z2
        ) / z
        shift = F.lit(0.0)
        for j in range(1, 9):
            shift = shift + F.log(z - F.lit(float(j)))
        return (z - F.lit(0.5)) * F.log(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + tail - shift

    return _let(x + F.lit(8.0), stirling)


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x)."""

    def tail(x: Column, a: Column) -> Column:
        scale = F.exp(a * F.log(x) - x - log_gamma(a))
        steps = _countdown(_terms(a))
        series = F.aggregate(steps, F.lit(1.0), lambda s, i: F.lit(1.0) + x / (a + i) * s)
        fraction = F.aggregate(
            steps, F.lit(0.0), lambda s, i: -(i * (i - a)) / (x + 2 * i + F.lit(1.0) - a + s)
        )
        return (
            F.when(x <= 0, F.lit(1.0))
            .when(x < a + 1, F.lit(1.0) - scale * series / a)
            .otherwise(scale / (x + F.lit(1.0) - a + fraction))
        )

    return _let(a, lambda a: _let(x, lambda x: tail(x, a)))


def _fraction(x: Column, a: Column, b: Column, terms: Column) -> Column:
    """The continued fraction of the incomplete beta function, after ``terms`` terms."""

    def term(s: Column, j: Column) -> Column:
        m = F.floor(j / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(j % 2 == 0, even).otherwise(odd) / (F.lit(1.0) + s)

    return F.lit(1.0) / (F.lit(1.0) + F.aggregate(_countdown(terms), F.lit(0.0), term))


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    log_front = (
        a * F.log(x) + b * F.log1p(-x) + log_gamma(a + b) - log_gamma(a) - log_gamma(b)
    )
    return F.exp(log_front) / a * _fraction(x, a, b, _terms(F.greatest(a, b)))


def lower_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""

    def value(x: Column, a: Column, b: Column) -> Column:
        return (
            F.when(x <= 0, F.lit(0.0))
            .when(x >= 1, F.lit(1.0))
            .when(x < (a + 1) / (a + b + 2), _beta_fraction(x, a, b))
            .otherwise(F.lit(1.0) - _beta_fraction(F.lit(1.0) - x, b, a))
        )

    return _let(a, lambda a: _let(b, lambda b: _let(x, lambda x: value(x, a, b))))


def normal_upper(z: Column) -> Column:
    """P(Z >= z) for a standard normal Z."""

    def tail(z: Column) -> Column:
        return _let(
            upper_gamma(F.lit(0.5), z * z / 2) / 2,
            lambda half: F.when(z >= 0, half).otherwise(F.lit(1.0) - half),
        )

    return _let(z, tail)


def chi_square_upper(x: Column, df: Column) -> Column:
    """P(X >= x) for chi-square with ``df`` degrees of freedom."""
    return upper_gamma(df / 2, x / 2)


def _log_half_step(a: Column) -> Column:
    """log Gamma(a + 1/2) - log Gamma(a) without the difference of two large numbers."""
    shift = F.lit(0.0)
    for j in range(8):
        shift = shift + F.log1p(F.lit(0.5) / (a + F.lit(float(j))))
    z = a + F.lit(8.0)
    z2 = z * z
    tail = (F.lit(1 / 8) - (F.lit(1 / 192) - (F.lit(1 / 640) - F.lit(17 / 14336) / z2) / z2) / z2) / z
    return F.lit(0.5) * F.log(z) - tail - shift


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom.

    The incomplete beta function written in the ratio t^2 / df. With one parameter at
    1/2 its continued fraction is as short for many degrees of freedom as for few. The
    relative error grows with them, to about 1e-8 at 1e8 and 1e-4 at 1e12.
    """
    half, terms = F.lit(0.5), F.lit(400)

    def tail(ratio: Column, a: Column) -> Column:
        x, y = F.lit(1.0) / (F.lit(1.0) + ratio), ratio / (F.lit(1.0) + ratio)
        front = F.exp(
            -(a + half) * F.log1p(ratio) + half * F.log(ratio) + _log_half_step(a) - F.lit(math.lgamma(0.5))
        )
        return (
            F.when(ratio <= 0, F.lit(1.0))
            .when(x < (a + 1) / (a + F.lit(2.5)), front / a * _fraction(x, a, half, terms))
            .otherwise(F.lit(1.0) - front / half * _fraction(y, half, a, terms))
        )

    return _let(t * t / df, lambda ratio: _let(df / 2, lambda a: tail(ratio, a)))
