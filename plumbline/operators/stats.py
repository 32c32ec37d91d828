"""Distribution functions that the box has no library for, on the driver, and the normal quantile as an expression."""

from __future__ import annotations

from math import erf, erfc, exp, inf, lgamma, log, pi, sqrt

from pyspark.sql import Column
from pyspark.sql import functions as F

# The coefficients of Acklam's rational approximation of the normal quantile.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
_TAIL = 0.02425


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal value below which a share ``p`` lies; relative error under 1.2e-9."""
    tail = lambda q: _poly(q, _C) / (_poly(q, _D) * q + 1)
    lower = tail(F.sqrt(-2 * F.ln(p)))
    upper = -tail(F.sqrt(-2 * F.ln(1 - p)))
    q = p - 0.5
    r = q * q
    middle = _poly(r, _A) * q / (_poly(r, _B) * r + 1)
    return F.when(p < _TAIL, lower).when(p > 1 - _TAIL, upper).otherwise(middle)


def normal_cdf(x: float) -> float:
    return 0.5 * (1 + erf(x / sqrt(2)))


def normal_pdf(x: float) -> float:
    return exp(-x * x / 2) / sqrt(2 * pi)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / (c if abs(c) > tiny else tiny)
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def f_tail(value: float, d1: float, d2: float) -> float:
    """P(F > value) with d1 and d2 degrees of freedom."""
    if value != value or d2 <= 0:
        return 1.0
    return 0.0 if value == inf else 1.0 if value <= 0 else beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * value))


def chi2_tail(value: float, df: float) -> float:
    """P(chi-square > value): the regularised upper incomplete gamma function."""
    if value <= 0 or value != value:
        return 1.0
    a, x = df / 2, value / 2
    front = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    if a == 0.5:
        return erfc(sqrt(x))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h
