"""Distribution functions in plain Python, for statistics that have been reduced to one row, and digamma of a column."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY, _EPS = 1e-300, 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or _TINY)
    out = d
    for m in range(1, 2000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or _TINY)
            c = 1 + step / c or _TINY
            out *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return out


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_cdf(x: float, a: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * _EPS:
            k += 1
            term *= x / k
            total += term
        return front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    out = d
    for i in range(1, 5000):
        b += 2
        d = 1 / (b - i * (i - a) * d or _TINY)
        c = b - i * (i - a) / c or _TINY
        out *= c * d
        if abs(c * d - 1) < _EPS:
            break
    return 1 - front * out


def f_cdf(x: float, d1: float, d2: float) -> float:
    return 0.0 if x <= 0 else beta_cdf(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_cdf(d2 / (d1 * x + d2), d2 / 2, d1 / 2)


def chi2_sf(x: float, df: float) -> float:
    return math.exp(-x / 2) if df == 2 and x > 0 else 1 - gamma_cdf(x / 2, df / 2)


def t_sf(x: float, df: float) -> float:
    """Upper tail of Student's t."""
    tail = beta_cdf(df / (df + x * x), df / 2, 0.5) / 2
    return tail if x >= 0 else 1 - tail


def _inverse(tail, p: float, low: float, high: float) -> float:
    """The point at which a falling ``tail`` function is ``p``, by bisection; ``high`` grows until it is beyond."""
    while tail(high) > p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(middle) > p else (low, middle)
    return (low + high) / 2


def f_isf(p: float, d1: float, d2: float) -> float:
    return _inverse(lambda x: f_sf(x, d1, d2), p, 0.0, 1.0)


def chi2_isf(p: float, df: float) -> float:
    return _inverse(lambda x: chi2_sf(x, df), p, 0.0, 1.0)


def t_isf(p: float, df: float) -> float:
    return 0.0 if p == 0.5 else _inverse(lambda x: t_sf(x, df), p, 0.0, 1.0) if p < 0.5 else -t_isf(1 - p, df)


def normal_ppf(p: float) -> float:
    """Quantile of the standard normal distribution; infinite at 0 and 1."""
    return -math.inf if p <= 0 else math.inf if p >= 1 else NormalDist().inv_cdf(p)


#: Acklam's rational approximation of the normal quantile, numerators and denominators, in the middle and the tails.
PPF_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
PPF_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
PPF_CUT = 0.02425


def normal_ppf_of(p):
    """Quantile of the standard normal distribution as a Column, to a relative error of about 1e-9; null at and beyond 0 and 1."""
    from pyspark.sql import functions as F

    def poly(coefficients, x):
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * x + F.lit(c)
        return out

    q = p - 0.5
    middle = q * poly(PPF_MIDDLE[0], q * q) / poly(PPF_MIDDLE[1], q * q)
    root = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    tail = poly(PPF_TAIL[0], root) / poly(PPF_TAIL[1], root)
    inner = F.when(p < PPF_CUT, tail).when(p > 1 - PPF_CUT, -tail).otherwise(middle)
    return F.when((p > 0) & (p < 1), inner)


def digamma(x: float) -> float:
    out = 0.0
    while x < 8:
        out -= 1 / x
        x += 1
    s = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - s * (1 / 12 - s * (1 / 120 - s * (1 / 252 - s * (1 / 240 - s * (1 / 132)))))


def digamma_of(x: Column) -> Column:
    """The digamma function of a positive column, in the JVM: eight steps up, then the asymptotic series."""
    x = x.cast("double")
    z = x + 8
    series = F.ln(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) + 1 / (240 * z**8) - 1 / (132 * z**10)
    for i in range(8):
        series = series - 1 / (x + i)
    return series


def binomial_pmf(k: int, n: int, p: float = 0.5) -> float:
    return math.comb(n, k) * p**k * (1 - p) ** (n - k)
