"""Tail probabilities without SciPy, as plain functions and as pandas UDFs for tables of one row a feature."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or t != t:
        return float("nan")
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def chi2_tail(x: float, df: float) -> float:
    """P(chi-square with df degrees of freedom >= x)."""
    if x != x or df <= 0:
        return float("nan")
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def correlation_p(r: float, n: float) -> float:
    """Two-sided p of a correlation of n pairs, with n - 2 degrees of freedom."""
    if r is None or r != r or n < 3:
        return float("nan")
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def _each(fn, *columns: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*columns, strict=True)], dtype="float64")


def normal_p(z: Column | str) -> Column:
    def each(z: pd.Series) -> pd.Series:
        return _each(normal_two_sided, z)

    return F.pandas_udf(each, "double")(z)


def chi2_p(x: Column | str, df: Column | str) -> Column:
    def each(x: pd.Series, df: pd.Series) -> pd.Series:
        return _each(chi2_tail, x, df)

    return F.pandas_udf(each, "double")(x, df)


def corr_p(r: Column | str, n: Column | str) -> Column:
    def each(r: pd.Series, n: pd.Series) -> pd.Series:
        return _each(correlation_p, r, n)

    return F.pandas_udf(each, "double")(r, n)
