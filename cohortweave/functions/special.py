"""Distribution functions that neither Spark nor numpy has, as numpy kernels and column functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, f = 1e-300, 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + term * d, tiny) if 1 + term * d >= 0 else 1 / min(1 + term * d, -tiny)
        c = 1 + term / c
        c = c if abs(c) > tiny else tiny
        f *= c * d
        if k and abs(1 - c * d) < 1e-14:
            break
    return min(1.0, max(0.0, front * (f - 1)))


def gamma_inc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by series or by continued fraction."""
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return min(1.0, front * total)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for k in range(1, 500):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return max(0.0, 1 - front * h)


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    """P(F >= f)."""
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    """P(X >= x)."""
    return 1 - gamma_inc(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    """P(|Z| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def column(kernel: Callable[..., float]) -> Callable[..., Column]:
    """A column function of the kernel; a null or NaN argument gives null. Meant for tables of statistics, not of data."""

    @F.pandas_udf("double")
    def f(*args: pd.Series) -> pd.Series:
        known = np.logical_and.reduce([a.notna() for a in args])
        return pd.Series([kernel(*map(float, row)) if ok else None for ok, row in zip(known, zip(*args, strict=True), strict=True)], dtype=float)

    return f


def blom(rank: float, n: float) -> float:
    """The normal score of a rank: inverse normal of (r - 3/8) / (n + 1/4)."""
    return _NORMAL.inv_cdf((rank - 0.375) / (n + 0.25))
