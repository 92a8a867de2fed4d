"""Tails of the t, F, chi-square and normal distributions for a few scalars.

Used on results that are already small (coefficient tables, test statistics).
"""

from __future__ import annotations

import math


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return h


def beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x)."""
    if x <= 0:
        return 1.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        for _ in range(2000):
            n += 1
            term *= x / n
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1.0 - total * math.exp(log_front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 2000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return math.exp(log_front) * h


def t_two_sided(t: float, df: float) -> float:
    if df <= 0 or math.isnan(t):
        return math.nan
    return beta_regularised(df / 2, 0.5, df / (df + t * t))


def t_quantile(level: float, df: float) -> float:
    """Upper quantile: P(T <= result) = level, by bisection."""
    low, high = 0.0, 1.0
    tail = 2 * (1 - level)
    while t_two_sided(high, df) > tail:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > tail else (low, mid)
    return (low + high) / 2


def f_upper(f: float, d1: float, d2: float) -> float:
    if f <= 0 or d2 <= 0:
        return 1.0
    return beta_regularised(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2, x / 2)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))
