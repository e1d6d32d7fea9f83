"""Distributions that Spark has no functions for, in numpy: normal, t, F and chi-squared."""

from __future__ import annotations

import math

import numpy as np


def normal_cdf(x: np.ndarray | float) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(-np.asarray(x, float) / math.sqrt(2))


def normal_quantile(p: np.ndarray | float) -> np.ndarray:
    """By bisection on the distribution function, to the last digit that it resolves."""
    p = np.atleast_1d(np.asarray(p, float))
    low, high = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(120):
        mid = (low + high) / 2
        below = normal_cdf(mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(p <= 0, -np.inf, np.where(p >= 1, np.inf, (low + high) / 2))


def log_gamma(x: np.ndarray | float) -> np.ndarray:
    """ln Gamma of positive numbers: Stirling's series after steps of one up to 15."""
    y = np.array(x, float)
    low = np.zeros(y.shape)
    for _ in range(15):
        small = y < 15
        low += np.where(small, np.log(np.where(small, y, 1.0)), 0.0)
        y = np.where(small, y + 1, y)
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7) + 1 / (1188 * y**9)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - low


def beta_inc(a: np.ndarray | float, b: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """The regularised incomplete beta function of arrays, by its continued fraction on the side where it is quick."""
    a, b, x = (np.array(v, float) for v in np.broadcast_arrays(a, b, x))
    out = np.where(np.isnan(a + b + x), np.nan, (x >= 1).astype(float))
    on = (x > 0) & (x < 1)
    a, b, x = a[on], b[on], x[on]
    other = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(other, b, a), np.where(other, a, b), np.where(other, 1 - x, x)
    front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 1000):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            total *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out[on] = np.where(other, 1 - front * total, front * total)
    return out


def gamma_inc_upper(a: np.ndarray | float, x: np.ndarray | float) -> np.ndarray:
    """The regularised upper incomplete gamma function of arrays: a series below a + 1, a continued fraction above."""
    a, x = (np.array(v, float) for v in np.broadcast_arrays(a, x))
    out = np.where(np.isnan(a + x), np.nan, 1.0)
    low, high = (x > 0) & (x < a + 1), (x >= a + 1) & np.isfinite(x)
    out[np.isposinf(x)] = 0.0
    front = np.exp(-x[low] + a[low] * np.log(x[low]) - log_gamma(a[low]))
    term = 1 / a[low]
    total, n = term.copy(), a[low].copy()
    for _ in range(10_000):
        n += 1
        term = term * x[low] / n
        total += term
        if (np.abs(term) <= 1e-17 * np.abs(total)).all():
            break
    out[low] = 1 - front * total
    a, x = a[high], x[high]
    front = np.exp(-x + a * np.log(x) - log_gamma(a))
    b, c = x + 1 - a, np.full(x.shape, 1e300)
    d = 1 / b
    total = d.copy()
    for i in range(1, 10_000):
        k = -i * (i - a)
        b = b + 2
        d = 1 / (k * d + b)
        c = b + k / c
        total *= c * d
        if (np.abs(c * d - 1) < 1e-15).all():
            break
    out[high] = front * total
    return out


def t_two_sided(t: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """P(|T| >= |t|); nan where it is undefined."""
    t, df = (np.array(v, float) for v in np.broadcast_arrays(t, df))
    ok = np.isfinite(t) & (df > 0)
    t, df = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    return np.where(ok, beta_inc(df / 2, 0.5, df / (df + t * t)), np.nan)


def t_quantile(p: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    """By bisection, to the last digit that the distribution function resolves."""
    p, df = (np.array(v, float) for v in np.broadcast_arrays(p, df))
    low, high = np.full(p.shape, -1e8), np.full(p.shape, 1e8)
    for _ in range(120):
        mid = (low + high) / 2
        tail = t_two_sided(mid, df) / 2
        below = np.where(mid < 0, tail, 1 - tail) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return np.where(df > 0, (low + high) / 2, np.nan)


def f_upper(f: np.ndarray | float, d1: np.ndarray | float, d2: np.ndarray | float) -> np.ndarray:
    f, d1, d2 = (np.array(v, float) for v in np.broadcast_arrays(f, d1, d2))
    g = np.where(f > 0, f, 0.0)
    return np.where(np.isnan(f), np.nan, np.where(f <= 0, 1.0, beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * g))))


def chi2_upper(x: np.ndarray | float, df: np.ndarray | float) -> np.ndarray:
    return gamma_inc_upper(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def critical_r(n: np.ndarray | int, alpha: float) -> np.ndarray | float:
    """The correlation of n samples beyond which the two-sided p-value is under alpha; n may be an array."""
    df = np.asarray(n, float) - 2
    t = t_quantile(1 - alpha / 2, np.maximum(df, 1.0))
    r = np.where(df > 0, t / np.sqrt(np.maximum(df, 1.0) + t * t), 1.0)
    return r if r.ndim else float(r)
