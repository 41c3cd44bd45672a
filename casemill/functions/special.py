"""Incomplete gamma and beta functions and their inverses, in numpy, for use inside Arrow UDFs."""

from __future__ import annotations

import math

import numpy as np

_TINY = 1e-300
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised lower incomplete gamma function P(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    front = np.exp(np.where(x > 0, -x + a * np.log(np.maximum(x, _TINY)) - _lgamma(a), -np.inf))
    series = (x > 0) & (x < a + 1)
    if series.any():
        aa, xx = a[series], x[series]
        term = 1 / aa
        total = term.copy()
        k = aa.copy()
        for _ in range(10_000):
            k += 1
            term *= xx / k
            total += term
            if (term <= total * 1e-17).all():
                break
        out[series] = total * front[series]
    tail = x >= a + 1
    if tail.any():
        out[tail] = 1 - _upper_fraction(a[tail], x[tail]) * front[tail]
    return np.clip(out, 0, 1)


def _upper_fraction(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the upper function, by the modified method of Lentz."""
    b = x + 1 - a
    c = np.full_like(b, 1 / _TINY)
    d = 1 / np.where(np.abs(b) < _TINY, _TINY, b)
    h = d.copy()
    for i in range(1, 10_000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        step = d * c
        h *= step
        if (np.abs(step - 1) < 1e-16).all():
            break
    return h


def gamma_quantile(q: float | np.ndarray, a: np.ndarray) -> np.ndarray:
    """x with P(a, x) = q for unit rate: bracketed, then Newton steps kept inside the bracket."""
    a = np.asarray(a, float)
    q = np.broadcast_to(np.asarray(q, float), a.shape)
    z = np.array([normal_quantile(v) for v in q.ravel()]).reshape(q.shape)
    x = a * np.maximum(1 - 1 / (9 * a) + z / (3 * np.sqrt(a)), 1e-8) ** 3
    small = np.exp((np.log(q) + _lgamma(a + 1)) / a)
    x = np.where((a < 1) | (x <= small * 1e-3), small, x)
    low, high = np.zeros_like(a), np.maximum(x, 1.0)
    while (short := gamma_p(a, high) < q).any():
        high = np.where(short, high * 2, high)
    for _ in range(200):
        value = gamma_p(a, x)
        low, high = np.where(value < q, x, low), np.where(value < q, high, x)
        density = np.exp(-x + (a - 1) * np.log(np.maximum(x, _TINY)) - _lgamma(a))
        new = x - (value - q) / np.maximum(density, _TINY)
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        done = np.abs(new - x) <= 1e-15 * np.abs(new)
        x = new
        if done.all():
            break
    return x


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    flip = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    inside = (y > 0) & (y < 1)
    safe = np.where(inside, y, 0.5)
    front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(safe) + q * np.log1p(-safe)) / p
    c, d = np.ones_like(p), 1 - (p + q) * safe / (p + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 5_000):
        for top in (m * (q - m) * safe / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * safe / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
        if (np.abs(step - 1) < 1e-16).all():
            break
    value = np.where(inside, front * h, np.where(y >= 1, 1.0, 0.0))
    return np.where(flip, 1 - value, value)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x with I_x(a, b) = q, by bisection."""
    a, b = np.asarray(a, float), np.asarray(b, float)
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(100):
        middle = (low + high) / 2
        below = beta_i(a, b, middle) < q
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return (low + high) / 2


def normal_quantile(q: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(q)


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return float(beta_i(df / 2, 0.5, df / (df + t * t)))
