"""The numeric functions of num.py over numpy arrays, for vectorised UDFs, and special functions that need iteration."""

from __future__ import annotations

import math

import numpy as np

from tideglass.functions.num import _P, _Q, _ROOT, _SPLIT


def ndtr(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), 38.0)
    e = np.exp(-a * a / 2)
    near = e * np.polyval(_P, a) / np.polyval(_Q, a)
    tail = a + 0.65
    for k in (4, 3, 2, 1):
        tail = a + k / tail
    c = np.where(a < _SPLIT, near, np.where(a > 37, 0.0, e / tail / _ROOT))
    return np.where(x > 0, 1 - c, c)


def log_ndtr(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    y = np.minimum(x, -5.0)
    series = -y * y / 2 - np.log(-y) - 0.9189385332046727 + np.log1p(-1 / (y * y) + 3 / y**4)
    return np.where(x > -30, np.log(np.maximum(ndtr(x), 1e-300)), series)


def touch(s0, k, sigma, t, sign, mu: float = 0.0, shift: float = 0.0) -> np.ndarray:
    """Touch probability; shift is the barrier's shift in units of sigma."""
    gap = sign * np.log(k / s0)
    b = gap + shift * sigma
    nu = sign * (mu - sigma**2 / 2)
    root = sigma * np.sqrt(np.maximum(t, 1e-300))
    p = ndtr((nu * t - b) / root) + np.exp(np.minimum(2 * nu * b / sigma**2 + log_ndtr((-b - nu * t) / root), 700))
    return np.where(gap <= 0, 1.0, np.where(t <= 0, 0.0, np.clip(p, 0, 1)))


def bisect(f, lo: np.ndarray, hi: np.ndarray, steps: int = 60) -> np.ndarray:
    """Roots of increasing functions, all at once; nan where the ends do not bracket one."""
    lo, hi = np.array(lo, float), np.array(hi, float)
    ok = (f(lo) <= 0) & (f(hi) >= 0)
    for _ in range(steps):
        mid = (lo + hi) / 2
        up = f(mid) < 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return np.where(ok, (lo + hi) / 2, np.nan)


def gamma_p(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised lower incomplete gamma function by series and continued fraction."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    lg = np.vectorize(math.lgamma, otypes=[float])(a)
    xs = np.maximum(x, 1e-300)
    front = np.exp(np.maximum(a * np.log(xs) - xs - lg, -745.0))
    near = np.minimum(x, a + 1)
    term, total = 1 / a, 1 / a
    for n in range(1, 2000):
        term = term * near / (a + n)
        total = total + term
        if np.all(np.abs(term) < 1e-16 * np.abs(total)):
            break
    far = np.maximum(xs, a + 1)
    b = far + 1 - a
    c, d = np.full_like(xs, 1e300), 1 / np.where(np.abs(b) < 1e-300, 1e-300, b)
    h = d
    for n in range(1, 2000):
        an = -n * (n - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    return np.clip(np.where(x < a + 1, front * total, 1 - front * h), 0, 1)


def inverse_gamma_quantile(q, a, scale) -> np.ndarray:
    """Quantile of the inverse-gamma distribution by bisection on the logarithm."""
    q, a, scale = np.broadcast_arrays(np.asarray(q, float), np.asarray(a, float), np.asarray(scale, float))
    root = bisect(lambda z: (1 - gamma_p(a, np.exp(-z))) - q, np.full(q.shape, -40.0), np.full(q.shape, 40.0), 80)
    return np.exp(root) * scale


def beta_i(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    y = np.clip(y, 1e-300, 1 - 1e-16)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(p + q) - lg(p) - lg(q) + p * np.log(y) + q * np.log1p(-y)) / p
    c, d = np.ones_like(y), 1 / (1 - (p + q) * y / (p + 1))
    h = d
    for m in range(1, 300):
        for an in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / (1 + an * d)
            c = 1 + an / c
            h = h * d * c
    return np.clip(np.where(swap, 1 - front * h, front * h), 0, 1)


def beta_quantile(q, a, b) -> np.ndarray:
    q, a, b = np.broadcast_arrays(np.asarray(q, float), np.asarray(a, float), np.asarray(b, float))
    return bisect(lambda x: beta_i(a, b, x) - q, np.zeros(q.shape), np.ones(q.shape), 60)
