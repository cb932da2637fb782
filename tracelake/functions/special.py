"""Special functions in NumPy."""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gammaln(x):
    return _lgamma(np.asarray(x, float))


def digamma(x):
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1.0), out)
        x = np.where(low, x + 1, x)
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def logsumexp(a, axis=None):
    a = np.asarray(a, float)
    top = np.max(a, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    out = np.log(np.sum(np.exp(a - top), axis=axis, keepdims=True)) + top
    return float(out.ravel()[0]) if axis is None else np.squeeze(out, axis=axis)


def gamma_cdf(x: float, shape: float) -> float:
    """Regularised lower incomplete gamma function: a series below the mean, a continued fraction above."""
    if x <= 0:
        return 0.0
    front = math.exp(shape * math.log(x) - x - math.lgamma(shape))
    if x < shape + 1:
        term = total = 1.0 / shape
        n = shape
        while abs(term) > 1e-16 * abs(total):
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * front)
    b = x + 1 - shape
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10_000):
        a = -i * (i - shape)
        b += 2
        d = a * d + b or 1e-300
        c = b + a / c or 1e-300
        d = 1 / d
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return 1.0 - front * h


def gamma_quantile(p: float, shape: float, rate: float) -> float:
    """Bisection on the distribution function."""
    low, high = 0.0, max(1.0, shape)
    while gamma_cdf(high, shape) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(mid, shape) < p else (low, mid)
    return (low + high) / 2 / rate
