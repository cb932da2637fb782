"""Zero-phase low-pass filters as bounded symmetric kernels.

Forward and backward filtering equals a convolution with the autocorrelation of the impulse response, which dies off: so the
filter is an operator with a bounded halo, and any chunk can be filtered on its own.
"""

from __future__ import annotations

import math

import numpy as np


def analog_poles(kind: str, order: int, norm: str = "phase") -> np.ndarray:
    """Poles of a low-pass at 1 rad/s. Bessel: `phase` (asymptote as Butterworth's) or `mag` (half power at 1)."""
    if kind == "butterworth":
        return np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    if kind != "bessel":
        raise ValueError(f"unknown filter type: {kind}")
    poly = [math.factorial(2 * order - k) / (2 ** (order - k) * math.factorial(k) * math.factorial(order - k)) for k in range(order, -1, -1)]
    poles = np.roots(poly)
    poles = poles / abs(np.prod(poles)) ** (1 / order)
    if norm == "mag":
        low, high = 1e-3, 1e3
        for _ in range(200):
            mid = math.sqrt(low * high)
            gain = abs(np.prod(-poles) / np.prod(1j * mid - poles))
            low, high = (mid, high) if gain > math.sqrt(0.5) else (low, mid)
        poles = poles / low
    return poles


def digital(kind: str, order: int, cutoff: float, rate: float, norm: str = "phase") -> tuple[np.ndarray, np.ndarray]:
    """(numerator, denominator) by the bilinear transform with the cutoff kept in place."""
    if not 0 < cutoff < rate / 2:
        raise ValueError("the cutoff must lie between 0 and half the sampling rate")
    p = analog_poles(kind, order, norm) * 2 * rate * math.tan(math.pi * cutoff / rate)
    z = (2 * rate + p) / (2 * rate - p)
    a = np.real(np.poly(z))
    b = np.real(np.poly(-np.ones(order)))
    return b * a.sum() / b.sum(), a


def impulse_response(b: np.ndarray, a: np.ndarray, tail: float = 1e-13, most: int = 1 << 17) -> np.ndarray:
    radius = max(abs(np.roots(a)))
    n = int(min(most, max(32, math.log(tail) / math.log(radius) * 1.2 + 8 * len(a))))
    out = np.zeros(n)
    for i in range(n):
        x = b[i] if i < len(b) else 0.0
        lo = max(0, i - len(a) + 1)
        out[i] = x - np.dot(a[1 : i - lo + 1], out[lo:i][::-1])
    return out


def zero_phase_kernel(kind: str, order: int, cutoff: float, rate: float, tail: float = 1e-12) -> np.ndarray:
    """Symmetric kernel of odd length; what lies below `tail` of its top is cut off, the sum is 1."""
    h = impulse_response(*digital(kind, order, cutoff, rate))
    n = 1 << (2 * len(h) - 1).bit_length()
    auto = np.fft.irfft(abs(np.fft.rfft(h, n)) ** 2, n)[: len(h)]
    keep = np.flatnonzero(abs(auto) > tail * auto[0])
    half = auto[: keep[-1] + 1]
    full = np.concatenate([half[:0:-1], half])
    return full / full.sum()
