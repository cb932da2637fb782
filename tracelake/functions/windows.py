"""NumPy kernels over a stretch of a signal: percentiles around centres, the baseline that they draw, and its moving mean."""

from __future__ import annotations

import numpy as np

#: Values that a sliding window holds at once.
BLOCK = 1 << 20
#: Widths up to this are averaged value by value: a residual on a threshold then rounds as that of a plain mean does.
NARROW = 64


def rank_of(percentile: float, count: np.ndarray) -> np.ndarray:
    """Nearest rank from 0, halves up."""
    return np.floor(percentile / 100.0 * (count - 1) + 0.5).astype(np.int64)


def every_percentile(x: np.ndarray, ok: np.ndarray, at: np.ndarray, h: int, percentile: float) -> np.ndarray:
    """Percentile of the usable values in [c - h, c + h) for each place c; NaN where there are none. Places lie close together."""
    out = np.full(len(at), np.nan)
    if not len(at):
        return out
    v = np.where(ok, x, np.inf)
    padded = np.concatenate([np.full(h, np.inf), v, np.full(h, np.inf)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, max(1, 2 * h))
    counts = np.concatenate([[0], np.cumsum(ok)])
    many = counts[np.clip(at + h, 0, len(x))] - counts[np.clip(at - h, 0, len(x))]
    rows = max(1, BLOCK // max(1, 2 * h))
    for i in range(0, len(at), rows):
        own = slice(i, i + rows)
        some = many[own] > 0
        ranked = np.sort(windows[at[own][some]], axis=1)
        out[np.flatnonzero(some) + i] = ranked[np.arange(int(some.sum())), rank_of(percentile, many[own][some])]
    return out


def some_percentiles(x: np.ndarray, ok: np.ndarray, at: np.ndarray, h: int, percentile: float) -> np.ndarray:
    """As every_percentile for places far apart: one selection each."""
    out = np.full(len(at), np.nan)
    for i, c in enumerate(at.tolist()):
        low, high = max(0, c - h), max(0, min(len(x), c + h))
        own = x[low:high][ok[low:high]]
        if len(own):
            k = int(rank_of(percentile, np.array(len(own))))
            out[i] = np.partition(own, k)[k]
    return out


def lines(centres: np.ndarray, s0: int, total: int, step: int, at: np.ndarray) -> np.ndarray:
    """Straight lines between centres (number s0 and on, of `total`, `step` samples apart) at places of the recording."""
    left = np.clip(at // step, 0, max(total - 2, 0))
    v0 = centres[left - s0]
    if total < 2:
        return v0
    return v0 + (at - left * step) / step * (centres[left + 1 - s0] - v0)


def mean_width(window: int) -> int:
    width = max(3, window // 10)
    return width + 1 - width % 2


def smooth_lines(centres: np.ndarray, s0: int, total: int, step: int, n: int, window: int, first: int, count: int) -> np.ndarray:
    """Baseline at samples first .. first + count: the lines' moving mean, cut off at the recording's ends; a recording shorter
    than the mean's width keeps the lines."""
    width = mean_width(window)
    if n < width:
        return lines(centres, s0, total, step, np.arange(first, first + count))
    h = width // 2
    low, high = max(0, first - h), min(n, first + count + h)
    raw = lines(centres, s0, total, step, np.arange(low, high))
    at = np.arange(first, first + count)
    if width <= NARROW:
        total_, padded = np.zeros(count), np.concatenate([np.zeros(low - first + h), raw, np.zeros(first + count + h - high)])
        for k in range(width):  # from left to right, as a sliding frame adds them up
            total_ += padded[k : k + count]
        return total_ / (np.minimum(at + h + 1, n) - np.maximum(at - h, 0))
    shift = raw.mean()  # keeps running sums small
    sums = np.concatenate([[0.0], np.cumsum(raw - shift)])
    a, b = np.maximum(at - h, 0) - low, np.minimum(at + h + 1, n) - low
    return (sums[b] - sums[a]) / (b - a) + shift
