"""Posteriors of event statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracelake.functions.special import gamma_quantile


def capture_rate(n: int, seconds: float, shape: float = 0.5, rate: float = 0.0, credibility: float = 0.95) -> dict[str, float]:
    """Gamma posterior of an event rate: mean and equal-tailed interval."""
    if seconds <= 0:
        raise ValueError("the observation time must be positive")
    a, b, tail = shape + n, rate + seconds, (1 - credibility) / 2
    return {"n_events": n, "shape": a, "rate": b, "mean": a / b, "lower": gamma_quantile(tail, a, b), "upper": gamma_quantile(1 - tail, a, b)}


@dataclass
class DwellMixture:
    n_components: int
    probabilities: dict[int, float]
    tau_mean: np.ndarray
    tau_lower: np.ndarray
    tau_upper: np.ndarray
    weights: np.ndarray
    t_min: float
    n_events: int


def dwell_mixture(durations, t_min: float | None = None, most: int = 4, concentration: float = 0.01, draws: int = 3000, burn: int = 1000, share: float = 0.02, credibility: float = 0.95, seed: int = 0, counts=None) -> DwellMixture:
    """Gibbs sampling of a sparse mixture of exponentials shifted by t_min; components ordered by time constant.

    counts: how often each duration occurs (once if not given). Equal durations are dealt to the components by one multinomial
    draw, which has the distribution of as many single draws, so a sweep takes time by the number of different durations.
    """
    t = np.asarray(durations, float)
    times = np.ones(len(t), np.int64) if counts is None else np.asarray(counts, np.int64)
    some = np.isfinite(t) & (t > 0)
    t, at = np.unique(t[some], return_inverse=True)
    times = np.bincount(at, times[some], len(t)).astype(np.int64)
    size = int(times.sum())
    if size < 2:
        raise ValueError("at least two positive durations are needed")
    t_min = float(t.min()) if t_min is None else t_min
    x = np.maximum(t - t_min, 0)
    scale = float(np.average(x, weights=times)) or float(np.average(t, weights=times))
    rng = np.random.default_rng(seed)
    rate, weight = 1 / (scale * np.logspace(-1, 1, most)), np.full(most, 1 / most)
    kept = []
    for it in range(draws):
        logs = np.log(weight * rate) - x[:, None] * rate
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        dealt = rng.multinomial(times, p / p.sum(axis=1, keepdims=True))
        n, total = dealt.sum(axis=0), x @ dealt
        weight = np.maximum(rng.dirichlet(concentration + n), 1e-300)
        rate = rng.gamma(1.0 + n) / (scale + total)
        order = np.argsort(-rate)
        rate, weight, n = rate[order], weight[order], n[order]
        if it >= burn:
            used = n >= max(1, share * size)
            kept.append((int(used.sum()), 1 / rate[used], weight[used]))
    count = np.array([k for k, _, _ in kept])
    value, freq = np.unique(count, return_counts=True)
    k = int(value[freq.argmax()])
    taus = np.array([a for c, a, _ in kept if c == k])
    shares = np.array([b / b.sum() for c, _, b in kept if c == k])
    order = np.argsort(taus.mean(axis=0))
    taus, shares, tail = taus[:, order], shares[:, order], (1 - credibility) / 2
    return DwellMixture(k, {int(a): float(b / len(kept)) for a, b in zip(value, freq, strict=True)}, taus.mean(axis=0), np.quantile(taus, tail, axis=0), np.quantile(taus, 1 - tail, axis=0), shares.mean(axis=0), t_min, size)
