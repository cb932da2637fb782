"""Signals with known events, for tests and benchmarks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tracelake.functions.filters import digital


@dataclass
class Planted:
    """An event: when it starts, and its levels as (seconds, current)."""

    start: float
    levels: list[tuple[float, float]]

    @property
    def duration(self) -> float:
        return sum(d for d, _ in self.levels)


@dataclass
class Signal:
    values: np.ndarray
    rate: float
    events: list[Planted] = field(default_factory=list)

    def truth(self) -> list[tuple[int, int, int]]:
        """(start, end, levels) of each event in samples."""
        return [(round(e.start * self.rate), round((e.start + e.duration) * self.rate), len(e.levels)) for e in self.events]


def power_law_noise(n: int, exponent: float, rng: np.random.Generator) -> np.ndarray:
    """Noise with a spectrum of 1 / f ** exponent, of unit deviation."""
    f = np.fft.rfftfreq(n)
    f[0] = f[1] if n > 1 else 1.0
    x = np.fft.irfft((rng.normal(size=len(f)) + 1j * rng.normal(size=len(f))) / f ** (exponent / 2), n)
    return x / (x.std() or 1.0)


def causal(x: np.ndarray, kind: str, order: int, cutoff: float, rate: float) -> np.ndarray:
    """One forward pass of the filter (half power at the cutoff for Bessel), by FFT of its impulse response."""
    from tracelake.functions.filters import impulse_response

    h = impulse_response(*digital(kind, order, cutoff, rate, "mag"))
    n = 1 << (len(x) + len(h) - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, n) * np.fft.rfft(h, n), n)[: len(x)]


def generate(seconds: float, rate: float = 100_000.0, open_level: float = 200.0, white: float = 5.0, pink: float = 2.0, events: list[Planted] | None = None, drift: float = 0.0, hum: float = 0.0, bandwidth: float | None = None, seed: int = 42) -> Signal:
    """Open level, drift, planted events, filter, then noise."""
    n = int(seconds * rate)
    t = np.arange(n) / rate
    x = open_level + drift * t
    for e in events or []:
        at = e.start
        for length, current in e.levels:
            a, b = round(at * rate), round((at + length) * rate)
            x[a:b] = current + drift * t[a:b]
            at += length
    if bandwidth:
        x = open_level + causal(x - open_level, "bessel", 4, bandwidth, rate)
    rng = np.random.default_rng(seed)
    x = x + white * rng.normal(size=n) + (pink * power_law_noise(n, 1.0, rng) if pink else 0.0)
    if hum:
        x = x + hum * np.sin(2 * np.pi * 50.0 * t)
    return Signal(x, rate, list(events or []))


def poisson_train(seconds: float, per_second: float, depths: tuple[float, ...] = (60.0,), dwell: float = 1e-3, open_level: float = 200.0, gap: float = 2e-3, seed: int = 0) -> list[Planted]:
    """Events at random times with log-normal dwell times and one level per depth."""
    rng = np.random.default_rng(seed)
    at, out = gap, []
    while True:
        at += rng.exponential(1 / per_second)
        levels = [(dwell * float(np.exp(0.5 * rng.normal())), open_level - d) for d in depths]
        if at + sum(d for d, _ in levels) + gap > seconds:
            return out
        out.append(Planted(at, levels))
        at += sum(d for d, _ in levels) + gap


def scenario(name: str, rate: float = 100_000.0, seed: int = 42) -> Signal:
    """Named test signals on a 200 pA open level."""
    half = [(0.01, 100.0)]

    def spaced(n: int, seconds: float, levels) -> list[Planted]:
        return [Planted((k + 1) * seconds / (n + 1), levels(k)) for k in range(n)]

    if name == "basic":
        return generate(10, rate, events=spaced(4, 10, lambda k: half), seed=seed)
    if name == "variable_depth":
        return generate(10, rate, events=spaced(5, 10, lambda k: [(0.01, 200.0 * (1 - d)) for d in ((0.1, 0.3, 0.5, 0.7, 0.9)[k],)]), seed=seed)
    if name == "multilevel":
        return generate(8, rate, events=spaced(3, 8, lambda k: [(0.01, 140.0 - 40.0 * j) for j in range(k + 2)]), seed=seed)
    if name == "drift":
        return generate(20, rate, events=spaced(6, 20, lambda k: half), drift=2.0, seed=seed)
    if name == "high_noise":
        return generate(8, rate, white=15.0, pink=8.0, events=spaced(3, 8, lambda k: half), seed=seed)
    if name == "dense":
        return generate(8, rate, events=[Planted(0.2 * (k + 1), half) for k in range(30)], seed=seed)
    if name == "short_events":
        return generate(8, rate, events=spaced(5, 8, lambda k: [((2e-4, 5e-4, 1e-3, 2e-3, 5e-3)[k], 100.0)]), seed=seed)
    raise ValueError(f"unknown scenario: {name}")
