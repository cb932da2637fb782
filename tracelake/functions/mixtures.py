"""Gaussian mixtures: EM with information criteria, and variational Dirichlet-process mixtures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tracelake.functions.special import digamma, gammaln, logsumexp


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    stds: np.ndarray
    log_likelihood: float = 0.0

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        z = (np.asarray(x, float)[:, None] - self.means) / self.stds
        return np.log(self.weights) - 0.5 * z * z - np.log(self.stds) - 0.5 * np.log(2 * np.pi)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.log_parts(x).argmax(axis=1)


def seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k starting centres (rows of x): each next one drawn by squared distance."""
    centres = [x[rng.integers(len(x))]]
    d = ((x - centres[0]) ** 2).sum(axis=1)
    for _ in range(1, k):
        total = d.sum()
        i = rng.choice(len(x), p=d / total) if total > 0 else rng.integers(len(x))
        centres.append(x[i])
        d = np.minimum(d, ((x - x[i]) ** 2).sum(axis=1))
    return np.array(centres)


def fit_em(x: np.ndarray, k: int, starts: int = 3, steps: int = 200, seed: int = 0) -> Mixture:
    """Best of several EM runs on one-dimensional data."""
    x = np.asarray(x, float)
    best = None
    floor = 1e-6 + 1e-9 * x.var()
    for s in range(starts):
        rng = np.random.default_rng([seed, k, s])
        means = seeds(x[:, None], k, rng)[:, 0]
        label = abs(x[:, None] - means).argmin(axis=1)
        resp = np.eye(k)[label]
        before = -np.inf
        for _ in range(steps):
            n = resp.sum(axis=0) + 1e-12
            means = resp.T @ x / n
            var = np.maximum((resp * (x[:, None] - means) ** 2).sum(axis=0) / n, 0) + floor
            m = Mixture(n / n.sum(), means, np.sqrt(var))
            parts = m.log_parts(x)
            norm = logsumexp(parts, axis=1)
            resp = np.exp(parts - norm[:, None])
            m.log_likelihood = float(norm.sum())
            if abs(m.log_likelihood - before) < 1e-3 * len(x):
                if abs(m.log_likelihood - before) < 1e-6 * len(x):
                    break
            before = m.log_likelihood
        if best is None or m.log_likelihood > best.log_likelihood:
            best = m
    return best


def scan_em(x: np.ndarray, most: int, criterion: str = "bic", seed: int = 0) -> tuple[Mixture, list[float]]:
    """(mixture with the least criterion, criteria for 1 to `most` components)."""
    if criterion not in ("bic", "aic"):
        raise ValueError(f"unknown criterion: {criterion}")
    found, marks = [], []
    for k in range(1, min(most, len(x)) + 1):
        m = fit_em(x, k, seed=seed)
        free = 3 * k - 1
        marks.append(-2 * m.log_likelihood + free * (np.log(len(x)) if criterion == "bic" else 2))
        found.append(m)
    return found[int(np.argmin(marks))], marks


@dataclass
class VariationalFit:
    """Posterior of a truncated Dirichlet-process mixture of d-dimensional Gaussians."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    resp: np.ndarray
    bound: float
    log_parts: object


def fit_dirichlet_process(x: np.ndarray, k: int, concentration: float | None = None, steps: int = 300, starts: int = 1, seed: int = 0) -> VariationalFit:
    """Mean-field updates of stick-breaking weights and normal-Wishart components."""
    x = np.asarray(x, float)
    x = x[:, None] if x.ndim == 1 else x
    n, d = x.shape
    k = max(1, min(k, n))
    alpha = 1.0 / k if concentration is None else concentration
    m0, b0, v0 = x.mean(axis=0), 1.0, float(d)
    w0 = np.atleast_2d(np.cov(x, rowvar=False, bias=False)) if n > 1 else np.eye(d)
    w0 = w0 + 1e-9 * np.eye(d)
    ridge = 1e-6 * np.eye(d)
    best = None
    for s in range(starts):
        rng = np.random.default_rng([seed, s])
        centres = seeds(x, k, rng)
        resp = np.eye(k)[((x[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)]
        before = -np.inf
        for _ in range(steps):
            nk = resp.sum(axis=0) + 1e-10
            mean = resp.T @ x / nk[:, None]
            g1, g2 = 1 + nk, alpha + np.concatenate([np.cumsum(nk[::-1])[-2::-1], [0.0]])
            b, v = b0 + nk, v0 + nk
            m = (b0 * m0 + nk[:, None] * mean) / b[:, None]
            scatter = np.empty((k, d, d))
            for j in range(k):
                off = x - mean[j]
                dm = mean[j] - m0
                scatter[j] = w0 + (resp[:, j, None] * off).T @ off + b0 * nk[j] / b[j] * np.outer(dm, dm) + nk[j] * ridge
            cov = scatter / v[:, None, None]
            chol = np.linalg.cholesky(cov)
            stick = digamma(g1) - digamma(g1 + g2)
            rest = digamma(g2) - digamma(g1 + g2)
            log_w = stick + np.concatenate([[0.0], np.cumsum(rest[:-1])])
            log_det = -2 * np.log(np.diagonal(chol, axis1=1, axis2=2)).sum(axis=1) - d * np.log(v)
            log_det = log_det + d * np.log(2) + sum(digamma(0.5 * (v - i)) for i in range(d))

            def parts(y, m=m, chol=chol, log_w=log_w, log_det=log_det, b=b):
                out = np.empty((len(y), k))
                for j in range(k):
                    z = np.linalg.solve(chol[j], (y - m[j]).T)
                    out[:, j] = log_w[j] + 0.5 * (log_det[j] - d * np.log(2 * np.pi) - (z * z).sum(axis=0) - d / b[j])
                return out

            logs = parts(x)
            norm = logsumexp(logs, axis=1)
            resp = np.exp(logs - norm[:, None])
            bound = float(norm.sum() / n)
            if abs(bound - before) < 1e-6:
                break
            before = bound
        sticks = g1 / (g1 + g2)
        weights = sticks * np.concatenate([[1.0], np.cumprod(1 - sticks[:-1])])
        # what a point adds to the bound, less the price of each component in use
        score = float(norm.sum() - (gammaln(0.5 * v0 + 1) * 0) - 0.5 * (nk > 1).sum() * np.log(n))
        if best is None or score > best.bound:
            best = VariationalFit(weights / weights.sum(), m, cov, resp, score, parts)
    return best


@dataclass
class Levels:
    """One-dimensional fit: components pruned, and those merged that have no dip between them; means ascend."""

    weights: np.ndarray
    means: np.ndarray
    stds: np.ndarray
    groups: list[list[int]]
    fit: VariationalFit

    def predict(self, x: np.ndarray) -> np.ndarray:
        logs = self.fit.log_parts(np.asarray(x, float)[:, None])
        resp = np.exp(logs - logs.max(axis=1, keepdims=True))
        return np.column_stack([resp[:, g].sum(axis=1) for g in self.groups]).argmax(axis=1)


def without_dip(a: tuple[float, float, float], b: tuple[float, float, float], points: int = 200) -> bool:
    """Whether two weighted Gaussians (weight, mean, variance) add up to a curve with no dip between their means."""
    if a[1] == b[1]:
        return True
    at = np.linspace(a[1], b[1], points)
    curve = sum(w / np.sqrt(v) * np.exp(-((at - m) ** 2) / (2 * v)) for w, m, v in (a, b))
    return bool(curve.min() >= (1 - 1e-6) * min(curve[0], curve[-1]))


def fit_levels(x: np.ndarray, most: int = 10, concentration: float | None = None, least_count: float = 5.0, least_weight: float = 0.0, seed: int = 0, steps: int = 300) -> Levels:
    x = np.asarray(x, float).ravel()
    if len(x) < 2:
        raise ValueError("at least two samples are needed")
    fit = fit_dirichlet_process(x, most, concentration, steps, seed=seed)
    ok = (fit.weights * len(x) >= least_count) & (fit.weights >= least_weight)
    used = np.flatnonzero(ok) if ok.any() else np.array([int(fit.weights.argmax())])
    used = used[np.argsort(fit.means[used, 0], kind="stable")]
    parts = [([int(i)], (float(fit.weights[i]), float(fit.means[i, 0]), float(fit.covariances[i, 0, 0]))) for i in used]
    at = 0
    while at < len(parts) - 1:
        (ga, a), (gb, b) = parts[at], parts[at + 1]
        if without_dip(a, b):
            w = a[0] + b[0]
            m = (a[0] * a[1] + b[0] * b[1]) / w
            v = (a[0] * (a[2] + (a[1] - m) ** 2) + b[0] * (b[2] + (b[1] - m) ** 2)) / w
            parts[at : at + 2] = [(ga + gb, (w, m, v))]
            at = 0
        else:
            at += 1
    w = np.array([p[0] for _, p in parts])
    return Levels(w / w.sum(), np.array([p[1] for _, p in parts]), np.sqrt([p[2] for _, p in parts]), [g for g, _ in parts], fit)


def baseline_component(means, weights, least: float = 0.05) -> int:
    """Component with the mean nearest to 0 among those of some weight, else among all."""
    means, weights = np.asarray(means), np.asarray(weights)
    usable = np.flatnonzero(weights >= least)
    usable = usable if len(usable) else np.arange(len(means))
    return int(usable[np.abs(means[usable]).argmin()])


def gaussian_crossing(m1: float, s1: float, w1: float, m2: float, s2: float, w2: float) -> float:
    """Where two weighted Gaussians are equal: the root between the means, nearest to their middle; the middle if none."""
    mid = (m1 + m2) / 2
    if abs(s1 - s2) < 1e-10:
        return mid if abs(m1 - m2) < 1e-10 else float(mid + s1 * s1 / (m1 - m2) * np.log(w2 / w1))
    p, q = 1 / (s1 * s1), 1 / (s2 * s2)
    a, b = (q - p) / 2, m1 * p - m2 * q
    c = (m2 * m2 * q - m1 * m1 * p) / 2 + np.log(w1 * s2 / (w2 * s1))
    under = b * b - 4 * a * c
    if under < 0:
        return mid
    roots = [(-b + np.sqrt(under)) / (2 * a), (-b - np.sqrt(under)) / (2 * a)]
    between = [r for r in roots if min(m1, m2) <= r <= max(m1, m2)]
    return float(min(between or roots, key=lambda r: abs(r - mid)))


def mixture_threshold(means, stds, weights, base: int) -> float:
    """Crossing with the nearest component below the baseline's (else the nearest at all); alone: five deviations below."""
    others = [i for i in range(len(means)) if i != base]
    if not others:
        return float(means[base] - 5 * stds[base])
    lower = [i for i in others if means[i] < means[base]]
    near = max(lower, key=lambda i: means[i]) if lower else min(others, key=lambda i: abs(means[i] - means[base]))
    return gaussian_crossing(means[base], stds[base], weights[base], means[near], stds[near], weights[near])


@dataclass
class Threshold:
    value: float
    means: np.ndarray
    stds: np.ndarray
    weights: np.ndarray
    base: int
    criteria: list[float]


def determine_threshold(x: np.ndarray, method: str = "dpgmm", most: int = 10, criterion: str = "bic", concentration: float | None = None, seed: int = 0) -> Threshold:
    if method == "gmm":
        m, marks = scan_em(x, most, criterion, seed)
        weights, means, stds = m.weights, m.means, m.stds
    elif method == "dpgmm":
        fit, marks = fit_levels(x, most, concentration, least_count=max(10.0, 1e-4 * len(x)), seed=seed), []
        weights, means, stds = fit.weights, fit.means, fit.stds
    else:
        raise ValueError(f"unknown method: {method}")
    base = baseline_component(means, weights)
    return Threshold(mixture_threshold(means, stds, weights, base), means, stds, weights, base, marks)
