"""Change points of one event: exact optimal partition, and Bayesian online detection."""

from __future__ import annotations

import numpy as np

from tracelake.functions.special import gammaln, logsumexp


def optimal_partition(x: np.ndarray, factor: float = 1.5, least: int = 10) -> list[int]:
    """Change points that minimise the sum of n * log variance plus a penalty per segment, exactly.

    Quadratic in the samples of one event, each step over all earlier starts at once.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 * least:
        return []
    beta = 2.0 * factor * np.log(n)
    s1, s2 = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    cost, origin = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    cost[0] = -beta
    for t in range(least, n + 1):
        starts = np.arange(0, min(t - least, t - 2) + 1)
        if not len(starts):
            continue
        size = t - starts
        gap = s1[t] - s1[starts]
        spread = s2[t] - s2[starts] - gap * gap / size
        spread = np.where(spread > 0, spread, 1e-20)
        total = cost[starts] + size * (np.log(spread) - np.log(size)) + beta
        at = int(total.argmin())
        cost[t], origin[t] = total[at], starts[at]
    out, t = [], n
    while t > 0:
        t = int(origin[t])
        if t:
            out.append(t)
    return out[::-1]


def robust_std(x: np.ndarray) -> float:
    """From first differences; short or constant data fall back to the deviation, or 1."""
    if len(x) >= 3:
        d = np.diff(x)
        s = float(np.median(np.abs(d - np.median(d))) / 0.6745 / np.sqrt(2))
        if s > 0:
            return s
    s = float(np.std(x)) if len(x) else 0.0
    return s if s > 0 else 1.0


def join_short(x: np.ndarray, cuts: list[int], least: int) -> list[int]:
    """Cuts without those beside the shortest segment, as long as one is too short; it joins the neighbour of nearer mean."""
    cuts = list(cuts)
    while cuts:
        edges = [0, *cuts, len(x)]
        size = np.diff(edges)
        i = int(size.argmin())
        if size[i] >= least:
            return cuts
        mean = [float(np.mean(x[a:b])) if b > a else 0.0 for a, b in zip(edges, edges[1:], strict=False)]
        if i == 0 or (i < len(size) - 1 and abs(mean[i] - mean[i - 1]) > abs(mean[i] - mean[i + 1])):
            del cuts[i]
        else:
            del cuts[i - 1]
    return cuts


def online(x: np.ndarray, hazard: float, mean: float | None = None, kappa: float = 0.01, alpha: float = 1.0, beta: float | None = None, prune: float = 1e-10, most: int = 500, least: int = 10) -> tuple[list[int], np.ndarray]:
    """(change points, most probable run length at each sample): Adams and MacKay's recursion with a normal-gamma prior.

    The state after each sample is bounded by `most` hypotheses, so the same recursion serves streams.
    """
    x = np.asarray(x, float).ravel()
    if not 0 < hazard < 1:
        raise ValueError("the hazard must lie in (0, 1)")
    if not len(x):
        return [], np.zeros(0, int)
    prior = np.array([[float(np.median(x)) if mean is None else mean], [kappa], [alpha], [alpha * robust_std(x) ** 2 if beta is None else beta]])
    length, weight, state = np.zeros(1, int), np.zeros(1), prior
    best = np.empty(len(x), dtype=int)
    stay, jump = np.log1p(-hazard), np.log(hazard)
    for t, value in enumerate(x):
        m, k, a, b = state
        scale = b * (k + 1) / (a * k)
        fit = gammaln(a + 0.5) - gammaln(a) - 0.5 * np.log(2 * np.pi * a * scale) - (a + 0.5) * np.log1p((value - m) ** 2 / (2 * a * scale))
        joint = weight + fit
        weight = np.append(logsumexp(joint) + jump, joint + stay)
        length = np.append(1, length + 1)
        m, k, a, b = np.hstack([prior, state])
        state = np.array([(k * m + value) / (k + 1), k + 1, a + 0.5, b + k * (value - m) ** 2 / (2 * (k + 1))])
        weight = weight - logsumexp(weight)
        keep = weight > np.log(prune)
        if keep.sum() > most:
            keep = np.zeros(len(weight), bool)
            keep[np.argsort(weight)[-most:]] = True
        length, weight, state = length[keep], weight[keep], state[:, keep]
        best[t] = length[int(weight.argmax())]
    cuts, t = [], len(x) - 1
    while t > 0 and (start := t - int(best[t]) + 1) > 0:
        cuts.append(start)
        t = start - 1
    return join_short(x, cuts[::-1], least), best


def segments(x: np.ndarray, cuts: list[int]) -> list[dict]:
    """Start, end, mean, deviation and size between change points."""
    edges = [0, *cuts, len(x)]
    return [{"start": a, "end": b, "mean": float(np.mean(x[a:b])), "std": float(np.std(x[a:b])), "n": b - a} for a, b in zip(edges, edges[1:], strict=False) if b > a]
