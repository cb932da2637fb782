"""Levels inside one event."""

from __future__ import annotations

import numpy as np

from tracelake.functions.changepoints import online, robust_std
from tracelake.functions.mixtures import fit_levels, scan_em


def label_runs(labels: np.ndarray) -> list[list[int]]:
    """[label, start, end] of each run."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]]) if len(labels) else np.zeros(1, int)
    return [[int(labels[a]), int(a), int(b)] for a, b in zip(edge, edge[1:], strict=False)]


def absorb_short(runs: list[list[int]], least: int, means: np.ndarray) -> list[list[int]]:
    """The shortest run joins the neighbour with the nearer level mean (left on ties), until all are long enough."""
    runs = [list(r) for r in runs]
    while len(runs) > 1:
        size = [r[2] - r[1] for r in runs]
        i = size.index(min(size))
        if size[i] >= least:
            break
        own = means[runs[i][0]]
        go_left = i > 0 and (i == len(runs) - 1 or abs(own - means[runs[i - 1][0]]) <= abs(own - means[runs[i + 1][0]]))
        if go_left:
            runs[i - 1][2] = runs[i][2]
        else:
            runs[i + 1][1] = runs[i][1]
        del runs[i]
    return runs


def join_same(runs: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for r in runs:
        if out and out[-1][0] == r[0]:
            out[-1][2] = r[2]
        else:
            out.append(list(r))
    return out


def _by_changes(x: np.ndarray, step: int, least: int) -> tuple[list[list[int]], np.ndarray] | None:
    """Change-point segments, grouped to levels where sorted neighbours differ by more than four standard errors."""
    thin = x[::step]
    short = max(2, -(-least // step))
    if len(thin) < 2 * short:
        return None
    noise = robust_std(thin)
    cuts, _ = online(thin, min(0.5, 1 / max(len(thin) / 2, 2.0 * short)), beta=noise**2, least=short)
    if not cuts:
        return None
    edges = [0, *(c * step for c in cuts), len(x)]
    runs = [[0, a, b] for a, b in zip(edges, edges[1:], strict=False) if b > a]
    mean = np.array([x[a:b].mean() for _, a, b in runs])
    size = np.array([(b - a) / step for _, a, b in runs])
    order = np.argsort(mean)
    level = np.zeros(len(runs), dtype=int)
    for i, j in zip(order, order[1:], strict=False):
        level[j] = level[i] + (mean[j] - mean[i] > 4 * noise * np.sqrt(1 / size[i] + 1 / size[j]))
    if level.max() == 0:
        return None
    for r, v in zip(runs, level, strict=True):
        r[0] = int(v)
    return runs, np.array([np.average(mean[level == v], weights=size[level == v]) for v in range(level.max() + 1)])


def find_sublevels(x: np.ndarray, start: int, rate: float, cutoff: float | None, method: str = "dpgmm", most: int = 5, least: int = 50, concentration: float | None = None) -> list[dict]:
    """Levels of the event samples x that begin at index `start`; empty if there is one level or too little signal.

    The filter's transients at both ends are left out; level 0 is the lowest current.
    """
    if method not in ("gmm", "dpgmm", "bocpd"):
        raise ValueError(f"unknown method: {method}")
    edge = max(0, int(2.0 * rate / cutoff)) if cutoff else 0
    inner = np.asarray(x, float)[edge : len(x) - edge]
    if len(inner) < 2 * least:
        return []
    k = min(most, len(inner) // least)
    step = max(1, int(rate / (2.0 * cutoff))) if cutoff else 1
    if method == "gmm":
        m, _ = scan_em(inner, k)
        found = (label_runs(m.predict(inner)), m.means) if len(m.means) > 1 else None
    elif method == "dpgmm":
        thin = inner[::step]
        fit = fit_levels(thin, k, concentration, least_count=max(2.0, least / step)) if len(thin) >= 4 else None
        found = (label_runs(fit.predict(inner)), fit.means) if fit is not None and len(fit.means) > 1 else None
    else:
        found = _by_changes(inner, step, least)
    if found is None:
        return []
    runs, means = found
    runs = join_same(absorb_short(runs, least, means))
    if len(runs) < 2:
        return []
    ranked = np.sort(means)
    out = []
    for label, a, b in runs:
        part = inner[a:b]
        first, last = start + edge + a, start + edge + b
        out.append({"start_idx": first, "end_idx": last, "start_time": first / rate, "end_time": last / rate, "duration": (last - first) / rate, "mean_current": float(part.mean()), "std_current": float(part.std()), "level_index": int(np.abs(ranked - means[label]).argmin())})
    return out
