"""Sticky hierarchical Dirichlet-process hidden Markov model, after Fox, Sudderth, Jordan and Willsky (2011).

The weak-limit sampler with a truncated number of states. One sweep draws, in turn: the tables of the restaurant franchise with
the override of self-transitions, the shared weights, the transition rows, the emissions (normal with a normal
inverse-gamma prior), and the whole path by backward messages and forward sampling.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np

from tracelake.functions.changepoints import robust_std
from tracelake.functions.hmm import States, emission, viterbi

TINY = 1e-12


@dataclass(frozen=True)
class Prior:
    """Concentrations of rows and of shared weights, extra mass of self-transitions, and the emissions' hyperparameters but for their
    center and scale, which are each event's own."""

    row: float
    shared: float
    stay: float
    strength: float = 0.01
    shape: float = 1.0


def _normal_rows(a: np.ndarray) -> np.ndarray:
    return a / a.sum(axis=-1, keepdims=True)


def transition_counts(path: np.ndarray, states: int) -> np.ndarray:
    return np.bincount(path[:-1] * states + path[1:], minlength=states * states).reshape(states, states)


def _gammas(shape: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Gamma draws (Marsaglia and Tsang) of shapes (..., events); proposals are the same for every event."""
    common = (*shape.shape[:-1], 1)
    lift = rng.random(common)
    d = np.where(shape < 1, shape + 1, shape) - 1 / 3
    c, out, open_ = 1 / np.sqrt(9 * d), np.empty_like(d), np.ones(d.shape, bool)
    while open_.any():
        z, u = rng.standard_normal(common), np.log(rng.random(common))
        v = (1 + c * z) ** 3
        ok = open_ & (v > 0) & (u < 0.5 * z * z + d - d * v + d * np.log(np.maximum(v, 1e-300)))
        out[ok] = (d * v)[ok]
        open_ &= ~ok
    return np.where(shape < 1, out * lift ** (1 / np.minimum(shape, 1)), out)


class Lot:
    """Events that are sampled side by side, the longest first; arrays have the events as their last axis.

    Each sweep's random numbers come from generators of their own, seeded by sweep and purpose, and every event takes their
    first ones. So an event has the same draws in whatever lot it is.
    """

    def __init__(self, events: list[np.ndarray], states: int, prior: Prior, centers: np.ndarray, scales: np.ndarray):
        self.k, self.e, self.prior, self.centers, self.scales = states, len(events), prior, centers, scales
        self.n = np.array([len(x) for x in events])
        self.live = np.searchsorted(-self.n, -np.arange(self.n[0]), side="left")  # events longer than t
        self.x = np.zeros((self.n[0], self.e))
        self.path = np.zeros((self.n[0], self.e), dtype=np.int64)
        for i, x in enumerate(events):
            self.x[: len(x), i] = x
            self.path[: len(x), i] = np.searchsorted(np.quantile(x, np.arange(1, states) / states), x)
        self.here = np.arange(self.n[0])[:, None] < self.n
        self.where = np.broadcast_to(np.arange(self.e), self.x.shape)
        self.weights = np.full((states, self.e), 1.0 / states)

    def counts(self) -> np.ndarray:
        """(from, to, events)."""
        cell = (self.path[:-1] * self.k + self.path[1:]) * self.e + self.where[1:]
        return np.bincount(cell[self.here[1:]], minlength=self.k * self.k * self.e).reshape(self.k, self.k, self.e)

    def tables(self, counts: np.ndarray, one: np.random.Generator, two: np.random.Generator) -> np.ndarray:
        """Tables that serve each state's dish in each restaurant, without those that the self-transition mass accounts for."""
        k, e, prior = self.k, self.e, self.prior
        mass = np.moveaxis(prior.row * self.weights + prior.stay * np.eye(k)[:, :, None], 2, 0).ravel()
        many = np.moveaxis(counts, 2, 0).ravel()
        cell, begin = np.repeat(np.arange(e * k * k), many), np.cumsum(many) - many
        at = np.arange(len(cell))
        customer, place = at - begin[cell], at - (np.cumsum(self.n - 1) - (self.n - 1))[cell // (k * k)]
        opened = one.random(int(self.n[0]) - 1)[place] < mass[cell] / (mass[cell] + customer)
        found = np.moveaxis(np.bincount(cell, opened, e * k * k).astype(int).reshape(e, k, k), 0, 2)
        own, share = np.einsum("iie->ie", found), prior.stay / (prior.stay + prior.row)
        chance, lots = share / (share + self.weights * (1.0 - share)), two.random((int(own.max()), k))
        overridden = np.zeros_like(own)
        for i, u in enumerate(lots):
            overridden += (i < own) & (u[:, None] < chance)
        return found.sum(axis=0) - overridden

    def emissions(self, one: np.random.Generator, two: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(means, variances) from the posterior of every state; empty states draw from the prior."""
        prior, size = self.prior, (self.k, self.e)
        cell, x = (self.path * self.e + self.where)[self.here], self.x[self.here]
        n = np.bincount(cell, minlength=self.k * self.e)
        average = np.bincount(cell, x, self.k * self.e) / np.maximum(n, 1)
        within = np.bincount(cell, (x - average[cell]) ** 2, self.k * self.e).reshape(size)
        n, average = n.reshape(size), average.reshape(size)
        strength = prior.strength + n
        between = prior.strength * n / strength * (average - self.centers) ** 2
        variances = (self.scales**2 + (within + between) / 2) / _gammas(prior.shape + n / 2, one)
        middle = (prior.strength * self.centers + n * average) / strength
        return middle + two.standard_normal((self.k, 1)) * np.sqrt(variances / strength), variances

    def sample_path(self, logs: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> None:
        """Paths given everything else: messages from the end, then states from the start."""
        ahead = np.exp(logs - logs.max(axis=1, keepdims=True))
        message, draw = np.ones((self.k, self.e)), rng.random(len(ahead))
        for t in range(len(ahead) - 1, -1, -1):
            m = self.live[t]
            now = ahead[t, :, :m]
            now *= message[:, :m]
            got = (rows[:, :, :m] * now).sum(axis=1)
            got /= got.max(axis=0)
            message[:, :m] = got
        chance, every, by_event = self.weights, np.arange(self.e), np.ascontiguousarray(np.moveaxis(rows, 2, 0))
        for t, m in enumerate(self.live):
            ladder = (chance[:, :m] * ahead[t, :, :m]).cumsum(axis=0)
            state = np.minimum((ladder <= draw[t] * ladder[-1]).sum(axis=0), self.k - 1)
            self.path[t, :m] = state
            chance = by_event[every[:m], state].T

    def sweep(self, rngs: list[np.random.Generator]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(means, variances, rows, joint log-densities of paths and signals)."""
        prior, eye = self.prior, np.eye(self.k)[:, :, None]
        counts = self.counts()
        served = self.tables(counts, rngs[0], rngs[1])
        weights = np.maximum(_gammas(prior.shared / self.k + served, rngs[2]), TINY)
        self.weights = weights / weights.sum(axis=0)
        rows = np.maximum(_gammas(prior.row * self.weights + prior.stay * eye + counts, rngs[3]), TINY)
        rows /= rows.sum(axis=1, keepdims=True)
        means, variances = self.emissions(rngs[4], rngs[5])
        logs = -0.5 * (np.log(2 * np.pi * variances) + (self.x[:, None] - means) ** 2 / variances)
        self.sample_path(logs, rows, rngs[6])
        own = np.take_along_axis(logs, self.path[:, None], 1)[:, 0]
        moves = np.log(rows)[self.path[:-1], self.path[1:], self.where[1:]]
        return means, variances, rows, (own * self.here).sum(axis=0) + (moves * self.here[1:]).sum(axis=0)

    def best(self, draws: int, burn: int, least: int, seed: int) -> list[tuple[Counter, np.ndarray, np.ndarray, np.ndarray, float]]:
        """(votes per number of used states, means, variances and rows of the used states, density) of each event: of the draws
        after `burn` with the most frequent number the densest. A state is used from `least` samples on (the largest one if
        none has)."""
        k, e = self.k, self.e
        votes, density = np.zeros((k + 1, e), int), np.full((k + 1, e), -np.inf)
        means, variances, rows, used = np.empty((k + 1, k, e)), np.empty((k + 1, k, e)), np.empty((k + 1, k, k, e)), np.zeros((k + 1, k, e), bool)
        for sweep in range(draws):
            drawn = self.sweep([np.random.default_rng([seed, sweep, purpose]) for purpose in range(7)])
            if sweep < burn:
                continue
            size = np.bincount((self.path * e + self.where)[self.here], minlength=k * e).reshape(k, e)
            some = size >= np.minimum(least, size.max(axis=0))
            number = some.sum(axis=0)
            votes[number, np.arange(e)] += 1
            at = np.flatnonzero(drawn[3] > density[number, np.arange(e)])
            for kept, new in ((means, drawn[0]), (variances, drawn[1]), (rows, drawn[2]), (used, some), (density, drawn[3])):
                kept[number[at], ..., at] = np.moveaxis(new[..., at], -1, 0)
        out = []
        for i, number in enumerate(votes.argmax(axis=0)):  # the smaller one of a tie
            u = np.flatnonzero(used[number, :, i])
            out.append((Counter({n: int(c) for n, c in enumerate(votes[:, i]) if c}), means[number, u, i], variances[number, u, i], rows[number][np.ix_(u, u, [i])][:, :, 0], float(density[number, i])))
        return out


def described(full: np.ndarray, path: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(path numbered by ascending mean, means, deviations, transition shares) of a labelled signal."""
    seen, path = np.unique(path, return_inverse=True)
    n = np.bincount(path)
    means = np.bincount(path, full) / n
    rank = means.argsort().argsort()
    path, means = rank[path], np.sort(means)
    deviations = np.sqrt(np.bincount(path, (full - means[path]) ** 2) / np.bincount(path))
    moves = transition_counts(path, len(seen)).astype(float)
    moves += np.diag(moves.sum(axis=1) == 0)  # a state that is only met at the end stays
    return path, means, np.where(deviations > 0, deviations, noise), _normal_rows(moves)


#: Samples, those that fill up shorter events among them, of events that are sampled side by side.
SIDE_BY_SIDE = 1 << 18


def states_sticky_many(events: list[np.ndarray], rate: float = 1.0, step: int = 1, most: int = 8, alpha: float = 1.0, gamma: float = 1.0, kappa: float | None = None, draws: int = 300, burn: int = 150, least: int = 50, seed: int = 0) -> list[States | None]:
    """Hidden states of each event, their number inferred; None for fewer than ten samples (or five after thinning).

    Every `step`-th sample is taken (the step of an oversampled filter, by which samples are independent), whatever the length;
    a state counts as used from `least` samples on. Of the sweeps with the most frequent number of used states (the smaller one
    of a tie) the densest is decoded once more with Viterbi.
    """
    full = [np.asarray(x, float).ravel() for x in events]
    thin = [x[::step] for x in full]
    enough = max(1, -(-least // step))
    stay = alpha * (max(2.0, enough) - 1.0) if kappa is None else kappa
    out: list[States | None] = [None] * len(full)
    order = sorted((i for i in range(len(full)) if len(full[i]) >= 10 and len(thin[i]) >= 5), key=lambda i: -len(thin[i]))
    while order:
        lot = order[: max(1, SIDE_BY_SIDE // len(thin[order[0]]))]
        order = order[len(lot) :]
        own = [thin[i] for i in lot]
        noise = np.array([robust_std(x) for x in own])
        found = Lot(own, most, Prior(alpha, gamma, stay), np.array([np.median(x) for x in own]), noise).best(draws, burn, enough, seed)
        for i, x, off, (votes, means, variances, rows, density) in zip(lot, own, noise, found, strict=True):
            rough = viterbi(emission(x, means, variances), _normal_rows(rows))
            path, levels, deviations, shares = described(full[i], np.repeat(rough, step)[: len(full[i])], off)
            out[i] = States(levels, deviations, shares, path, density, float("nan"), "sticky_hdp", {k: votes[k] / votes.total() for k in sorted(votes)})
    return out


def states_sticky(x: np.ndarray, rate: float = 1.0, step: int = 1, **settings) -> States | None:
    """As states_sticky_many, of one event."""
    return states_sticky_many([x], rate, step, **settings)[0]
