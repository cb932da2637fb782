import numpy as np
import pytest

from tracelake.config import DetectionConfig, suggest_config
from tracelake.functions import bayes, changepoints, hmm, mixtures, special, sticky
from tracelake.functions.filters import zero_phase_kernel
from tracelake.functions.sublevels import absorb_short, find_sublevels, join_same


def rng(s):
    return np.random.default_rng(s)


def test_filter_kernel_is_symmetric_and_passes_dc():
    for kind in ("bessel", "butterworth"):
        k = zero_phase_kernel(kind, 4, 0.1, 1.0)
        assert k.sum() == pytest.approx(1) and np.allclose(k, k[::-1])
    with pytest.raises(ValueError):
        zero_phase_kernel("bessel", 4, 0.6, 1.0)
    with pytest.raises(ValueError):
        zero_phase_kernel("other", 4, 0.1, 1.0)


def test_filter_equals_forward_backward_pass():
    from tracelake.functions.filters import digital

    b, a = digital("bessel", 4, 0.1, 1.0)

    def once(x):
        y = np.zeros_like(x)
        for i in range(len(x)):
            y[i] = sum(b[j] * x[i - j] for j in range(len(b)) if i >= j) - sum(a[j] * y[i - j] for j in range(1, len(a)) if i >= j)
        return y

    x = np.zeros(801)
    x[400] = 1.0
    both = once(once(x)[::-1])[::-1]
    k = zero_phase_kernel("bessel", 4, 0.1, 1.0)
    h = len(k) // 2
    assert np.allclose(both[400 - h : 401 + h], k, atol=1e-10)


def test_crossing_rules():
    assert mixtures.gaussian_crossing(0, 1, 0.5, -10, 1, 0.5) == pytest.approx(-5)
    assert mixtures.gaussian_crossing(2, 1, 0.5, 2, 1, 0.5) == 2
    x = mixtures.gaussian_crossing(0, 1, 0.9, -10, 2, 0.1)
    assert -10 < x < 0
    assert mixtures.gaussian_crossing(-10, 2, 0.1, 0, 1, 0.9) == pytest.approx(x)


def test_process_mixture_counts_components():
    one = mixtures.fit_levels(rng(0).normal(size=3000), 10)
    assert len(one.means) == 1
    two = mixtures.fit_levels(np.concatenate([rng(1).normal(size=2000), rng(2).normal(-20, 1, 500)]), 10)
    assert len(two.means) == 2 and np.allclose(two.means, [-20, 0], atol=0.3)


def test_threshold_between_components():
    x = np.concatenate([rng(3).normal(size=20_000), rng(4).normal(-30, 1.5, 600)])
    for method in ("dpgmm", "gmm"):
        t = mixtures.determine_threshold(x, method, 4)
        assert -30 < t.value < -3 and abs(t.means[t.base]) < 0.5
    with pytest.raises(ValueError):
        mixtures.determine_threshold(x, "other")


def test_exact_partition():
    assert len(changepoints.optimal_partition(np.concatenate([np.zeros(500), np.ones(500)]) + rng(0).normal(0, 0.1, 1000))) == 1
    three = np.concatenate([np.zeros(300), np.full(400, 5.0), np.ones(300)]) + rng(1).normal(0, 0.3, 1000)
    assert np.allclose(changepoints.optimal_partition(three), [300, 700], atol=2)
    assert changepoints.optimal_partition(np.zeros(15), least=10) == []


def test_online_change_points():
    x = np.concatenate([rng(0).normal(size=300), rng(1).normal(6, 1, 300)])
    cuts, length = changepoints.online(x, 1 / 300)
    assert len(cuts) == 1 and abs(cuts[0] - 300) <= 3 and len(length) == 600
    assert changepoints.online(rng(2).normal(size=300), 1 / 300)[0] == []
    assert changepoints.online(np.zeros(0), 0.1)[0] == []


def test_hidden_states():
    x = np.concatenate([rng(0).normal(0, 2, 250), rng(1).normal(-50, 2, 250)])
    s = hmm.states_by_criterion(x, 4)
    assert len(s.means) == 2 and np.allclose(s.transitions.sum(axis=1), 1)
    assert hmm.states_by_criterion(np.zeros(5)) is None
    x = np.concatenate([rng(k).normal(-10.0 * (k % 2), 1, 250) for k in range(8)])
    s = sticky.states_sticky(x, 10_000, most=5, draws=120, burn=60)
    assert len(s.means) == 2 and np.allclose(s.means, [-10, 0], atol=0.5)
    assert np.mean([d.mean() for d in s.dwell_times(10_000)]) == pytest.approx(0.025, rel=0.1)


def test_sticky_states_of_many_events():
    """Each event has the states that it has alone; no sample of a long one is passed over."""
    made = [np.concatenate([rng(9 * n + k).normal(-10.0 * (k % 2), 1, 30 + 7 * n) for k in range(4)]) for n in range(5)] + [np.zeros(4)]
    many = sticky.states_sticky_many(made, most=4, draws=60, burn=30, least=20)
    assert many[-1] is None and [len(s.means) for s in many[:-1]] == [2] * 5
    for x, s in zip(made[:-1], many, strict=False):
        one = sticky.states_sticky(x, most=4, draws=60, burn=30, least=20)
        assert np.array_equal(one.path, s.path) and np.allclose(one.means, s.means) and one.log_likelihood == pytest.approx(s.log_likelihood)
    x = rng(3).normal(0, 1, 9001)
    x[4501:] += 20.0  # of every three samples one would be looked at
    s = sticky.states_sticky(x, most=2, draws=6, burn=3)
    assert len(s.means) == 2 and np.array_equal(s.path, np.arange(9001) >= 4501)


def test_sublevels():
    def signal(levels):
        return np.concatenate([np.full(2000, v) for v in levels]) + rng(5).normal(0, 1, 2000 * len(levels))

    for method in ("dpgmm", "gmm"):
        found = find_sublevels(signal([50.0, 20.0]), 1000, 10_000, 1000, method)
        assert len(found) == 2 and abs(found[0]["end_idx"] - 3000) <= 20
    assert [s["level_index"] for s in find_sublevels(signal([50.0, 20.0, 50.0]), 0, 10_000, 1000)] == [1, 0, 1]
    assert find_sublevels(np.zeros(30), 0, 10_000, 1000) == []
    assert absorb_short([[0, 0, 10], [1, 10, 12], [0, 12, 30]], 5, np.array([0.0, 9.0])) == [[0, 0, 12], [0, 12, 30]]
    assert join_same([[0, 0, 12], [0, 12, 30]]) == [[0, 0, 30]]


def test_posteriors():
    p = bayes.capture_rate(100, 10.0)
    assert p["mean"] == pytest.approx(10.05) and (p["upper"] - p["lower"]) / p["mean"] == pytest.approx(0.39, abs=0.05)
    one = bayes.dwell_mixture(1e-4 + rng(0).exponential(1e-3, 400), draws=600, burn=200)
    assert one.n_components == 1
    two = bayes.dwell_mixture(np.concatenate([rng(1).exponential(1e-4, 400), rng(2).exponential(1e-2, 400)]), draws=600, burn=200)
    assert two.n_components == 2 and np.allclose(two.tau_mean, [1e-4, 1e-2], rtol=0.3)
    with pytest.raises(ValueError):
        bayes.capture_rate(1, 0)


def test_dwell_mixture_of_counted_durations():
    """Counts stand for repeated durations; millions of them take no longer than a few."""
    t = np.round(np.concatenate([rng(1).exponential(2.0, 400), rng(2).exponential(200.0, 400)])) + 1
    value, count = np.unique(t, return_counts=True)
    rows, counted = bayes.dwell_mixture(t, draws=600, burn=200), bayes.dwell_mixture(value, draws=600, burn=200, counts=count)
    assert rows.n_events == counted.n_events == 800 and rows.n_components == counted.n_components == 2
    assert np.array_equal(rows.tau_mean, counted.tau_mean) and np.array_equal(rows.weights, counted.weights)
    many = bayes.dwell_mixture(value, draws=600, burn=200, counts=count * 100_000)
    assert many.n_events == 80_000_000 and np.allclose(many.tau_mean[[0, -1]], rows.tau_mean, rtol=0.5)


def test_special_functions():
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.gamma_cdf(special.gamma_quantile(0.3, 2.5, 1.0), 2.5) == pytest.approx(0.3)
    assert special.logsumexp(np.array([0.0, 0.0])) == pytest.approx(np.log(2))


def test_settings():
    c = DetectionConfig.from_settings({"baseline_window_sec": "2.5", "filter_order": "6", "merge_gap_sec": "", "nonsense": 1})
    assert c.baseline_window_sec == 2.5 and c.filter_order == 6 and c.merge_gap_sec is None
    assert DetectionConfig().durations(100_000.0) == (50, 14)  # truncated, as 1.5e-4 * 1e5 falls short of 15
    s = suggest_config(100_000.0, 30.0, 1.0, -100.0, 10.0, baseline_n_sigma=4.0)
    assert s.baseline_n_sigma == 4.0 and s.baseline_window_sec == 3.0 and s.filter_cutoff == 10_000.0
