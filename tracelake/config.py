"""Settings of a detection run, and their derivation from form fields or from the data."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

DOWN, UP, BOTH = "down", "up", "both"


@dataclass(frozen=True)
class DetectionConfig:
    """All knobs of the detection plan; None means: derive it."""

    apply_filter: bool = True
    pre_applied_filter_cutoff: float | None = None
    filter_type: str = "bessel"
    filter_order: int = 4
    filter_cutoff: float | None = None
    detrend_method: str = "none"
    detrend_order: int = 3
    baseline_window_sec: float = 5.0
    baseline_iterations: int = 3
    baseline_percentile: float = 90.0
    baseline_n_sigma: float = 5.0
    gmm_max_components: int = 10
    bic_criterion: str = "bic"
    gmm_max_samples: int = 100_000
    threshold_method: str = "dpgmm"
    dp_concentration: float | None = None
    event_direction: str = DOWN
    min_event_duration_sec: float | None = None
    merge_gap_sec: float | None = None
    min_segment_samples: int = 50
    max_sublevel_depth: int = 5
    sublevel_method: str = "dpgmm"
    hmm_analysis: bool = False
    hmm_max_states: int = 5
    hmm_method: str = "bic"
    cluster_events: bool = False
    max_clusters: int = 10
    noise_estimation: str = "mad"
    random_seed: int | None = 0

    def cutoff(self, rate: float) -> float:
        """Low-pass cutoff in force: the set one, or a tenth of the sampling rate."""
        if not self.apply_filter:
            return self.pre_applied_filter_cutoff or rate / 10.0
        return self.filter_cutoff or rate / 10.0

    def baseline_window(self, rate: float) -> int:
        """Samples of the baseline's window, an odd number."""
        window = max(1, int(self.baseline_window_sec * rate))
        return window + 1 - window % 2

    def durations(self, rate: float) -> tuple[int, int]:
        """(least samples of an event, largest gap in samples that is merged)."""
        fc = self.cutoff(rate)
        least = 5.0 / fc if self.min_event_duration_sec is None else self.min_event_duration_sec
        gap = 1.5 / fc if self.merge_gap_sec is None else self.merge_gap_sec
        return max(1, int(least * rate)), max(0, int(gap * rate))

    @classmethod
    def from_settings(cls, settings: dict) -> DetectionConfig:
        """From loose settings (say, form fields): unknown and empty ones are left out, numbers may be strings."""
        kinds = {f.name: f.type for f in fields(cls)}
        kept = {}
        for name, value in settings.items():
            if name not in kinds or value is None or value == "":
                continue
            if isinstance(value, str) and ("float" in kinds[name] or kinds[name].startswith("int")):
                try:
                    value = float(value)
                except ValueError:
                    continue
            kept[name] = int(value) if kinds[name].startswith("int") and value is not None else value
        return cls(**kept)


def suggest_config(rate: float, duration: float, noise: float, low: float, high: float, base: DetectionConfig | None = None, **explicit) -> DetectionConfig:
    """Settings from a recording's figures: noise floor, and 1st and 99th percentile of the values.

    The noisier the trace against its range, the wider the exclusion; explicit settings win.
    """
    ratio = noise / (high - low) if high > low else 0.0
    found = {
        "filter_cutoff": rate / 10.0,
        "baseline_n_sigma": 5.0 if ratio < 0.05 else 3.0 if ratio < 0.15 else 2.0,
        "baseline_window_sec": min(5.0, max(1.0, 0.1 * duration)),
        "gmm_max_components": 5,
        "merge_gap_sec": 1.5 / (rate / 10.0),
    }
    return replace(base or DetectionConfig(), **(found | explicit))
