"""Column expressions of the model rules, and event features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crossing(m1: Column, s1: Column, w1: Column, m2: Column, s2: Column, w2: Column) -> Column:
    """Where two weighted Gaussians are equal, see functions.mixtures.gaussian_crossing."""
    mid = (m1 + m2) / 2
    even = F.when(F.abs(m1 - m2) < 1e-10, mid).otherwise(mid + s1 * s1 / (m1 - m2) * F.log(w2 / w1))
    p, q = 1 / (s1 * s1), 1 / (s2 * s2)
    a, b = (q - p) / 2, m1 * p - m2 * q
    c = (m2 * m2 * q - m1 * m1 * p) / 2 + F.log(w1 * s2 / (w2 * s1))
    under = b * b - 4 * a * c
    x1, x2 = (-b + F.sqrt(under)) / (2 * a), (-b - F.sqrt(under)) / (2 * a)
    low, high = F.least(m1, m2), F.greatest(m1, m2)
    in1, in2 = x1.between(low, high), x2.between(low, high)
    near = F.when(F.abs(x1 - mid) <= F.abs(x2 - mid), x1).otherwise(x2)
    both = F.when(in1 & ~in2, x1).when(in2 & ~in1, x2).otherwise(near)
    return F.when(F.abs(s1 - s2) < 1e-10, even).when(under < 0, mid).otherwise(both)


#: Event features by name.
FEATURES = {
    "relative_depth": lambda: F.col("relative_depth"),
    "depth": lambda: F.col("depth"),
    "log_duration": lambda: F.log10(F.greatest("duration", F.lit(1e-12))),
    "duration": lambda: F.col("duration"),
    "std_current": lambda: F.col("std_current"),
    "mean_current": lambda: F.col("mean_current"),
    "log_abs_area": lambda: F.log10(F.greatest(F.abs("area"), F.lit(1e-12))),
    "n_levels": lambda: F.col("n_levels").cast("double"),
}


def event_features(events: DataFrame, names: tuple[str, ...] = tuple(FEATURES)) -> DataFrame:
    """Features of each event; an unknown name is a ValueError."""
    if unknown := [n for n in names if n not in FEATURES]:
        raise ValueError(f"unknown features: {unknown}")
    return events.select("recording_id", "start_idx", *(FEATURES[n]().alias(f"f_{n}") for n in names))


def standardised(features: DataFrame) -> DataFrame:
    """Columns f_* by mean and population deviation over all rows; constant columns become 0."""
    names = [c for c in features.columns if c.startswith("f_")]
    stats = features.agg(*(F.avg(c).alias(f"m_{c}") for c in names), *(F.stddev_pop(c).alias(f"s_{c}") for c in names))
    both = features.join(F.broadcast(stats))  # one row of statistics
    return both.select("recording_id", "start_idx", *((F.col(c) - F.col(f"m_{c}")).__truediv__(F.when(F.col(f"s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"s_{c}"))).alias(c) for c in names))
