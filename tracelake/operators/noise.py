"""Noise estimates per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.operators import quantiles
from tracelake.operators.layout import lagged
from tracelake.operators.quantiles import medians

#: Scale of the median absolute deviation to a standard deviation of normal noise, both ways round; fixed values.
MAD_SCALE = 1.4826
QUARTILE = 0.6745


def finite(column: str):
    c = F.col(column)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def deviation(samples: DataFrame, column: str = "value", by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(by, center, mad): median, and median of the absolute deviations from it."""
    own = samples.where(finite(column)).select(*by, column)
    if quantiles.small(own, by):
        middle = own.groupBy(*by).agg(F.median(column).alias("center"))
        return own.join(middle, list(by)).groupBy(*by).agg(F.first("center").alias("center"), F.median(F.abs(F.col(column) - F.col("center"))).alias("mad"))
    center = medians(own, F.col(column), by, "center")
    off = own.join(center, list(by))
    return center.join(medians(off, F.abs(F.col(column) - F.col("center")), by, "mad"), list(by))


def noise_mad(samples: DataFrame, column: str = "value") -> DataFrame:
    """1.4826 times the median absolute deviation; recordings without finite values get 1."""
    found = deviation(samples, column).select("recording_id", (MAD_SCALE * F.col("mad")).alias("noise"))
    every = samples.select("recording_id").distinct()
    return every.join(found, "recording_id", "left").select("recording_id", F.coalesce("noise", F.lit(1.0)).alias("noise"))


def noise_std(samples: DataFrame, column: str = "value") -> DataFrame:
    """Population standard deviation of the finite values."""
    return samples.groupBy("recording_id").agg(F.coalesce(F.stddev_pop(F.when(finite(column), F.col(column))), F.lit(1.0)).alias("noise"))


def noise_floor_diff(samples: DataFrame, first: int = 100_000) -> DataFrame:
    """From first differences of the first samples: slow drifts cancel."""
    steps = lagged(samples.where(F.col("sample_idx") < first)).where("previous IS NOT NULL")
    return medians(steps, F.abs(F.col("value") - F.col("previous"))).select("recording_id", (F.col("median") * MAD_SCALE / 2**0.5).alias("noise"))


def robust_noise_std(samples: DataFrame) -> DataFrame:
    """Deviation of first differences from their median; fewer than three samples: their deviation, or 1 if that is 0."""
    steps = lagged(samples).where("previous IS NOT NULL").select("recording_id", (F.col("value") - F.col("previous")).alias("step"))
    found = deviation(steps, "step").select("recording_id", (F.col("mad") / QUARTILE / 2**0.5).alias("robust"))
    plain = samples.groupBy("recording_id").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("std"))
    usable = F.when(F.col("n") >= 3, F.nullif("robust", F.lit(0.0)))
    return plain.join(found, "recording_id", "left").select("recording_id", F.coalesce(usable, F.nullif("std", F.lit(0.0)), F.lit(1.0)).alias("noise"))
