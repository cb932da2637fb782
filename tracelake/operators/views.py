"""Tables behind the displays: envelopes, histograms, event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def envelope(samples: DataFrame, points: int) -> DataFrame:
    """Smallest and largest sample of each of points div 2 equal bins (first index wins ties)."""
    bins = max(1, points // 2)
    n = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    cut = samples.join(n, "recording_id").withColumn("bin", F.floor(F.col("sample_idx") * bins / F.col("n")))
    ends = cut.where(~F.isnan("value")).groupBy("recording_id", "bin").agg(F.min(F.struct("value", "sample_idx")).alias("lo"), F.min(F.struct((-F.col("value")).alias("value"), "sample_idx")).alias("hi"))
    both = ends.select("recording_id", F.explode(F.array_distinct(F.array(F.struct("lo.sample_idx", "lo.value"), F.struct("hi.sample_idx", (-F.col("hi.value")).alias("value"))))).alias("p"))
    return both.select("recording_id", "p.sample_idx", "p.value")


def value_histogram(samples: DataFrame, bins: int = 200, column: str = "value") -> DataFrame:
    """Counts and densities in equal bins over [p0.05 - 5 %, p99.95 + 5 %] of the range; the last bin is closed."""
    edge = samples.groupBy("recording_id").agg(F.percentile(column, F.array(F.lit(0.0005), F.lit(0.9995))).alias("p"))
    pad = 0.05 * (F.col("p")[1] - F.col("p")[0])
    edge = edge.select("recording_id", (F.col("p")[0] - pad).alias("low"), (F.col("p")[1] + pad).alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    inside = samples.join(edge, "recording_id").where((F.col(column) >= F.col("low")) & (F.col(column) <= F.col("high")))
    at = F.least(F.floor((F.col(column) - F.col("low")) / width), F.lit(bins - 1)).cast("long")
    counts = inside.groupBy("recording_id", at.alias("bin")).agg(F.count("*").alias("n"), F.first(width).alias("width"))
    total = counts.groupBy("recording_id").agg(F.sum("n").alias("total"))
    return counts.join(total, "recording_id").select("recording_id", "bin", "n", (F.col("n") / F.col("total") / F.col("width")).alias("density"))


def log_histogram(events: DataFrame, column: str = "duration", bins: int = 40) -> DataFrame:
    """Counts in equal bins of log10 over the range of the values; the last bin is closed."""
    logs = events.where(F.col(column) > 0).select(F.log10(column).alias("x"))
    edge = logs.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    width = (F.col("high") - F.col("low")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("long")
    return logs.join(F.broadcast(edge)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))  # one row of edges


def event_rows(events: DataFrame) -> DataFrame:
    """Event table as shown: ids from 1 by start, rounded figures."""
    order = Window.partitionBy("recording_id").orderBy("start_idx", "direction")
    return events.select(
        "recording_id",
        F.row_number().over(order).alias("id"),
        F.round("start_time", 6).alias("start_s"),
        F.round(F.col("duration") * 1e3, 4).alias("duration_ms"),
        F.round(F.round("depth", 9), 3).alias("depth"),
        F.round(F.round("relative_depth", 9), 4).alias("rel_depth"),
        F.col("n_levels").alias("levels"),
        "direction",
    )


def stride(samples: DataFrame, points: int = 10_000) -> DataFrame:
    """Every max(1, n div points)-th sample."""
    n = samples.groupBy("recording_id").agg(F.count("*").alias("n"))
    return samples.join(n, "recording_id").where(F.col("sample_idx") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0).drop("n")


def thin(samples: DataFrame, rate: float, cutoff: float | None) -> DataFrame:
    """Samples far enough apart to be independent after the low-pass."""
    return samples.where(F.col("sample_idx") % thinning_step(rate, cutoff) == 0)


def thinning_step(rate: float, cutoff: float | None) -> int:
    return max(1, int(rate / (2.0 * cutoff))) if cutoff else 1


def residual_sample(samples: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` samples, those with the smallest seeded hashes: the same ones whatever the partitions."""
    return samples.orderBy(F.xxhash64("recording_id", "sample_idx", F.lit(seed)), "recording_id", "sample_idx").limit(most)


def first_events(events: DataFrame, most: int) -> DataFrame:
    """The first `most` events of each recording, with their `rank` from 1."""
    order = Window.partitionBy("recording_id").orderBy("start_idx", "direction")
    return events.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def windowed(samples: DataFrame, rate: float, low: float, high: float, points: int) -> DataFrame:
    """(recording_id, time, value): envelope of what lies in [low, high) seconds of a concatenated signal (recording_id,
    sample_idx, orig_idx, value), in the recording's time; where neighbouring points leave out samples of the recording, a row
    without time and value stands between them, `position` orders all."""
    inside = samples.where((F.col("orig_idx") / rate >= low) & (F.col("orig_idx") / rate < high))
    first = inside.groupBy("recording_id").agg(F.min("sample_idx").alias("__first"))
    local = inside.join(first, "recording_id").withColumn("sample_idx", F.col("sample_idx") - F.col("__first"))
    seen = envelope(local.select("recording_id", "sample_idx", "value"), points).join(local.select("recording_id", "sample_idx", "orig_idx"), ["recording_id", "sample_idx"])
    order = Window.partitionBy("recording_id").orderBy("sample_idx")  # `points` rows
    jump = F.col("orig_idx") - F.lag("orig_idx").over(order) > F.col("sample_idx") - F.lag("sample_idx").over(order)
    placed = seen.withColumn("jump", jump)
    points_ = placed.select("recording_id", F.col("sample_idx").cast("double").alias("position"), (F.col("orig_idx") / rate).alias("time"), "value")
    breaks = placed.where("jump").select("recording_id", (F.col("sample_idx") - 0.5).alias("position"), F.lit(None).cast("double").alias("time"), F.lit(None).cast("double").alias("value"))
    return points_.unionByName(breaks)


def visible(events: DataFrame, low: float, high: float) -> DataFrame:
    return events.where((F.col("end_time") >= low) & (F.col("start_time") <= high))
