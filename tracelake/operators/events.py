"""Events: runs of a mask, merged over short gaps, long enough, with their statistics.

Runs are found chunk by chunk; one that a border cuts leaves two runs with gap 0, and merging joins them again. Only runs,
and only those at the ends of stretches, never samples, meet in a window over a whole recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.config import BOTH, DOWN, UP
from tracelake.operators.layout import CHUNK


def above(column: str, cut) -> Column:
    """column > cut with a comparison that is false for NaN, which Spark otherwise orders last."""
    return ~F.isnan(F.col(column)) & (F.col(column) > cut)


def below(column: str, cut) -> Column:
    return ~F.isnan(F.col(column)) & (F.col(column) < cut)


def find_runs(samples: DataFrame, mask: Column, extra: tuple[Column, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(recording_id, start_idx, end_idx, extra aggregates) of each maximal run in a chunk; half-open."""
    cut = samples.withColumn("chunk", F.floor(F.col("sample_idx") / chunk)).where(mask)
    order = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx")
    island = cut.withColumn("island", F.col("sample_idx") - F.row_number().over(order))
    return island.groupBy("recording_id", "chunk", "island").agg(F.min("sample_idx").alias("start_idx"), (F.max("sample_idx") + 1).alias("end_idx"), *extra).drop("chunk", "island")


#: Samples of a stretch in which runs are merged; only the runs at its ends meet those of other stretches.
SPAN = 1 << 18


def merge_runs(runs: DataFrame, gap: int, keep: tuple[str, ...] = (), span: int = SPAN) -> DataFrame:
    """Runs of a recording, which do not overlap, whose gap is at most `gap` become one; `keep` columns are combined by max.

    Stretch by stretch: a run serves every stretch that it reaches with its gap, as a predecessor. What may go on over an end,
    two events a stretch at most, is merged in a window over the recording.
    """
    first = F.floor(F.col("start_idx") / span)
    near = runs.withColumn("chunk", F.explode(F.sequence(first, F.floor((F.col("end_idx") + gap) / span))))
    stretch = Window.partitionBy("recording_id", "chunk")
    order = stretch.orderBy("start_idx")
    new = F.coalesce((F.col("start_idx") - F.lag("end_idx").over(order) > gap).cast("int"), F.lit(1))
    marked = near.withColumn("new", new).where(first == F.col("chunk")).withColumn("event", F.sum("new").over(order))  # 0: goes on from before
    sums = (F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), *(F.max(c).alias(c) for c in keep))
    parts = marked.groupBy("recording_id", "chunk", "event").agg(*sums).withColumn("edge", (F.col("event") == 0) | (F.col("event") == F.max("event").over(stretch)))
    ends = parts.where("edge").withColumn("event", F.sum((F.col("event") > 0).cast("int")).over(Window.partitionBy("recording_id").orderBy("start_idx")))
    whole = ends.groupBy("recording_id", "event").agg(*sums).drop("event")
    return parts.where("NOT edge").select(*whole.columns).unionByName(whole)


def contained(samples: DataFrame, intervals: DataFrame, chunk: int = CHUNK, how: str = "inner") -> DataFrame:
    """samples with the interval that holds them: an equi-join on chunks, then the exact bounds."""
    left = samples.withColumn("chunk", F.floor(F.col("sample_idx") / chunk))
    spread = intervals.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_idx") / chunk), F.floor((F.col("end_idx") - 1) / chunk))))
    right = spread.withColumnRenamed("recording_id", "__rec").withColumnRenamed("chunk", "__chunk")
    inside = (F.col("recording_id") == F.col("__rec")) & (F.col("chunk") == F.col("__chunk")) & (F.col("sample_idx") >= F.col("start_idx")) & (F.col("sample_idx") < F.col("end_idx"))
    return left.join(right, inside, how).drop("__rec", "__chunk", "chunk")


def event_stats(samples: DataFrame, intervals: DataFrame, rate: float) -> DataFrame:
    """Statistics of each interval from residual and baseline: mean, deviation, depth, area."""
    inside = contained(samples, intervals.select("recording_id", "start_idx", "end_idx"))
    sums = inside.groupBy("recording_id", "start_idx", "end_idx").agg(
        F.avg("residual").alias("r"),
        F.stddev_pop("residual").alias("spread"),
        F.avg(F.col("baseline") + F.col("residual")).alias("value"),
        F.avg("baseline").alias("baseline"),
        F.sum(F.abs("residual")).alias("area"),
    )
    return described(sums, rate)


def described(sums: DataFrame, rate: float) -> DataFrame:
    """Event rows from (recording_id, start_idx, end_idx, r, spread, value, baseline, area in samples)."""
    depth = F.abs("r")
    return sums.select(
        "recording_id",
        "start_idx",
        "end_idx",
        (F.col("start_idx") / rate).alias("start_time"),
        (F.col("end_idx") / rate).alias("end_time"),
        ((F.col("end_idx") - F.col("start_idx")) / rate).alias("duration"),
        F.col("value").alias("mean_current"),
        F.col("spread").alias("std_current"),
        F.col("baseline").alias("baseline_current"),
        depth.alias("depth"),
        F.when(F.abs("baseline") > 1e-10, depth / F.abs("baseline")).otherwise(F.lit(0.0)).alias("relative_depth"),
        (F.col("area") / rate).alias("area"),
        F.lit(1).alias("n_levels"),
        F.lit("single_level").alias("event_type"),
    )


def effective_thresholds(threshold: float | Column, pore_mean: float | Column | None = None, pore_std: float | Column | None = None) -> dict[str, Column]:
    """Thresholds in force per direction: never within five deviations of the open level, where that is known."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if pore_mean is None:
        return {DOWN: cut, UP: F.abs(cut)}
    mean, std = (x if isinstance(x, Column) else F.lit(float(x)) for x in (pore_mean, pore_std))
    return {DOWN: F.least(cut, mean - 5.0 * std), UP: F.greatest(F.abs(cut), mean + 5.0 * std)}


def detect_events(samples: DataFrame, rate: float, threshold: float | Column, direction: str, least: int, gap: int, pore: tuple[float | Column, float | Column] | None = None) -> DataFrame:
    """Events of one or both directions with statistics; samples within one deviation of the open level never count.

    Threshold and open level are numbers, or columns of samples where every recording has its own.
    """
    cuts = effective_thresholds(threshold, *(pore or (None, None)))
    found = None
    for way in (DOWN, UP) if direction == BOTH else (direction,):
        mask = below("residual", cuts[way]) if way == DOWN else above("residual", cuts[way])
        if pore is not None:
            mask &= F.abs(F.col("residual") - pore[0]) > pore[1]
        runs = merge_runs(find_runs(samples, mask), gap).where(F.col("end_idx") - F.col("start_idx") >= least)
        own = event_stats(samples, runs, rate).withColumn("direction", F.lit(way))
        found = own if found is None else found.unionByName(own)
    return found


def hysteresis_events(samples: DataFrame, enter: float, leave: float, least: int, gap: int, direction: str = UP) -> DataFrame:
    """Runs beyond `leave` that hold a sample beyond `enter`, merged over short gaps, long enough; downward for DOWN."""
    sign = -1 if direction == DOWN else 1
    signed = samples.withColumn("value", F.col("value") * sign)
    runs = find_runs(signed, above("value", sign * leave), (F.max(F.col("value")).alias("peak"),))
    whole = merge_runs(runs, 0, ("peak",)).where(F.col("peak") > sign * enter)
    return merge_runs(whole, gap).where(F.col("end_idx") - F.col("start_idx") >= least)
