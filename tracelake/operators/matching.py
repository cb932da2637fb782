"""Joins of intervals and scores of detections against a truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlaps(truth: DataFrame, detected: DataFrame, bucket: float) -> DataFrame:
    """(truth_id, det_id, iou) of all overlapping pairs: an equi-join on time buckets, each pair in its first common one.

    Both tables: recording_id, id, start, end.
    """

    def cut(df: DataFrame, side: str) -> DataFrame:
        own = df.select("recording_id", F.col("id").alias(f"{side}_id"), F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"))
        return own.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(f"{side}_start") / bucket), F.floor(F.col(f"{side}_end") / bucket))))

    both = cut(truth, "truth").join(cut(detected, "det"), ["recording_id", "bucket"])
    low, high = F.greatest("truth_start", "det_start"), F.least("truth_end", "det_end")
    first = F.col("bucket") == F.floor(low / bucket)
    union = (F.col("truth_end") - F.col("truth_start")) + (F.col("det_end") - F.col("det_start")) - (high - low)
    return both.where((low < high) & first).select("recording_id", "truth_id", "det_id", "truth_start", "truth_end", "det_start", "det_end", ((high - low) / union).alias("iou"))


def match(truth: DataFrame, detected: DataFrame, bucket: float, least: float = 0.5) -> DataFrame:
    """One-to-one pairs, best overlap first (ties: the higher truth id, then the higher detection id), in rounds.

    A pair is taken when it is the best of both its sides; its sides leave and the rest goes on. Every round takes at least one
    pair per overlap group, so long chains need more rounds, never a sequential pass.
    """
    from tracelake.operators.layout import settled

    left = settled(overlaps(truth, detected, bucket).where(F.col("iou") >= least))
    taken = left.limit(0)
    while not left.isEmpty():
        best = F.struct("iou", "truth_id", "det_id")
        by_truth, by_det = Window.partitionBy("recording_id", "truth_id"), Window.partitionBy("recording_id", "det_id")
        ranked = left.withColumn("a", F.max(best).over(by_truth)).withColumn("b", F.max(best).over(by_det))
        new = settled(ranked.where((F.col("a") == best) & (F.col("b") == best)).drop("a", "b"))
        taken = taken.unionByName(new)
        left = settled(left.join(new.select("recording_id", "truth_id"), ["recording_id", "truth_id"], "left_anti").join(new.select("recording_id", "det_id"), ["recording_id", "det_id"], "left_anti"))
    return taken


def nearest(left: DataFrame, right: DataFrame, most: float) -> DataFrame:
    """As-of join: for each left row (recording_id, id, t) the nearest right t within `most` (ties: the earlier).

    Time is cut into stretches of 64 * most; right rows within `most` of a border serve the neighbour as well, so no window needs
    a whole recording.
    """
    stretch = 64.0 * most if most > 0 else 1.0
    own = left.select("recording_id", "id", "t", F.lit(None).cast("double").alias("r"), F.floor(F.col("t") / stretch).alias("stretch"))
    near = right.select("recording_id", F.lit(None).cast("long").alias("id"), "t", F.col("t").alias("r"), F.explode(F.sequence(F.floor((F.col("t") - most) / stretch), F.floor((F.col("t") + most) / stretch))).alias("stretch"))
    back = Window.partitionBy("recording_id", "stretch").orderBy(F.col("t"), F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("recording_id", "stretch").orderBy(F.col("t").desc(), F.col("id").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(near).withColumn("before", F.last("r", True).over(back)).withColumn("after", F.last("r", True).over(ahead)).where("id IS NOT NULL")
    found = F.when(F.col("before").isNull(), F.col("after")).when(F.col("after").isNull(), F.col("before")).when(F.col("t") - F.col("before") <= F.col("after") - F.col("t"), F.col("before")).otherwise(F.col("after"))
    return both.withColumn("nearest", found).select("recording_id", "id", "t", F.when(F.abs(F.col("nearest") - F.col("t")) <= most, F.col("nearest")).alias("nearest"))
