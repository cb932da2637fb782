"""Scores of detections against a truth, and the tables that benchmarks are summed up in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.matching import match

NAN = float("nan")


def evaluate(truth: DataFrame, detected: DataFrame, bucket: float, least: float = 0.5) -> DataFrame:
    """One row per recording: n_true, n_detected, tp, recall, precision, f1 of one-to-one matches of at least that overlap; f1_any
    of matches of any overlap; medians of the relative errors of length and depth; share of matches with the right number
    of levels; median error of their level borders in microseconds.

    truth and detected: recording_id, id, start, end in seconds, and as far as both have them depth, n_levels (null: not told)
    and level_bounds. What there is nothing to work out from is NaN.
    """
    both = {c for c in ("depth", "n_levels", "level_bounds") if c in truth.columns and c in detected.columns}
    pairs = match(truth, detected, bucket, least)
    loose = match(truth, detected, bucket, 1e-12).groupBy("recording_id").agg(F.count("*").alias("any"))
    sides = pairs
    for df, side in ((truth, "truth"), (detected, "det")):
        sides = sides.join(df.select("recording_id", F.col("id").alias(f"{side}_id"), *(F.col(c).alias(f"{side}_{c}") for c in sorted(both))), ["recording_id", f"{side}_id"])
    length = F.col("truth_end") - F.col("truth_start")
    sides = sides.withColumn("dwell", F.abs((F.col("det_end") - F.col("det_start")) - length) / length)
    sides = sides.withColumn("depth", F.when(F.col("truth_depth") != 0, F.abs(F.col("det_depth") - F.col("truth_depth")) / F.abs("truth_depth")) if "depth" in both else F.lit(None).cast("double"))
    right = (F.col("det_n_levels") == F.col("truth_n_levels")) if "n_levels" in both else F.lit(None).cast("boolean")
    sides = sides.withColumn("right", right)
    found = sides.groupBy("recording_id").agg(F.count("*").alias("tp"), F.median("dwell").alias("dwell_err"), F.median("depth").alias("depth_err"), F.avg(F.col("right").cast("double")).alias("level_acc"))
    if "level_bounds" in both and "n_levels" in both:
        same = sides.where(F.col("right") & (F.col("truth_n_levels") > 1) & (F.size("det_level_bounds") == F.size("truth_level_bounds")))
        off = same.select("recording_id", F.explode(F.zip_with("det_level_bounds", "truth_level_bounds", lambda a, b: F.abs(a - b) * 1e6)).alias("off"))
        found = found.join(off.groupBy("recording_id").agg(F.median("off").alias("bound_err_us")), "recording_id", "left")
    else:
        found = found.withColumn("bound_err_us", F.lit(None).cast("double"))
    n_true = truth.groupBy("recording_id").agg(F.count("*").alias("n_true"))
    n_det = detected.groupBy("recording_id").agg(F.count("*").alias("n_detected"))
    every = n_true.join(n_det, "recording_id", "full").join(found, "recording_id", "left").join(loose, "recording_id", "left").fillna(0, ["n_true", "n_detected", "tp", "any"])
    nan = lambda c: F.coalesce(F.col(c), F.lit(NAN)).alias(c)
    recall, precision, f1 = rates("tp")
    return every.select("recording_id", "n_true", "n_detected", "tp", recall.alias("recall"), precision.alias("precision"), f1.alias("f1"), rates("any")[2].alias("f1_any"), *(nan(c) for c in ("dwell_err", "depth_err", "level_acc", "bound_err_us")))


def rates(hits: str) -> tuple[Column, Column, Column]:
    """Recall (NaN without truth), precision (without detections 1 if there is no truth either, else 0) and F1."""
    tp, n_true, n_det = (F.col(c).cast("double") for c in (hits, "n_true", "n_detected"))
    recall = F.when(n_true > 0, tp / n_true).otherwise(F.lit(NAN))
    precision = F.when(n_det > 0, tp / n_det).when(n_true == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    f1 = F.when((n_true > 0) & (precision + recall > 0), 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return recall, precision, f1


def over_seeds(runs: DataFrame, by: tuple[str, ...], score: str) -> DataFrame:
    """(by, mean, std, n): mean and sample deviation of a score over repeated runs."""
    return runs.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("std"), F.count("*").alias("n"))


def best_setting(runs: DataFrame, by: str, setting: str, score: str) -> DataFrame:
    """(by, best, score): the setting with the best mean score per value of `by`, and as `all` the one with the best mean of
    those means. Ties go to the setting that sorts first."""
    means = runs.groupBy(F.col(by).cast("string").alias(by), F.col(setting).alias("best")).agg(F.avg(score).alias("score"))
    over = means.groupBy(F.lit("all").alias(by), "best").agg(F.avg("score").alias("score"))
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), "best")
    return means.unionByName(over).withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def sensitivity(scores: DataFrame, by: str | Column, score: str) -> DataFrame:
    """(grid, worst, middle, best) of the settings' scores."""
    grid = F.col(by) if isinstance(by, str) else by
    return scores.groupBy(grid.alias("grid")).agg(F.min(score).alias("worst"), F.median(score).alias("middle"), F.max(score).alias("best"))
