"""Label sequences: runs, dwell times, transitions, segment statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.layout import CHUNK, lagged


def label_runs(labelled: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(recording_id, label, start_idx, end_idx) of each maximal run of one label.

    Runs are found in chunks first; the few pieces, not the samples, are then joined over a recording.
    """
    cut = labelled.withColumn("chunk", F.floor(F.col("sample_idx") / chunk))
    order = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx")
    own = Window.partitionBy("recording_id", "chunk", "label").orderBy("sample_idx")
    pieces = cut.withColumn("island", F.row_number().over(order) - F.row_number().over(own)).groupBy("recording_id", "chunk", "label", "island").agg(F.min("sample_idx").alias("start_idx"), (F.max("sample_idx") + 1).alias("end_idx"))
    return merge_same(pieces.select("recording_id", "label", "start_idx", "end_idx"))


def merge_same(runs: DataFrame) -> DataFrame:
    """Consecutive runs of one label become one."""
    order = Window.partitionBy("recording_id").orderBy("start_idx")
    new = F.coalesce((F.lag("label").over(order) != F.col("label")).cast("int"), F.lit(1))
    marked = runs.withColumn("new", new).withColumn("g", F.sum("new").over(order))
    return marked.groupBy("recording_id", "g").agg(F.first("label").alias("label"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx")).drop("g")


def dwell_times(labelled: DataFrame, rate: float) -> DataFrame:
    """(recording_id, label, n_runs, mean_dwell, max_dwell) in seconds."""
    length = (F.col("end_idx") - F.col("start_idx")) / rate
    return label_runs(labelled).groupBy("recording_id", "label").agg(F.count("*").alias("n_runs"), F.avg(length).alias("mean_dwell"), F.max(length).alias("max_dwell"))


def transition_matrix(labelled: DataFrame, columns: str = "label") -> DataFrame:
    """(recording_id, from_label, to_label, n, p) of consecutive samples; a label that is never left has p = 1 to itself."""
    steps = lagged(labelled, columns, "from_label").where("from_label IS NOT NULL")
    counts = steps.groupBy("recording_id", "from_label", F.col(columns).alias("to_label")).agg(F.count("*").alias("n"))
    ends = labelled.select("recording_id", F.col(columns).alias("from_label")).distinct().join(counts.select("recording_id", "from_label").distinct(), ["recording_id", "from_label"], "left_anti")
    full = counts.unionByName(ends.select("recording_id", "from_label", F.col("from_label").alias("to_label"), F.lit(0).cast("long").alias("n")))
    total = F.sum("n").over(Window.partitionBy("recording_id", "from_label"))
    return full.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1.0)))


def segment_stats(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    """Statistics between change points. cuts: recording_id, at (each the start of a new segment)."""
    from tracelake.operators.events import contained

    n = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    starts = cuts.select("recording_id", "at").unionByName(n.select("recording_id", F.lit(0).cast("long").alias("at")))
    order = Window.partitionBy("recording_id").orderBy("at")
    spans = starts.join(n, "recording_id").select("recording_id", F.col("at").alias("start_idx"), F.coalesce(F.lead("at").over(order), F.col("n")).alias("end_idx"))
    inside = contained(samples, spans.where("start_idx < end_idx"))
    return inside.groupBy("recording_id", "start_idx", "end_idx").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("n"))
