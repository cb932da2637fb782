"""Result tables in the shapes that are written out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EVENT_COLUMNS = ("start_idx", "end_idx", "start_time", "end_time", "duration", "mean_current", "std_current", "baseline_current", "depth", "relative_depth", "area", "n_levels", "event_type", "direction")


def event_table(events: DataFrame) -> DataFrame:
    """One row per event, ids from 0 by start; cluster columns only if there are any."""
    order = Window.partitionBy("recording_id").orderBy("start_idx", "direction")
    extra = [c for c in ("cluster_id", "cluster_prob") if c in events.columns]
    return events.select("recording_id", (F.row_number().over(order) - 1).alias("event_id"), *EVENT_COLUMNS, *extra)


def sublevel_table(events: DataFrame, rate: float) -> DataFrame:
    """One row per level of each event with several, with its depth below the event's baseline."""
    order = Window.partitionBy("recording_id").orderBy("start_idx", "direction")
    own = events.withColumn("event_id", F.row_number().over(order) - 1).select("recording_id", "event_id", "baseline_current", F.explode("sublevels").alias("s"))
    depth = F.col("baseline_current") - F.col("s.mean_current")
    return own.select(
        "recording_id", "event_id", F.col("s.sublevel_idx").alias("sublevel_idx"), F.col("s.level_index").alias("level_index"), F.col("s.from_idx").alias("start_idx"), F.col("s.to_idx").alias("end_idx"),
        (F.col("s.from_idx") / rate).alias("start_time"), (F.col("s.to_idx") / rate).alias("end_time"), ((F.col("s.to_idx") - F.col("s.from_idx")) / rate).alias("duration"),
        F.col("s.mean_current").alias("mean_current"), F.col("s.std_current").alias("std_current"), depth.alias("depth_from_baseline"),
        F.when(F.abs("baseline_current") > 1e-10, depth / F.abs("baseline_current")).otherwise(F.lit(float("nan"))).alias("relative_depth_from_baseline"),
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def csv_text(df: DataFrame, most: int = 1_000_000) -> str:
    """A result table of up to `most` rows as the text of a CSV file; ValueError beyond."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them to files")
    return rows.to_csv(index=False)


def waveforms(samples: DataFrame, events: DataFrame, rate: float, padding_ms: float = 0.0) -> DataFrame:
    """time, signal, baseline and residual of each event with padding on both sides."""
    from tracelake.operators.events import contained

    pad = int(padding_ms * rate / 1e3)
    wide = events.select("recording_id", F.col("start_idx").alias("event"), F.greatest(F.col("start_idx") - pad, F.lit(0)).alias("start_idx"), (F.col("end_idx") + pad).alias("end_idx"))
    return contained(samples, wide).select("recording_id", "event", (F.col("sample_idx") / rate).alias("time"), F.col("value").alias("signal"), "baseline", "residual")


def save_waveform(samples: DataFrame, path: str, fmt: str = "npz") -> None:
    """One event's waveform (a bounded slice) as .npz or .csv on the driver."""
    import numpy as np

    frame = samples.orderBy("time").toPandas()
    if fmt == "npz":
        np.savez(path, **{c: frame[c].to_numpy() for c in ("time", "signal", "baseline", "residual")})
    elif fmt == "csv":
        frame[["time", "signal", "baseline", "residual"]].to_csv(path, index=False)
    else:
        raise ValueError(f"unknown format: {fmt}")


def stats_json(stats: dict) -> str:
    return json.dumps(stats, indent=2, default=float)


def notebook_table(events: DataFrame, units: str = "pA") -> DataFrame:
    """Eight display columns, ids from 1."""
    order = Window.partitionBy("recording_id").orderBy("start_idx", "direction")
    return events.select(
        F.row_number().over(order).alias("event_id"), F.col("start_time").alias("start_sec"), F.col("end_time").alias("end_sec"), (F.col("duration") * 1e3).alias("duration_ms"),
        F.col("depth").alias(f"depth_{units}"), "area", F.col("n_levels").alias("n_sublevels"), "direction",
    )
