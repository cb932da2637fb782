"""Analysis ranges: cropping, keeping, joining, and mapping results back."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def crop_bounds(start: float, end: float, rate: float, n: int) -> tuple[int, int]:
    """Sample bounds of a time range; ValueError if it is empty or lies outside."""
    if start >= end:
        raise ValueError("the range ends before it starts")
    low, high = max(0, math.floor(start * rate)), min(n, math.ceil(end * rate))
    if low >= high:
        raise ValueError("the range lies outside the recording")
    return low, high


def crop(samples: DataFrame, start: float, end: float, rate: float, n: int) -> DataFrame:
    """Samples of a time range with new indices; the filter reaches the scan."""
    low, high = crop_bounds(start, end, rate, n)
    return samples.where((F.col("sample_idx") >= low) & (F.col("sample_idx") < high)).withColumn("sample_idx", F.col("sample_idx") - low)


def normalise(ranges: DataFrame, duration: float) -> DataFrame:
    """(t0, t1) ordered, clamped to the recording, empty ones dropped, overlapping or touching ones joined."""
    clean = ranges.select(F.greatest(F.least("t0", "t1"), F.lit(0.0)).alias("t0"), F.least(F.greatest("t0", "t1"), F.lit(duration)).alias("t1")).where("t0 < t1")
    order = Window.orderBy("t0", "t1")  # a handful of ranges that a user gave
    reach = F.max("t1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = clean.withColumn("new", F.coalesce((F.col("t0") > reach).cast("int"), F.lit(1))).withColumn("g", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("g").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1")).select("t0", "t1")


def keep_ranges(excluded: DataFrame, duration: float) -> DataFrame:
    """What is left of [0, duration] without the excluded ranges."""
    spark = excluded.sparkSession
    gone = normalise(excluded, duration).unionByName(spark.createDataFrame([(duration, duration)], "t0 double, t1 double"))
    order = Window.orderBy("t0", "t1")
    return gone.select(F.coalesce(F.lag("t1").over(order), F.lit(0.0)).alias("a"), F.col("t0").alias("b")).where("a < b").select(F.col("a").alias("t0"), F.col("b").alias("t1"))


def range_table(kept: DataFrame, rate: float, n: int) -> DataFrame:
    """(range, i0, i1, base): sample bounds of each kept range and where it starts in the joined signal."""
    order = Window.orderBy("t0")
    cut = kept.select("t0", F.greatest(F.floor(F.col("t0") * rate), F.lit(0)).cast("long").alias("i0"), F.least(F.ceil(F.col("t1") * rate), F.lit(n)).cast("long").alias("i1")).where("i0 < i1")
    before = F.sum(F.col("i1") - F.col("i0")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return cut.select((F.row_number().over(order) - 1).cast("long").alias("range"), "i0", "i1", F.coalesce(before, F.lit(0)).cast("long").alias("base"))


def concatenate(samples: DataFrame, table: DataFrame) -> DataFrame:
    """Samples of the ranges one after the other: orig_idx, and sample_idx anew. A sample two ranges share comes twice."""
    inside = (F.col("sample_idx") >= F.col("i0")) & (F.col("sample_idx") < F.col("i1"))
    joined = samples.join(F.broadcast(table), inside)  # as many rows as a user gave ranges
    return joined.select("recording_id", (F.col("base") + F.col("sample_idx") - F.col("i0")).alias("sample_idx"), F.col("sample_idx").alias("orig_idx"), "value", "range")


def boundaries(table: DataFrame) -> DataFrame:
    """Positions in the joined signal where a range ends and another begins."""
    last = table.agg(F.max("range")).first()[0]
    return table.where(F.col("range") != F.lit(last)).select((F.col("base") + F.col("i1") - F.col("i0")).alias("boundary"))


def gap_rows(joined: DataFrame, table: DataFrame) -> DataFrame:
    """The joined signal with a NaN row at each boundary, at half an index before it."""
    rows = joined.select("recording_id", F.col("sample_idx").cast("double").alias("position"), "value")
    marks = joined.select("recording_id").distinct().join(F.broadcast(boundaries(table))).select("recording_id", (F.col("boundary") - 0.5).alias("position"), F.lit(float("nan")).alias("value"))
    return rows.unionByName(marks)


def restore(events: DataFrame, table: DataFrame, rate: float) -> DataFrame:
    """Events of the joined signal in the recording's own indices and times; durations stay those of the joined signal."""
    t = F.broadcast(table)
    size = F.col("i1") - F.col("i0")

    def mapped(df: DataFrame, column: str, offset: int) -> DataFrame:
        at = F.col(column) - offset
        got = df.join(t, (at >= F.col("base")) & (at < F.col("base") + size), "left")
        return got.withColumn(column, F.col("i0") + at - F.col("base") + offset).drop("range", "i0", "i1", "base")

    out = mapped(mapped(events, "start_idx", 0), "end_idx", 1)
    if "sublevels" in out.columns:
        every = table.agg(F.collect_list(F.struct("base", "i0", "i1")).alias("__ranges"))  # one row: the ranges that a user gave

        def back(at: Column, offset: int) -> Column:
            own = F.filter("__ranges", lambda r: (at - offset >= r["base"]) & (at - offset < r["base"] + r["i1"] - r["i0"]))[0]
            return own["i0"] + at - own["base"]

        moved = F.transform("sublevels", lambda s: s.withField("from_idx", back(s["from_idx"], 0)).withField("to_idx", back(s["to_idx"], 1)))
        out = out.join(F.broadcast(every)).withColumn("sublevels", moved).drop("__ranges")
    return out.withColumn("start_time", F.col("start_idx") / rate).withColumn("end_time", F.col("end_idx") / rate)


def shift(events: DataFrame, offset: int, rate: float) -> DataFrame:
    """Events of a cropped signal, and their sub-levels, in the recording's indices and times."""
    moved = events.withColumn("start_idx", F.col("start_idx") + offset).withColumn("end_idx", F.col("end_idx") + offset)
    if "sublevels" in moved.columns:
        moved = moved.withColumn("sublevels", F.transform("sublevels", lambda s: s.withField("from_idx", s["from_idx"] + offset).withField("to_idx", s["to_idx"] + offset)))
    return moved.withColumn("start_time", F.col("start_idx") / rate).withColumn("end_time", F.col("end_idx") / rate)


def times_of(samples: DataFrame, rate: float, table: DataFrame | None = None) -> DataFrame:
    """samples with `time` in the recording's seconds; with a table of ranges, indices are those of the joined signal."""
    if table is None:
        return samples.withColumn("time", F.col("sample_idx") / rate)
    at = F.col("sample_idx")
    inside = (at >= F.col("base")) & (at < F.col("base") + F.col("i1") - F.col("i0"))
    return samples.join(F.broadcast(table), inside).withColumn("time", (F.col("i0") + at - F.col("base")) / rate).drop("range", "i0", "i1", "base")


def index_range(table: DataFrame, low: float, high: float, rate: float) -> tuple[int, int]:
    """Indices [first, last) of the joined signal's samples whose times lie in [low, high); (0, 0) if there are none."""
    first, last = F.greatest(F.col("i0"), F.ceil(F.lit(low * rate))), F.least(F.col("i1"), F.ceil(F.lit(high * rate)))
    r = table.where(first < last).agg(F.min(F.col("base") + first - F.col("i0")).alias("a"), F.max(F.col("base") + last - F.col("i0")).alias("b")).first()
    return (0, 0) if r["a"] is None else (int(r["a"]), int(r["b"]))


def ranges_of(spark: SparkSession, ranges: list[tuple[float, float]]) -> DataFrame:
    return spark.createDataFrame([(float(a), float(b)) for a, b in ranges], "t0 double, t1 double")


def outside(table: DataFrame, n: int) -> DataFrame:
    """(start_idx, end_idx) of what the kept ranges leave out."""
    order = Window.orderBy("i0").rowsBetween(Window.unboundedPreceding, -1)
    ends = table.select("i0", "i1").unionByName(table.sparkSession.createDataFrame([(n, n)], "i0 long, i1 long"))
    gaps = ends.select(F.coalesce(F.max("i1").over(order), F.lit(0)).alias("start_idx"), F.col("i0").alias("end_idx"))
    return gaps.where("start_idx < end_idx")


def apply_selection(mode: str, selection: tuple[float, float] | None, ranges: list[tuple[float, float]], duration: float) -> list[tuple[float, float]]:
    """Excluded ranges after a selection: `exclude` adds it, `keep` leaves nothing but it, `clear` drops all."""
    if mode == "clear":
        return []
    if selection is None:
        return ranges
    low, high = sorted(selection)
    if mode == "exclude":
        return [*ranges, (low, high)]
    if mode == "keep":
        return [r for r in ((0.0, low), (high, duration)) if r[0] < r[1]]
    raise ValueError(f"unknown mode: {mode}")
