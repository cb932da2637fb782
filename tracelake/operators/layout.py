"""How a signal is laid out for windows: chunks with borrowed borders, so no window needs a whole recording in a task."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Samples of a chunk: a window stage then has n / CHUNK tasks' worth of groups.
CHUNK = 65_536


def with_halo(samples: DataFrame, before: int, after: int, chunk: int = CHUNK) -> DataFrame:
    """samples with a column `chunk`; rows within a window's reach of a border are copied to the neighbour.

    A window at row c reads rows c - before to c + after, so row i serves the chunks of i - after to i + before.
    """
    low = F.greatest(F.floor((F.col("sample_idx") - after) / chunk), F.lit(0))
    high = F.floor((F.col("sample_idx") + before) / chunk)
    return samples.withColumn("chunk", F.explode(F.sequence(low, high)))


def own_rows(haloed: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of their own chunk, without the borrowed ones."""
    return haloed.where(F.floor(F.col("sample_idx") / chunk) == F.col("chunk")).drop("chunk")


def frame(before: int, after: int) -> WindowSpec:
    """ROWS frame of a chunk; indices are dense, so rows are samples."""
    return Window.partitionBy("recording_id", "chunk").orderBy("sample_idx").rowsBetween(-before, after)


def over_chunks(samples: DataFrame, before: int, after: int, columns: dict[str, Column], chunk: int = CHUNK) -> DataFrame:
    """samples with window columns over ROWS before..after, worked out chunk by chunk."""
    spec = frame(before, after)
    out = with_halo(samples, before, after, chunk)
    return own_rows(out.select("*", *(c.over(spec).alias(n) for n, c in columns.items())), chunk)


def lagged(samples: DataFrame, column: str = "value", name: str = "previous", chunk: int = CHUNK) -> DataFrame:
    """samples with the previous sample's value (null at the start)."""
    order = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx")
    return own_rows(with_halo(samples, 1, 0, chunk).withColumn(name, F.lag(column).over(order)), chunk)


def prefix_sums(samples: DataFrame, column: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Running sum including the row, in two levels: sums of chunks first, then within each chunk."""
    cut = samples.withColumn("chunk", F.floor(F.col("sample_idx") / chunk))
    totals = cut.groupBy("recording_id", "chunk").agg(F.sum(column).alias("__sum"))
    before = Window.partitionBy("recording_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.select("recording_id", "chunk", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__head"))
    inside = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("__in", F.sum(column).over(inside)).join(heads, ["recording_id", "chunk"]).withColumn(name, F.col("__head") + F.col("__in")).drop("__head", "__in", "chunk")


def shared(spark: SparkSession) -> str:
    """The application's folder below the one that executors share: that of spark.checkpoint.dir, or the warehouse where it is
    unset. clean() deletes it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    base = base if "://" in base or base.startswith("file:") else f"file://{os.path.abspath(base)}"
    return f"{base.rstrip('/')}/tracelake-{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; tables that still read from there end with it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settled(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again. Iterations stay short plans that way."""
    path = f"{shared(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
