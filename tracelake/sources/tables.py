"""Signals from tables: rows (recording_id, sample_idx, value), indices dense from 0 in each recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as one long recording."""
    return table(spark, sf_dir, "events").select(F.lit("events").alias("recording_id"), F.col("event_id").alias("sample_idx"), "value")


def user_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per user of the events table, in the order of events."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), "value")


def supplier_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recording per supplier of lineitem: quantities in the order of orders and lines."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("recording_id"), (F.row_number().over(order) - 1).cast("long").alias("sample_idx"), F.col("l_extendedprice").alias("value"))
