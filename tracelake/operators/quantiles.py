"""Exact medians of very large groups: histograms narrow the range in rounds, no group is held in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.layout import settled

#: Buckets of a round; values that are sorted in one array at the end; groups up to this size use the built-in median.
BUCKETS = 1024
FEW = 8192
SMALL = 200_000


def order_statistics(values: DataFrame, by: tuple[str, ...], ranks: dict[str, Column], bucket_count: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(by, one column per name in ranks): the value of that rank (from 0, in terms of the group's count `n`) of each group.

    values: by, v, without nulls and NaN. Every round counts BUCKETS equal parts of what is left of a group's range (a sum per
    part, combined before the shuffle) and keeps the part that holds the rank; what is left in the end is a handful.
    """
    own = list(by)
    span = values.groupBy(*own).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    state = settled(span.withColumn("r", each).select(*own, "r.name", "r.rank", F.lit(0).cast("long").alias("before"), "n", "low", "high"))
    open_ = (F.col("high") > F.col("low")) & (F.col("n") > few)
    while not state.where(open_).isEmpty():
        wide = state.where(open_)
        inside = values.join(wide, own).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
        part = F.least(F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * bucket_count), F.lit(bucket_count - 1)).cast("int")
        counted = inside.groupBy(*own, "name", "rank", "before", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*own, "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # at most BUCKETS rows
        found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        state = settled(found.select(*own, "name", "rank", (F.col("upto") - F.col("n")).alias("before"), "n", "low", "high").unionByName(state.where(~open_)))
    flat = state.where("low = high").select(*own, "name", F.col("low").alias("found"))
    rest = values.join(state.where("low < high"), own).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
    sorted_ = rest.groupBy(*own, "name", "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("l"))
    every = flat.unionByName(sorted_.select(*own, "name", F.element_at("l", (F.col("rank") - F.col("before") + 1).cast("int")).alias("found")))
    return every.groupBy(*own).agg(*(F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in ranks))


def small(values: DataFrame, by: tuple[str, ...]) -> bool:
    """Whether every group is small; the number of all rows, which is cheap to have, often tells."""
    if values.count() <= SMALL:
        return True
    return (values.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= SMALL


def medians(values: DataFrame, column: Column, by: tuple[str, ...] = ("recording_id",), name: str = "median") -> DataFrame:
    """(by, name): exact median of a column's values per group, nulls and NaN left out; groups without values have no row.

    Small groups take the built-in aggregate. That is a choice of plan alone: the results are the same.
    """
    v = values.select(*by, column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if small(v, by):
        return v.groupBy(*by).agg(F.median("v").alias(name))
    n = F.col("n")
    both = order_statistics(v, by, {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2)})
    return both.select(*by, F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(0.5 * F.col("lower") + 0.5 * F.col("upper")).alias(name))


def upper_medians(values: DataFrame, column: Column, name: str, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(by, name): the upper of the middle values per group."""
    v = values.select(*by, column.cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    if small(v, by):
        return v.groupBy(*by).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY v DESC)").alias(name))
    return order_statistics(v, by, {name: F.floor(F.col("n") / 2)})
