"""Connected components of very large edge lists, by alternating large-star and small-star steps.

Every step is a group-by and a join on written tables; nothing is collected. Edges shrink to stars on the smallest
reachable id, so the last table is at once the answer. Edge lists of up to IN_TASK rows, which are counted first, need no
steps: one task joins them in memory, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import trim, written

#: Edges that one task takes at most: 16 bytes each, and some arrays of that size.
IN_TASK = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _single_root(edges: DataFrame) -> bool:
    """Whether every leaf has one root."""
    return edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _is_star(edges: DataFrame) -> bool:
    """Whether no node is both a leaf and a root: then large and small stars would change nothing."""
    return edges.select("u").join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty()


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, smallest reachable id of each) of an edge list in memory."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(up := root[root], root):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if parts:
            ids, low = joined(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(low)], names=["id", "component"])
        trim()

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id that is reachable.

    Self loops, repeated edges and either direction are fine; no edges give no rows.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    if now.count() <= IN_TASK:
        return _in_one_task(now)
    while True:
        now = written(_small_star(_large_star(now)), "edges")
        if _single_root(now) and _is_star(now):
            break
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
