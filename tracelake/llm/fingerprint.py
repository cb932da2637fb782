"""Quartile bucket digests: a short fingerprint of a text whose difference grows with the edits.

Hashed byte triplets are counted in BUCKETS buckets; each bucket's count is coded by its quartile among all buckets (two
bits), and the length by its logarithm. The difference of two digests sums the bucket steps and the length steps and is
bounded, so the likeness 1 - difference / bound lies between 0 and 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import prepare

BUCKETS = 128
#: Steps of the length code per doubling, and its largest value.
LENGTH_STEPS = 4
LENGTH_MOST = 255
#: Weight of a length step, and length steps that count at most; bucket steps count 0 to 3, and 3 counts as FAR.
LENGTH_WEIGHT, LENGTH_CAP, FAR = 4, 16, 6
BOUND = FAR * BUCKETS + LENGTH_WEIGHT * LENGTH_CAP
STEP = np.array([0, 1, 2, FAR])
CHUNK = 1 << 16
#: Bytes of a range of ids, about; beyond PARTS ranges they grow instead, as rows stream through a range.
PART_BYTES = 12 << 20
PARTS = 20_000
#: Drawn keys per range, from which the ranges' bounds are taken.
DRAWN = 32


def bucket_counts(data: bytes) -> np.ndarray:
    """Triplets of consecutive bytes by hashed bucket."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = np.zeros(BUCKETS, dtype=np.int64)
    for i in range(0, max(0, len(raw) - 2), CHUNK):
        b = raw[i : i + CHUNK + 2].astype(np.uint32)
        key = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - 7)
        out += np.bincount(key, minlength=BUCKETS)
    return out


def quartile_codes(counts: np.ndarray) -> np.ndarray:
    """0 to 3 per bucket: how many of the three quartiles of all buckets the count is above."""
    order = np.sort(counts)
    cuts = order[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return (counts[:, None] > cuts).sum(axis=1)


def length_code(size: int) -> int:
    return min(LENGTH_MOST, round(LENGTH_STEPS * np.log2(size + 1)))


def digest(data: bytes) -> str:
    """Hex fingerprint: two digits of length code, then the quartile codes, four buckets a byte."""
    q = quartile_codes(bucket_counts(data)).astype(np.uint8).reshape(-1, 4)
    packed = q[:, 0] | (q[:, 1] << 2) | (q[:, 2] << 4) | (q[:, 3] << 6)
    return bytes([length_code(len(data)), *packed.tolist()]).hex()


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 for the largest difference."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    p, q = ((v[1:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3 for v in (x, y))
    steps = int(STEP[np.abs(p.astype(int) - q.astype(int))].sum())
    away = min(LENGTH_CAP, abs(int(x[0]) - int(y[0])))
    return 1.0 - (steps + LENGTH_WEIGHT * away) / BOUND


def fingerprint_column(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of each text, whatever its length; null counts as empty, repeated rows stay, an empty table
    gives no rows, and a column of the name out_col gives way."""
    prepare(docs.sparkSession)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series([digest((t or "").encode()) for t in texts], dtype=object)

    return docs.withColumn(out_col, run(F.col(text_col).cast("string")))


def _range_of(edge_k: np.ndarray, edge_tie: np.ndarray, k: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of bounds (ascending pairs) below each pair (k, tie)."""
    part, stop = np.searchsorted(edge_k, k, side="left"), np.searchsorted(edge_k, k, side="right")
    for v in np.unique(k[part < stop]):  # ids that are a bound
        own = np.flatnonzero(k == v)
        a, b = part[own[0]], stop[own[0]]
        part[own] = a + np.searchsorted(edge_tie[a:b], tie[own], side="left")
    return part


def _bounds(rows: DataFrame) -> list[tuple[int, int]]:
    """Ascending keys (k, tie) that occur and cut the rows into ranges of about equal size; the last one is the largest.

    They come from a hash-drawn share of the distinct keys, DRAWN a range, so what is collected is bounded by PARTS * DRAWN
    pairs or so. They decide what a task does, never what comes out.
    """
    total, n, top = rows.agg(F.sum(F.octet_length("text")), F.count("*"), F.max(F.struct("k", "tie"))).first()
    if not n:
        return []
    parts = max(1, min(n, PARTS, -(-(total or 0) // PART_BYTES)))
    found = [(r["k"], r["tie"]) for r in rows.where(F.pmod(F.xxhash64("k", "tie", F.lit(17)), F.lit(max(1, n // (DRAWN * parts)))) == 0).select("k", "tie").distinct().collect()] if parts > 1 else []
    found.sort()
    return sorted({*(found[i * len(found) // parts] for i in range(1, parts) if found), (top["k"], top["tie"])})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, with the next document in descending id order.

    The edited text has its last floor(n_chars / 3) code points replaced by as many first ones (or all) of the next
    document's; the last document's next is the first. Rows are cut into ranges at keys that occur, so the first document of
    a range is known beforehand and is dealt to the range above as well: one shuffle, no single-task window.
    Null texts are empty; texts of any length are taken whole; null ids come last; rows of equal id follow each other by a
    hash of their text, so that they can be in several ranges; a single document is its own next; an empty table gives no
    rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    low = -(2**63)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    out = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    bounds = _bounds(rows)
    if not bounds:
        return spark.createDataFrame([], out).withColumnRenamed("id", id_col)
    sent = spark.sparkContext.broadcast(np.array(bounds, dtype=np.int64))  # PARTS pairs at most

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge_k, edge_tie = np.ascontiguousarray(sent.value[:, 0]), np.ascontiguousarray(sent.value[:, 1])
        last = len(edge_k) - 1
        for batch in batches:
            k, tie = batch.column("k").to_numpy(), batch.column("tie").to_numpy()
            part = _range_of(edge_k, edge_tie, k, tie)
            bound = (edge_k[part] == k) & (edge_tie[part] == tie)
            heads, tops = np.flatnonzero(bound & (part < last)), np.flatnonzero(bound & (part == last))
            take = np.concatenate([np.arange(len(k)), heads, tops])
            to = np.concatenate([part, part[heads] + 1, np.zeros(len(tops), np.int64)])
            role = np.repeat(np.array([0, 1, 2], np.int32), [len(k), len(heads), len(tops)])
            got = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(role), *(got.column(c) for c in ("id", "k", "tie", "text"))], names=["part", "role", "id", "k", "tie", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows_out = None, []

        def emit(own, after) -> None:
            text, mark = own[2], own[3]
            cut = len(text) // 3
            edited = (text[: len(text) - cut] + after[2][:cut]).encode() if cut else text.encode()
            other = digest(edited)
            rows_out.append((own[1], len(text), hashlib.sha256(edited).hexdigest(), mark, other, likeness(mark, other), likeness(mark, after[3])))

        for batch in batches:
            for part, role, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "role", "id", "text")), strict=True):
                if held is not None and held[0] != part:
                    held = None  # a range is over once a row of a neighbour has served as its last next
                if role and held is None:
                    continue
                now = (part, doc, text, digest(text.encode()))
                if held is not None:
                    emit(held, now)
                held = None if role else now
            if rows_out:
                cols = list(zip(*rows_out, strict=True))
                rows_out = []
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=[f.split()[0] for f in out.split(", ")])

    dealt = rows.select("id", "k", "tie", "text").mapInArrow(deal, "part long, role int, id long, k long, tie long, text string")
    ordered = dealt.repartitionById(len(bounds), F.col("part").cast("int")).sortWithinPartitions("part", "role", F.col("k").desc(), F.col("tie").desc(), "text")
    return ordered.mapInArrow(run, out).withColumnRenamed("id", id_col)
