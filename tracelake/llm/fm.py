"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is half of the square of the sum minus the sum of
squares, for each factor, so a text is scored in time linear in its distinct words. The fit sees a bounded sample of labelled
rows on the driver; scoring runs over Arrow batches of whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import hashing as H
from tracelake.llm.common import prepare, row_slices, text_bytes

WORD_BITS = 12
SLICE = 1 << 19
#: Steps of the fit at least: small samples are gone through more often.
LEAST_STEPS = 120
#: Byte classes whose shares are structure statistics; fixed values.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:", "bang": b"!?", "symbol": b"#*$%&|<>", "bracket": b"()[]{}", "line": b"\n", "other": bytes(range(128, 256))}
CLASS_OF = np.zeros(256, dtype=np.int64)
for _n, _members in enumerate(CLASSES.values(), 1):
    CLASS_OF[list(_members)] = _n
DENSE = len(CLASSES) + 5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word bucket, weight) of each distinct hashed word, rows ascending, and the dense statistics per row.

    Weights of a row are 1 + log(count), scaled to length one. Rows without words have none.
    """
    rows = len(offsets) - 1
    words, first = H.words_of(data, offsets)
    n = np.diff(first)
    row = np.repeat(np.arange(rows), n)
    pairs, counts = np.unique((row << WORD_BITS) | (words >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
    at, bucket = pairs >> WORD_BITS, pairs & ((1 << WORD_BITS) - 1)
    weight = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(at, weight * weight, rows))
    weight = weight / np.maximum(norm, 1e-9)[at] if len(at) else weight
    size = np.diff(offsets)
    kinds = len(CLASSES) + 1
    shares = np.bincount(np.repeat(np.arange(rows), size) * kinds + CLASS_OF[data], minlength=rows * kinds).reshape(rows, kinds)[:, 1:]
    # repetition: neighbours that are the same word, and distinct hashed words
    same = np.zeros(rows)
    if len(words) > 1:
        equal = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
        same = np.bincount(row[1:], equal, rows)
    distinct = np.bincount(at, minlength=rows)
    one = np.maximum(n, 1)
    dense = np.column_stack([shares / np.maximum(size, 1)[:, None], np.log1p(size), np.log1p(n), size / one / 10.0, same / one, distinct / np.minimum(one, 1 << WORD_BITS)])
    return at, bucket, weight, dense


class Machine:
    """Weights over word buckets followed by dense statistics and metadata; those are standardised and clipped, and what is
    missing counts as the mean."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.bias, self.linear, self.factors, self.mean, self.scale = bias, linear, factors, mean, scale

    def standard(self, dense: np.ndarray) -> np.ndarray:
        return np.nan_to_num(np.clip((dense - self.mean) / self.scale, -4, 4) / 4)

    def score(self, at: np.ndarray, bucket: np.ndarray, weight: np.ndarray, dense: np.ndarray) -> np.ndarray:
        rows, words = len(dense), 1 << WORD_BITS
        x = self.standard(dense)
        out = self.bias + np.bincount(at, self.linear[bucket] * weight, rows) + x @ self.linear[words:]
        for k in range(self.factors.shape[1]):
            v = self.factors[bucket, k] * weight
            d = x * self.factors[words:, k]
            total = np.bincount(at, v, rows) + d.sum(axis=1)
            out += (total * total - np.bincount(at, v * v, rows) - (d * d).sum(axis=1)) / 2
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_machine(x_words: list[tuple[np.ndarray, np.ndarray]], dense: np.ndarray, y: np.ndarray, rank: int = 6, epochs: int = 12, rate: float = 0.02, decay: float = 1e-4, batch: int = 128, seed: int = 5) -> Machine:
    """Adam on the log loss in seeded mini-batches, both labels weighing the same in sum; without rows of both labels the scores are the share of label 1."""
    words = 1 << WORD_BITS
    wide = dense.shape[1]
    size = words + wide
    rng = np.random.default_rng(seed)
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
        return Machine(float(np.log(share / (1 - share))), np.zeros(size), np.zeros((size, rank)), np.zeros(wide), np.ones(wide))
    some = np.maximum(np.isfinite(dense).sum(axis=0), 1)
    mean = np.nansum(dense, axis=0) / some
    scale = np.sqrt(np.nansum((dense - mean) ** 2, axis=0) / some) + 1e-6
    even = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(y)))
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.02, (size, rank)), mean, scale)
    flat = m.standard(dense)
    params = [np.array([m.bias]), m.linear, m.factors]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            lot = order[i : i + batch]
            x = np.zeros((len(lot), size))
            for r, j in enumerate(lot):
                x[r, x_words[j][0]] = x_words[j][1]
            x[:, words:] = flat[lot]
            total = x @ params[2]
            squares = x * x
            out = params[0][0] + x @ params[1] + (total * total - squares @ (params[2] * params[2])).sum(axis=1) / 2
            error = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y[lot]) * even[lot] / len(lot)
            slopes = [np.array([error.sum()]), x.T @ error + decay * params[1], x.T @ (error[:, None] * total) - params[2] * (squares.T @ error)[:, None] + decay * params[2]]
            step += 1
            for p, g, a, b in zip(params, slopes, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    m.bias = float(params[0][0])
    return m


def _inputs(docs: DataFrame, id_col: str, text_col: str, metadata: tuple[str, ...]) -> DataFrame:
    """(id, text, metadata as an array of doubles)."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.array(*(F.col(c).cast("double") for c in metadata)).cast("array<double>").alias("metadata"))


def _extra(column: pa.ListArray, n: int) -> np.ndarray:
    """Logarithms of the metadata of each row; what is missing or below 0 is not a number."""
    flat = np.array(column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False), dtype=float).reshape(len(column), n)
    return np.log1p(np.where(flat >= 0, flat, np.nan))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out: int = 5, metadata: tuple[str, ...] = (), **settings) -> Machine:
    """Fit on at most `sample` labelled rows with the smallest seeded hashes; ids whose crc32 leaves 0 modulo `held_out` stay
    out. metadata: numeric columns of docs that are inputs as well, by their logarithm; a null there counts as the mean.

    Null labels and ids are ignored; of repeated labels of an id the smallest counts, of repeated documents of an id the one
    with the smallest hash; texts of any length are taken whole; without labels every score is one half; other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    fold = F.crc32(F.col("id").cast("string").cast("binary"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("mark")).where(F.col("mark").isNotNull() & F.col("id").isNotNull() & (fold % held_out != 0)).groupBy("id").agg(F.min("mark").alias("y"))
    drawn = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample)  # at most `sample` rows
    own = _inputs(docs, id_col, text_col, metadata).join(F.broadcast(drawn), "id")
    rows = own.groupBy("id", "y").agg(F.min_by(F.struct("text", "metadata"), F.xxhash64("text", "metadata")).alias("d")).select("id", F.col("y").cast("int").alias("y"), "d.text", "d.metadata")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in row_slices(offsets, SLICE):
                at, bucket, weight, dense = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                dense = np.column_stack([dense, _extra(batch.column("metadata").slice(i, j - i), len(metadata))])
                cut = np.searchsorted(at, np.arange(j - i + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), batch.column("y").slice(i, j - i)]
                    + [pa.array([v[a:b].astype(t).tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for v, t in ((bucket, "<u2"), (weight, "<f4"))]
                    + [pa.array([d.astype("<f8").tobytes() for d in dense], pa.binary())],
                    names=["id", "y", "bucket", "weight", "dense"],
                )

    got = rows.mapInArrow(run, "id long, y int, bucket binary, weight binary, dense binary").collect()
    got.sort(key=lambda r: (r["id"], r["bucket"]))
    words = [(np.frombuffer(r["bucket"], "<u2").astype(np.int64), np.frombuffer(r["weight"], "<f4").astype(float)) for r in got]
    dense = np.array([np.frombuffer(r["dense"], "<f8") for r in got]).reshape(len(got), DENSE + len(metadata))
    return fit_machine(words, dense, np.array([float(r["y"] == 1) for r in got]), seed=seed, **settings)


def classify(docs: DataFrame, machine: Machine, threshold: float = 0.3, held_out: int = 5, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ()) -> DataFrame:
    """id, held_out, score (0 to 1), predicted (1 if score >= threshold) for every document.

    Null texts are scored as empty; texts of any length are scored whole; null ids are kept (held_out null); repeated rows
    are scored each; an empty table gives no rows; no column but the text and those of `metadata` (as in train) is an input.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(machine)  # (2**WORD_BITS + DENSE) * (rank + 1) numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            score = []
            for i, j in row_slices(offsets, SLICE):
                at, bucket, weight, dense = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                score.append(sent.value.score(at, bucket, weight, np.column_stack([dense, _extra(batch.column(2).slice(i, j - i), len(metadata))])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(score) if score else np.zeros(0))], names=["id", "score"])

    out = _inputs(docs, id_col, text_col, metadata).mapInArrow(run, "id long, score double")
    fold = F.crc32(F.col("id").cast("string").cast("binary")) % held_out == 0
    return out.select(F.col("id").alias(id_col), fold.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
