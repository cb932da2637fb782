"""The detection plan's signal stages over chunks: one row holds some ten thousand samples as a binary array.

A chunk carries `halo` samples of its neighbours on both sides, so that percentile windows need no exchange of samples. What
rounds pass on is small: centres of the baseline (a chunk needs its neighbours' only) and one noise level per recording.
Residual and mask are worked out anew from those wherever they are needed. Exact medians come from histograms that
chunks count and Spark sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.deploy import ship
from tracelake.functions import windows as W
from tracelake.functions.filters import zero_phase_kernel
from tracelake.operators.baseline import DIRECT
from tracelake.operators.layout import CHUNK, settled, with_halo
from tracelake.operators.noise import MAD_SCALE

KIND = "recording_id string, chunk long, n long, first long, data binary, trend binary"
#: Parts of a histogram round, and values that are sorted at once at its end.
PARTS = 1 << 14
FEW = 4096


@dataclass(frozen=True)
class Layout:
    """Samples of a chunk, and samples that it borrows on both sides."""

    size: int
    halo: int


def layout_of(window: int) -> Layout:
    """Chunks as long as a window at least: then a chunk's neighbours hold every centre that it needs."""
    return Layout(max(CHUNK, window), window // 2)


def to_chunks(samples: DataFrame, size: int, halo: int) -> DataFrame:
    """Chunks of samples (recording_id, sample_idx, value and, if there is one, trend), indices dense from 0."""
    ship(samples.sparkSession)
    trend = "trend" in samples.columns
    n = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    rows = with_halo(samples.select("recording_id", "sample_idx", F.col("value").cast("double").alias("value"), *(["trend"] if trend else [])), halo, halo, size)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_idx")
        some = [part[c].to_numpy(float).tobytes() for c in (("value", "trend") if trend else ("value",))]
        return pd.DataFrame({"recording_id": [part["recording_id"].iloc[0]], "chunk": [part["chunk"].iloc[0]], "n": [-1], "first": [part["sample_idx"].iloc[0]], "data": [some[0]], "trend": [some[1] if trend else None]})

    packed = rows.where(F.col("chunk") * size <= F.col("sample_idx") + halo).groupBy("recording_id", "chunk").applyInPandas(pack, KIND)
    whole = packed.drop("n").join(n, "recording_id").where(F.col("chunk") * size < F.col("n"))
    return whole.select(*(f.split()[0] for f in KIND.split(", ")))


def filtered(chunks: DataFrame, layout: Layout, kernel: np.ndarray) -> DataFrame:
    """Chunks (with half a kernel more of halo) after the zero-phase filter; a recording's ends are mirrored."""
    h = len(kernel) // 2

    def one(n: int, first: int, x: np.ndarray, chunk: int) -> tuple[int, np.ndarray]:
        a, b = max(0, chunk * layout.size - layout.halo), min(n, (chunk + 1) * layout.size + layout.halo)
        at = np.arange(a - h, b + h)
        period = max(1, 2 * (n - 1))
        at = np.abs((at + period // 2) % period - period // 2) if n > 1 else np.zeros_like(at)  # mirrored, as often as a short recording needs
        got = x[np.clip(at - first, 0, len(x) - 1)]
        size = 1 << (len(got) + len(kernel) - 1).bit_length()
        if len(kernel) < 64 or not np.isfinite(got).all():
            y = np.convolve(got, kernel, mode="valid")
        else:
            y = np.fft.irfft(np.fft.rfft(got, size) * np.fft.rfft(kernel, size), size)[2 * h : 2 * h + b - a]
        return a, y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(r["n"], r["first"], np.frombuffer(r["data"]), r["chunk"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array([a for a, _ in out], pa.int64()), pa.array([y.tobytes() for _, y in out], pa.binary()), batch.column(5)], schema=batch.schema)

    return chunks.mapInArrow(run, KIND)


class Piece:
    """One chunk with the baseline that its centres draw."""

    def __init__(self, row: dict, layout: Layout, window: int, direct: bool):
        self.n, self.chunk, self.first = row["n"], row["chunk"], row["first"]
        self.x = np.frombuffer(row["data"])
        self.layout, self.window = layout, window
        self.step = 1 if direct else max(1, window // 4)
        self.total = -(-self.n // self.step)
        self.direct = direct
        self.own = slice(self.chunk * layout.size - self.first, min(self.n, (self.chunk + 1) * layout.size) - self.first)
        self.row = row

    def line(self, name: str, part: slice) -> np.ndarray:
        """Baseline that the centres in column `name` draw."""
        s0, centres = self.row[f"{name}_from"], np.frombuffer(self.row[name])
        return W.smooth_lines(centres, s0, self.total, self.step, self.n, self.window, self.first + part.start, part.stop - part.start)

    def residual(self, name: str, all_: bool = False) -> np.ndarray:
        """Own samples (or all) without that baseline."""
        part = slice(0, len(self.x)) if all_ else self.own
        return self.x[part] - self.line(name, part)

    def centres(self, ok: np.ndarray, percentile: float) -> tuple[int, np.ndarray]:
        """(number of the first, values) of the centres among own samples, from usable samples in their windows."""
        begin, end = self.chunk * self.layout.size, min(self.n, (self.chunk + 1) * self.layout.size)
        s = np.arange(-(-begin // self.step), -(-end // self.step))
        way = W.every_percentile if self.direct else W.some_percentiles
        return int(s[0]) if len(s) else -(-begin // self.step), way(self.x, ok & ~np.isnan(self.x), s * self.step - self.first, self.window // 2, percentile)


def within(residual: np.ndarray, noise: float, n_sigma: float) -> np.ndarray:
    limit = n_sigma * noise
    return (residual < limit) & (residual > -limit)


def _mapped(chunks: DataFrame, layout: Layout, window: int, kernel: Callable[[Piece], list[tuple]], schema: str) -> DataFrame:
    """Rows that a kernel gives for each chunk."""
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "int": pa.int32(), "boolean": pa.bool_()}
    form = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    direct = window <= DIRECT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = kernel(Piece(row, layout, window, direct))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, form.field(n).type) for n, c in zip(names, zip(*found, strict=True), strict=True)], schema=form)

    return chunks.mapInArrow(run, schema)


def neighbours(centres: DataFrame) -> DataFrame:
    """(recording_id, chunk, s0, v): for each chunk the centres of itself and its neighbours, one after the other."""
    near = centres.withColumn("chunk", F.explode(F.array(F.col("chunk") - 1, F.col("chunk"), F.col("chunk") + 1)))
    both = near.groupBy("recording_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("s0", "v"))).alias("all"))
    return both.select("recording_id", "chunk", F.col("all")[0]["s0"].alias("s0"), F.expr("aggregate(all, cast('' AS binary), (b, x) -> concat(b, x.v))").alias("v"))


def with_centres(chunks: DataFrame, near: DataFrame, name: str) -> DataFrame:
    """Chunks with the centres that neighbours() gives (columns name and name_from)."""
    return chunks.join(near.withColumnRenamed("s0", f"{name}_from").withColumnRenamed("v", name), ["recording_id", "chunk"])


def chunk_statistics(chunks: DataFrame, layout: Layout, window: int, values: Callable[[Piece], np.ndarray], ranks: dict[str, str]) -> DataFrame:
    """(recording_id, n, a column per name in ranks): exact order statistics of the values that chunks give.

    ranks: SQL expressions in n, from 0. First extremes and counts; then histograms over what is left of a recording's range,
    summed over its chunks, until the part with the rank is small enough to be sorted.
    """

    def extremes(p: Piece) -> list[tuple]:
        v = values(p)
        return [(p.row["recording_id"], len(v), float(v.min()), float(v.max()))] if len(v) else []

    span = _mapped(chunks, layout, window, extremes, "recording_id string, n long, low double, high double")
    span = span.groupBy("recording_id").agg(F.sum("n").alias("count"), F.min("low").alias("low"), F.max("high").alias("high"))
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.expr(e.replace("n", "count")).cast("long").alias("rank")) for k, e in ranks.items())))
    state = settled(span.withColumn("r", named).select("recording_id", "r.name", "r.rank", F.lit(0).cast("long").alias("before"), "count", F.col("count").alias("left"), "low", "high"))
    open_ = (F.col("high") > F.col("low")) & (F.col("left") > FEW)

    def attached(some: DataFrame) -> DataFrame:
        goals = some.groupBy("recording_id").agg(F.to_json(F.collect_list(F.struct("name", "rank", "before", F.col("low").cast("string").alias("low"), F.col("high").cast("string").alias("high")))).alias("goals"))
        return chunks.join(goals, "recording_id")

    def goals_of(p: Piece) -> list[dict]:
        import json

        return json.loads(p.row["goals"])

    def histogram(p: Piece) -> list[tuple]:
        v, out = values(p), []
        for g in goals_of(p):
            low, high = float(g["low"]), float(g["high"])
            inside = v[(v >= low) & (v <= high)]
            if not len(inside):
                continue
            part = np.minimum(np.floor((inside / 2 - low / 2) / (high / 2 - low / 2) * PARTS), PARTS - 1).astype(np.int64)
            order = np.argsort(part, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) > 0]))
            ranked = inside[order]
            n = np.diff(np.append(head, len(order)))
            out += [(p.row["recording_id"], g["name"], g["rank"], g["before"], int(k), int(c), float(a), float(b)) for k, c, a, b in zip(part[order][head], n, np.minimum.reduceat(ranked, head), np.maximum.reduceat(ranked, head), strict=True)]
        return out

    while not state.where(open_).isEmpty():
        counted = _mapped(attached(state.where(open_)), layout, window, histogram, "recording_id string, name string, rank long, before long, part long, n long, low double, high double")
        counted = counted.groupBy("recording_id", "name", "rank", "before", "part").agg(F.sum("n").alias("left"), F.min("low").alias("low"), F.max("high").alias("high"))
        upto = F.col("before") + F.sum("left").over(Window.partitionBy("recording_id", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, 0))  # PARTS rows at most
        found = counted.withColumn("upto", upto).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("left") <= F.col("rank")))
        found = found.select("recording_id", "name", "rank", (F.col("upto") - F.col("left")).alias("before"), "left", "low", "high")
        count = state.select("recording_id", "count").distinct()
        state = settled(found.join(count, "recording_id").select(*state.columns).unionByName(state.where(~open_)))

    def rest(p: Piece) -> list[tuple]:
        v = values(p)
        return [(p.row["recording_id"], g["name"], g["rank"], g["before"], float(x)) for g in goals_of(p) for x in v[(v >= float(g["low"])) & (v <= float(g["high"]))]]

    flat = state.where("low = high").select("recording_id", "count", "name", F.col("low").alias("found"))
    last = _mapped(attached(state.where("low < high")), layout, window, rest, "recording_id string, name string, rank long, before long, v double")
    ordered = last.groupBy("recording_id", "name", "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("l"))
    ordered = ordered.join(state.select("recording_id", "count").distinct(), "recording_id").select("recording_id", "count", "name", F.element_at("l", (F.col("rank") - F.col("before") + 1).cast("int")).alias("found"))
    return flat.unionByName(ordered).groupBy("recording_id", "count").agg(*(F.max(F.when(F.col("name") == k, F.col("found"))).alias(k) for k in ranks))


MEDIAN = {"lower": "floor((n - 1) / 2)", "upper": "floor(n / 2)"}


def _median(stats: DataFrame, name: str) -> DataFrame:
    middle = F.when(F.col("lower") == F.col("upper"), F.col("lower")).otherwise(0.5 * F.col("lower") + 0.5 * F.col("upper"))
    return stats.select("recording_id", "count", middle.alias(name))


#: Bins of a residual histogram, and how far it reaches on both sides in noise levels of the round before.
BINS = 1 << 14
REACH = 16.0


def _between(counts: np.ndarray, first: int, rank: int) -> int:
    """Number of the bin that holds a rank, `first` values lying below all bins; -1 if none does."""
    upto = first + np.cumsum(counts)
    return int(np.searchsorted(upto, rank, side="right")) if first <= rank < upto[-1] else -1


def _intervals(hist: np.ndarray, below: int, total: int, low: float, width: float) -> tuple[float, ...] | None:
    """(from, to, values below) of the median's bins, (about, from, to) of the deviation from it, from a histogram; None if
    the histogram does not hold them."""
    a, b = _between(hist, below, (total - 1) // 2), _between(hist, below, total // 2)
    if a < 0 or b < 0 or not np.isfinite(width) or width <= 0:
        return None
    center = low + width * (a + b + 1) / 2
    away = np.abs(low + width * (np.arange(len(hist)) + 0.5) - center)
    order = np.argsort(away, kind="stable")
    c, d = _between(hist[order], 0, (total - 1) // 2), _between(hist[order], 0, total // 2)
    if c < 0 or d < 0:
        return None
    slack = (b - a + 3) * width
    near, far = away[order[c]] - slack, away[order[d]] + slack
    if center - far < low or center + far > low + width * len(hist):
        return None
    return low + width * (a - 0.5), low + width * (b + 1.5), center, max(near, 0.0), far


def noise_of(chunks: DataFrame, layout: Layout, window: int, masked: Callable[[Piece], tuple[np.ndarray, np.ndarray]], method: str) -> DataFrame:
    """(recording_id, noise): of masked residuals, of all where at most ten are masked in.

    masked(piece) gives own residuals and their mask. The median and the median deviation are exact and take two passes: a
    histogram over `low` to `high` of each recording (columns of chunks) bounds both, then the few values between the
    bounds are gathered. Recordings whose histogram does not hold them go through chunk_statistics.
    """
    ship(chunks.sparkSession)

    def histogram(p: Piece) -> list[tuple]:
        r, m = masked(p)
        own = r[np.isfinite(r)]
        some = r[np.isfinite(r) & m]
        out = [p.row["recording_id"], p.row["low"], p.row["high"]]
        for v in (some, own):
            at = np.floor((v - p.row["low"]) / ((p.row["high"] - p.row["low"]) / BINS or 1.0))
            inside = (at >= 0) & (at < BINS)
            out += [len(v), int((at < 0).sum()), float(v.sum()), np.bincount(at[inside].astype(np.int64), minlength=BINS).astype(np.int32).tobytes() if len(v) else b""]
        return [tuple(out)]

    form = "recording_id string, low double, high double, n0 long, b0 long, s0 double, h0 binary, n1 long, b1 long, s1 double, h1 binary"
    bounds = "recording_id string, use_all boolean, kept_n long, mean double, held boolean, clow double, chigh double, about double, near double, far double"

    def bounded(part: pd.DataFrame) -> pd.DataFrame:
        k = "1" if part["n0"].sum() <= 10 else "0"
        n = int(part[f"n{k}"].sum())
        if not n:
            return pd.DataFrame(columns=[f.split()[0] for f in bounds.split(", ")])
        hist = np.sum([np.frombuffer(h, np.int32).astype(np.int64) for h in part[f"h{k}"] if h], axis=0)
        low, high = float(part["low"].iloc[0]), float(part["high"].iloc[0])
        found = _intervals(hist, int(part[f"b{k}"].sum()), n, low, (high - low) / BINS)
        return pd.DataFrame([(part["recording_id"].iloc[0], k == "1", n, float(part[f"s{k}"].sum()) / n, found is not None, *(found or (0.0,) * 5))], columns=[f.split()[0] for f in bounds.split(", ")])

    known = settled(_mapped(chunks, layout, window, histogram, form).groupBy("recording_id").applyInPandas(bounded, bounds))
    marked = chunks.join(known, "recording_id")

    def kept(p: Piece) -> np.ndarray:
        r, m = masked(p)
        return r[np.isfinite(r) & (m | p.row["use_all"])]

    if method == "std":
        squares = _mapped(marked, layout, window, lambda p: [(p.row["recording_id"], len(v := kept(p)), float(np.sum((v - p.row["mean"]) ** 2)))], "recording_id string, n long, q double")
        got = squares.groupBy("recording_id").agg(F.sqrt(F.sum("q") / F.sum("n")).alias("got"))
    else:

        def few(p: Piece) -> list[tuple]:
            v, g = kept(p), p.row
            away = np.abs(v - g["about"])
            return [(g["recording_id"], g["kept_n"], int((v < g["clow"]).sum()), v[(v >= g["clow"]) & (v < g["chigh"])].tobytes(), int((away < g["near"]).sum()), v[(away >= g["near"]) & (away <= g["far"])].tobytes())]

        def exact(part: pd.DataFrame) -> pd.DataFrame:
            n = int(part["n"].iloc[0])

            def middle(values: np.ndarray, below: int) -> float:
                values = np.sort(values)
                a, b = values[(n - 1) // 2 - below], values[n // 2 - below]
                return float(a if a == b else 0.5 * a + 0.5 * b)

            center = middle(np.concatenate([np.frombuffer(x) for x in part["c"]]), int(part["below"].sum()))
            mad = middle(np.abs(np.concatenate([np.frombuffer(x) for x in part["d"]]) - center), int(part["closer"].sum()))
            return pd.DataFrame({"recording_id": [part["recording_id"].iloc[0]], "mad": [mad]})

        got = _mapped(marked.where("held"), layout, window, few, "recording_id string, n long, below long, c binary, closer long, d binary").groupBy("recording_id").applyInPandas(exact, "recording_id string, mad double")
        if not known.where("NOT held").isEmpty():
            rest = marked.where("NOT held")
            center = settled(_median(chunk_statistics(rest, layout, window, kept, MEDIAN), "center").drop("count"))
            off = chunk_statistics(rest.join(center, "recording_id"), layout, window, lambda p: np.abs(kept(p) - p.row["center"]), MEDIAN)
            got = got.unionByName(_median(off, "mad").drop("count"))
        got = got.select("recording_id", (MAD_SCALE * F.col("mad")).alias("got"))
    every = chunks.select("recording_id").distinct()
    return every.join(got, "recording_id", "left").select("recording_id", F.coalesce("got", F.lit(1.0)).alias("noise"))


def centre_table(chunks: DataFrame, layout: Layout, window: int, usable: Callable[[Piece], np.ndarray], percentile: float) -> DataFrame:
    """(recording_id, chunk, s0, v): centres of every chunk; where a window holds nothing usable, the upper median of all that
    is usable in the recording (0 if nothing is)."""

    def kernel(p: Piece) -> list[tuple]:
        s0, v = p.centres(usable(p), percentile)
        return [(p.row["recording_id"], p.chunk, s0, v.tobytes(), bool(np.isnan(v).any()))]

    found = settled(_mapped(chunks, layout, window, kernel, "recording_id string, chunk long, s0 long, v binary, open boolean"))
    if found.where("open").isEmpty():
        return found.drop("open")
    spare = chunk_statistics(chunks, layout, window, lambda p: p.x[p.own][(usable(p) & ~np.isnan(p.x))[p.own]], {"spare": "floor(n / 2)"})

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [np.where(np.isnan(a := np.frombuffer(x)), s, a).tobytes() for x, s in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(v, pa.binary())], names=["recording_id", "chunk", "s0", "v"])

    both = found.join(spare.select("recording_id", "spare"), "recording_id", "left").select("recording_id", "chunk", "s0", "v", F.coalesce("spare", F.lit(0.0)).alias("spare"))
    return settled(both.mapInArrow(filled, "recording_id string, chunk long, s0 long, v binary"))


def estimate_baseline(chunks: DataFrame, layout: Layout, window: int, iterations: int = 3, percentile: float = 90.0, n_sigma: float = 5.0, noise_estimation: str = "mad") -> DataFrame:
    """Chunks with centres of the final baseline (`base`, `base_from`) and `noise`: a provisional round, `iterations` rounds
    with what lies within n_sigma of the last one, then the median."""
    base = chunks

    def usable(all_: bool) -> Callable[[Piece], np.ndarray]:
        """Mask of the last round: what lies within, or all where too little does."""

        def mask(p: Piece) -> np.ndarray:
            return within(p.residual("base", all_=all_), p.row["noise"], n_sigma) | p.row["all_in"]

        return mask

    def guarded(state: DataFrame, share: float) -> DataFrame:
        """State with `all_in`: whether too few samples lie within; and the range of the next histogram."""
        counts = _mapped(state, layout, window, lambda p: [(p.row["recording_id"], int(within(r := p.residual("base"), p.row["noise"], n_sigma).sum()), len(r), p.row["noise"])], "recording_id string, m long, k long, noise double")
        few = counts.groupBy("recording_id").agg((F.sum("m") < F.greatest(F.lit(10), F.floor(F.sum("k") * share))).alias("all_in"), (-REACH * F.first("noise")).alias("low"), (REACH * F.first("noise")).alias("high"))
        return state.join(settled(few), "recording_id")

    def scored(state: DataFrame, centres: DataFrame, masked: Callable[[Piece], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        """Chunks with the new centres and the noise about them."""
        near = settled(neighbours(centres))
        noise = settled(noise_of(with_centres(state, near, "next"), layout, window, masked, noise_estimation))
        return with_centres(base, near, "base").join(noise, "recording_id")

    def extremes(p: Piece) -> list[tuple]:
        r = p.residual("next")
        r = r[np.isfinite(r)]
        return [(p.row["recording_id"], float(r.min()), float(r.max()))] if len(r) else []

    first = settled(neighbours(centre_table(base, layout, window, lambda p: np.ones(len(p.x), bool), percentile)))
    span = settled(_mapped(with_centres(base, first, "next"), layout, window, extremes, "recording_id string, low double, high double").groupBy("recording_id").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    begun = with_centres(base, first, "next").join(span, "recording_id", "left").withColumn("low", F.coalesce("low", F.lit(0.0))).withColumn("high", F.coalesce("high", F.lit(0.0)))
    noise = settled(noise_of(begun, layout, window, lambda p: (r := p.residual("next"), np.ones(len(r), bool)), noise_estimation))
    state = guarded(with_centres(base, first, "base").join(noise, "recording_id"), 0.0)
    for _ in range(iterations):
        centres = centre_table(state, layout, window, usable(True), percentile)
        state = guarded(scored(state, centres, lambda p: (p.residual("next"), usable(False)(p))), 0.005)
    centres = centre_table(state, layout, window, usable(True), 50.0)
    return scored(state, centres, lambda p: (p.residual("next"), usable(False)(p)))


def rows_of(level: DataFrame, layout: Layout, window: int, spans: DataFrame | None = None) -> DataFrame:
    """(recording_id, sample_idx, value, baseline, residual) of all samples, or of those in spans (recording_id, start_idx,
    end_idx), each once per span with its start_idx and end_idx."""
    kind = "recording_id string, sample_idx long, value double, baseline double, residual double" + (", start_idx long, end_idx long" if spans is not None else "")
    names = [f.split()[0] for f in kind.split(", ")]
    direct, some = window <= DIRECT, spans is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                p = Piece(row, layout, window, direct)
                x, line = p.x[p.own], p.line("base", p.own)
                r = x - line
                line = line + (np.frombuffer(row["trend"])[p.own] if row["trend"] is not None else 0.0)
                begin = p.chunk * layout.size
                for a, b in [(s["start_idx"], s["end_idx"]) for s in row["spans"]] if some else [(begin, begin + len(x))]:
                    part = slice(max(0, a - begin), max(0, min(len(x), b - begin)))
                    n = part.stop - part.start
                    if n <= 0:
                        continue
                    columns = [pa.array([row["recording_id"]] * n), pa.array(np.arange(begin + part.start, begin + part.stop)), pa.array(line[part] + r[part]), pa.array(line[part]), pa.array(r[part])]
                    if some:
                        columns += [pa.array(np.full(n, a)), pa.array(np.full(n, b))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    if spans is not None:
        level = with_spans(level, layout, spans)
    return level.mapInArrow(run, kind)


def with_spans(level: DataFrame, layout: Layout, spans: DataFrame) -> DataFrame:
    """Chunks with an array of the spans that reach into their own samples; chunks without any go."""
    cut = spans.select("recording_id", "start_idx", "end_idx").distinct().where("start_idx < end_idx").withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start_idx") / layout.size), F.floor((F.col("end_idx") - 1) / layout.size))))
    return level.join(cut.groupBy("recording_id", "chunk").agg(F.collect_list(F.struct("start_idx", "end_idx")).alias("spans")), ["recording_id", "chunk"])


def drawn_residuals(level: DataFrame, layout: Layout, window: int, most: int, seed: int = 0) -> DataFrame:
    """(recording_id, draw, sample_idx, residual): samples whose seeded hash lies in the recording's share, half as many again as
    `most`; a group keeps the `most` smallest draws."""

    def kernel(p: Piece) -> list[tuple]:
        r = p.residual("base")
        at = np.arange(len(r), dtype=np.uint64) + np.uint64(p.chunk * layout.size)
        h = (at + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = (h ^ (h >> np.uint64(32))) >> np.uint64(1)
        some = np.flatnonzero((h < np.uint64(int(min(1.0, (1.5 * most + 100) / p.n) * (2**63 - 1)))) & ~np.isnan(r))
        return list(zip([p.row["recording_id"]] * len(some), h[some].astype(np.int64).tolist(), at[some].astype(np.int64).tolist(), r[some].tolist(), strict=True))

    return _mapped(level, layout, window, kernel, "recording_id string, draw long, sample_idx long, residual double")


def runs_beyond(level: DataFrame, layout: Layout, window: int, down: bool) -> DataFrame:
    """(recording_id, start_idx, end_idx) of runs, cut at chunk borders, of samples beyond the column `cut` (below it for
    down) that do not lie within `open_std` of `open_mean`, where that is known."""

    def kernel(p: Piece) -> list[tuple]:
        r, cut, mean, std = p.residual("base"), p.row["cut"], p.row["open_mean"], p.row["open_std"]
        mask = r < cut if down else r > cut
        if mean is not None:
            mask &= np.abs(r - mean) > std
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))) + p.chunk * layout.size
        return [(p.row["recording_id"], a, b) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True)]

    return _mapped(level, layout, window, kernel, "recording_id string, start_idx long, end_idx long")


def span_sums(level: DataFrame, layout: Layout, window: int, spans: DataFrame) -> DataFrame:
    """(recording_id, start_idx, end_idx, k, r, spread, value, baseline, area): count, mean residual and its population
    deviation, mean value and baseline, and sum of absolute residuals of each span, joined from its chunks' parts."""

    def kernel(p: Piece) -> list[tuple]:
        r = p.residual("base")
        line = p.x[p.own] - r + (np.frombuffer(p.row["trend"])[p.own] if p.row["trend"] is not None else 0.0)
        begin, out = p.chunk * layout.size, []
        for s in p.row["spans"]:
            part = slice(max(0, s["start_idx"] - begin), max(0, min(len(r), s["end_idx"] - begin)))
            v = r[part]
            if len(v):
                out.append((p.row["recording_id"], s["start_idx"], s["end_idx"], len(v), float(v.sum()), float(((v - v.mean()) ** 2).sum()), float(line[part].sum()), float(np.abs(v).sum())))
        return out

    parts = _mapped(with_spans(level, layout, spans), layout, window, kernel, "recording_id string, start_idx long, end_idx long, k long, s double, q double, b double, area double")
    key = ["recording_id", "start_idx", "end_idx"]
    whole = parts.groupBy(*key).agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("b").alias("b"), F.sum("area").alias("area"), F.collect_list(F.struct("k", "s", "q")).alias("parts"))
    mean = F.col("s") / F.col("k")
    spread = F.expr("aggregate(parts, 0D, (a, x) -> a + x.q + x.k * pow(x.s / x.k - s / k, 2))")
    return whole.select(*key, "k", mean.alias("r"), F.sqrt(spread / F.col("k")).alias("spread"), ((F.col("s") + F.col("b")) / F.col("k")).alias("value"), (F.col("b") / F.col("k")).alias("baseline"), "area")


def lowpass_kernel(kind: str, order: int, cutoff: float, rate: float) -> np.ndarray:
    return zero_phase_kernel(kind, order, cutoff, rate)
