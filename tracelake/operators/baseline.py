"""The local baseline: masked nearest-rank percentiles in sliding windows, smoothed, with the mask refined in rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.deploy import ship
from tracelake.operators import layout
from tracelake.operators.noise import MAD_SCALE
from tracelake.operators.quantiles import medians, upper_medians

#: Widest window, in samples, that is worked out around every sample; for wider ones every window/4-th centre is. The window is a
#: setting of the run, so no recording's baseline depends on how many samples it or another one has.
DIRECT = 1024


def nearest_rank(values: Column, percentile: float) -> Column:
    """Element of a sorted array at round(p / 100 * (n - 1)), halves up; null for an empty array."""
    at = F.floor(percentile / 100.0 * (F.size(values) - 1) + 0.5).cast("int") + 1
    return F.when(F.size(values) > 0, F.element_at(values, at))


def _usable(mask: str | None) -> Column:
    ok = F.col("value").isNotNull() & ~F.isnan("value")
    return F.when(ok & F.col(mask), F.col("value")) if mask else F.when(ok, F.col("value"))


def fallback(samples: DataFrame, mask: str | None) -> DataFrame:
    """Upper median of all usable samples, for windows without any (0 if there are none): one row per recording."""
    upper = upper_medians(samples, _usable(mask), "spare")
    return samples.select("recording_id").distinct().join(upper, "recording_id", "left").select("recording_id", F.coalesce("spare", F.lit(0.0)).alias("spare"))


def percentile_direct(samples: DataFrame, window: int, percentile: float, mask: str | None = None, chunk: int = layout.CHUNK) -> DataFrame:
    """Adds `baseline`: percentile of the usable samples in [c - h, c + h) around every sample, h = window div 2."""
    h = window // 2
    got = layout.over_chunks(samples, h, h - 1, {"__values": F.collect_list(_usable(mask))}, chunk)
    ranked = got.withColumn("baseline", nearest_rank(F.sort_array("__values"), percentile)).drop("__values")
    spare = fallback(samples, mask) if mask else samples.select("recording_id").distinct().withColumn("spare", F.lit(0.0))
    return ranked.join(spare, "recording_id").withColumn("baseline", F.coalesce("baseline", "spare")).drop("spare")


def percentile_sparse(samples: DataFrame, window: int, percentile: float, mask: str | None = None) -> DataFrame:
    """As percentile_direct, at every window/4-th centre only, straight lines between (and past the last centre).

    Each chunk, with half a window borrowed on both sides, works out its own centres by selection; only one row per centre
    comes back.
    """
    h, step = window // 2, max(1, window // 4)
    n = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n")).withColumn("centres", F.ceil(F.col("n") / step))
    i = F.col("sample_idx")
    chunk = max(layout.CHUNK, 8 * h)
    usable = samples.select("recording_id", "sample_idx", _usable(mask).cast("double").alias("v")).where("v IS NOT NULL").join(n, "recording_id")
    ship(samples.sparkSession)

    def centres_of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_idx")
        at, x, k = part["sample_idx"].to_numpy(), part["v"].to_numpy(), int(part["chunk"].iloc[0])
        s = np.arange(-(-k * chunk // step), min(-(-(k + 1) * chunk // step), int(part["centres"].iloc[0])))
        low, high = np.searchsorted(at, s * step - h), np.searchsorted(at, s * step + h)
        some = high > low
        rank = np.floor(percentile / 100.0 * (high - low - 1) + 0.5).astype(int)
        v = [float(np.partition(x[a:b], r)[r]) for a, b, r in zip(low[some], high[some], rank[some], strict=True)]
        return pd.DataFrame({"recording_id": part["recording_id"].iloc[0], "s": s[some], "v": v})

    ranked = layout.with_halo(usable, h, h, chunk).groupBy("recording_id", "chunk").applyInPandas(centres_of, "recording_id string, s long, v double")
    every = n.select("recording_id", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("centres") - 1)).alias("s"))
    ranked = layout.settled(ranked)  # a row per centre, read twice below
    full = every.join(ranked, ["recording_id", "s"], "left")
    if not every.join(ranked, ["recording_id", "s"], "left_anti").isEmpty():  # the median of all is dear and seldom needed
        full = full.join(fallback(samples, mask), "recording_id").withColumn("v", F.coalesce("v", "spare"))
    left = full.select("recording_id", F.col("s").alias("left"), F.col("v").alias("v0"), "centres")
    right = full.select("recording_id", (F.col("s") - 1).alias("left"), F.col("v").alias("v1"))
    lines = left.join(right, ["recording_id", "left"], "left")
    at = samples.join(n.select("recording_id", "centres"), "recording_id").withColumn("left", F.greatest(F.least(F.floor(i / step), F.col("centres") - 2), F.lit(0))).drop("centres")
    part = (i - F.col("left") * step) / F.lit(float(step))
    return at.join(lines, ["recording_id", "left"]).withColumn("baseline", F.coalesce(F.col("v0") + part * (F.col("v1") - F.col("v0")), F.col("v0"))).drop("left", "v0", "v1", "centres")


#: Widths up to this are averaged by a sliding frame, wider ones by differences of running sums; the results are the same.
NARROW = 64


def smooth(samples: DataFrame, window: int, column: str = "baseline", chunk: int = layout.CHUNK) -> DataFrame:
    """Moving mean of width max(3, window div 10), made odd, cut off at the ends; short recordings stay as they are."""
    width = max(3, window // 10)
    width += 1 - width % 2
    h = width // 2
    n = samples.groupBy("recording_id").agg(F.count("*").alias("__n"))
    if width <= NARROW:
        got = layout.over_chunks(samples, h, h, {"__mean": F.avg(column)}, chunk)
    else:
        got = _running_mean(samples, h, column, max(chunk, 8 * h))
    return got.join(n, "recording_id").withColumn(column, F.when(F.col("__n") >= width, F.col("__mean")).otherwise(F.col(column))).drop("__n", "__mean")


def _running_mean(samples: DataFrame, h: int, column: str, chunk: int) -> DataFrame:
    """Adds __mean over h samples to both sides, in constant time a row whatever the width."""
    order = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = layout.with_halo(samples, h, h, chunk).withColumn("__s", F.sum(column).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__k", F.row_number().over(order))
    high, low = F.coalesce(F.lead("__s", h).over(order), F.last("__s").over(whole)), F.coalesce(F.lag("__s", h + 1).over(order), F.lit(0.0))
    count = F.least(F.col("__k") + h, F.last("__k").over(whole)) - F.greatest(F.col("__k") - h - 1, F.lit(0))
    return layout.own_rows(sums.withColumn("__mean", (high - low) / count).drop("__s", "__k"), chunk)


def local_baseline(samples: DataFrame, window: int, percentile: float, mask: str | None = None) -> DataFrame:
    """Adds the smoothed `baseline`, directly or at sparse centres as the window asks."""
    got = (percentile_direct if window <= DIRECT else percentile_sparse)(samples, window, percentile, mask)
    return smooth(got, window)


def within(column: str, limit: Column) -> Column:
    """-limit < x < limit, false for NaN."""
    x = F.col(column)
    return ~F.isnan(x) & (x < limit) & (x > -limit)


def _noise(samples: DataFrame, method: str) -> DataFrame:
    """Noise of masked samples, or of all where at most ten are masked in."""
    count = samples.groupBy("recording_id").agg(F.count_if("mask").alias("m"))
    own = samples.join(count, "recording_id").where((F.col("m") <= 10) | F.col("mask"))
    if method == "std":
        return own.groupBy("recording_id").agg(F.coalesce(F.stddev_pop(F.when(~F.isnan("residual"), F.col("residual"))), F.lit(1.0)).alias("noise"))
    off = own.join(medians(own, F.col("residual"), name="center"), "recording_id")
    mad = medians(off, F.abs(F.col("residual") - F.col("center")), name="mad")
    return count.join(mad, "recording_id", "left").select("recording_id", F.coalesce(MAD_SCALE * F.col("mad"), F.lit(1.0)).alias("noise"))


def _guarded(samples: DataFrame, limit: Column, share: float) -> DataFrame:
    """Mask by limit; where too few samples are left, all count."""
    masked = samples.withColumn("mask", within("residual", limit))
    enough = masked.groupBy("recording_id").agg((F.count_if("mask") >= F.greatest(F.lit(10), F.floor(F.count("*") * share))).alias("ok"))
    return masked.join(enough, "recording_id").withColumn("mask", F.col("mask") | ~F.col("ok")).drop("ok", "noise")


def estimate_baseline(samples: DataFrame, rate: float, window_sec: float = 5.0, iterations: int = 3, percentile: float = 90.0, n_sigma: float = 5.0, noise_estimation: str = "mad") -> DataFrame:
    """samples with baseline, residual, mask and noise: provisional round, `iterations` rounds, then the median.

    Each round is written, so that a plan never holds more than one; nothing is collected but sample counts' extremes.
    """
    window = max(1, int(window_sec * rate))
    window += 1 - window % 2
    own = samples.columns

    def round_(df: DataFrame, p: float, mask: str | None) -> DataFrame:
        got = local_baseline(df, window, p, mask)
        return layout.settled(got.withColumn("residual", F.col("value") - F.col("baseline")))

    first = round_(samples, percentile, None).withColumn("mask", F.lit(True))
    now = layout.settled(_guarded(first.join(_noise(first, noise_estimation), "recording_id"), n_sigma * F.col("noise"), 0.0))
    for _ in range(iterations):
        got = round_(now.select(*own, "mask"), percentile, "mask")
        now = layout.settled(_guarded(got.join(_noise(got, noise_estimation), "recording_id"), n_sigma * F.col("noise"), 0.005))
    last = round_(now.select(*own, "mask"), 50.0, "mask")
    return layout.settled(last.join(_noise(last, noise_estimation), "recording_id"))


def detrend_linear(samples: DataFrame, points: int = 10_000) -> DataFrame:
    """Adds `trend` and `detrended`: least squares over every max(1, n div points)-th sample."""
    n = samples.groupBy("recording_id").agg(F.count("*").alias("n"))
    thin = samples.join(n, "recording_id").where(F.col("sample_idx") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0)
    line = thin.groupBy("recording_id").agg(F.regr_slope("value", "sample_idx").alias("slope"), F.regr_intercept("value", "sample_idx").alias("intercept"))
    return samples.join(line, "recording_id").withColumn("trend", F.col("intercept") + F.col("slope") * F.col("sample_idx")).withColumn("detrended", F.col("value") - F.col("trend")).drop("slope", "intercept")


def detrend_polynomial(samples: DataFrame, order: int = 3, points: int = 10_000, rounds: int = 3, n_sigma: float = 3.0) -> DataFrame:
    """Adds `trend` and `detrended`: a polynomial over scaled time, outliers dropped in rounds.

    Sums of powers are the only thing that leaves the executors; a small system per recording is solved for the coefficients.
    """
    import numpy as np

    span = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    thin = samples.join(span, "recording_id").where(F.col("sample_idx") % F.greatest(F.lit(1), F.floor(F.col("n") / points)) == 0)
    thin = layout.settled(thin.withColumn("x", 2.0 * F.col("sample_idx") / F.col("n") - 1.0).select("recording_id", "x", "value").withColumn("use", ~F.isnan("value")))
    spark = samples.sparkSession
    names = [f"c{k}" for k in range(order + 1)]

    def curve(x: str) -> Column:
        out = F.col(names[-1])
        for c in reversed(names[:-1]):
            out = out * F.col(x) + F.col(c)
        return out

    table = None
    for _ in range(rounds + 1):
        sums = thin.where("use").groupBy("recording_id").agg(*(F.sum(F.pow("x", F.lit(k))).alias(f"p{k}") for k in range(2 * order + 1)), *(F.sum(F.pow("x", F.lit(k)) * F.col("value")).alias(f"q{k}") for k in range(order + 1)))
        rows = []
        for r in sums.collect():  # one row of sums per recording
            a = np.array([[r[f"p{i + j}"] for j in range(order + 1)] for i in range(order + 1)])
            rows.append((r["recording_id"], *(float(c) for c in np.linalg.lstsq(a, np.array([r[f"q{i}"] for i in range(order + 1)]), rcond=None)[0])))
        table = spark.createDataFrame(rows, "recording_id string, " + ", ".join(f"{c} double" for c in names))
        fitted = thin.join(table, "recording_id").withColumn("off", F.col("value") - curve("x"))
        spread = fitted.where("use").groupBy("recording_id").agg(F.stddev_pop("off").alias("sd"))
        thin = layout.settled(fitted.join(spread, "recording_id").withColumn("use", ~F.isnan("value") & (F.abs("off") <= n_sigma * F.col("sd"))).select("recording_id", "x", "value", "use"))
    out = samples.join(span, "recording_id").withColumn("x", 2.0 * F.col("sample_idx") / F.col("n") - 1.0).join(table, "recording_id")
    return out.withColumn("trend", curve("x")).withColumn("detrended", F.col("value") - F.col("trend")).drop("n", "x", *names)


def block_median(samples: DataFrame, block: int = 256) -> DataFrame:
    """(recording_id, block, center, median) of consecutive blocks."""
    return samples.groupBy("recording_id", F.floor(F.col("sample_idx") / block).alias("block")).agg(F.avg("sample_idx").alias("center"), F.median("value").alias("median"))


def block_baseline(samples: DataFrame, rate: float, window_sec: float = 2.0, percentile: float = 80.0, block: int = 256) -> DataFrame:
    """Running percentile of block medians over a window of blocks, ends repeated: a coarse baseline per block."""
    blocks = block_median(samples, block).withColumnRenamed("block", "sample_idx").withColumn("value", F.col("median"))
    h = max(1, int(window_sec * rate / block)) // 2
    spec = Window.partitionBy("recording_id", "chunk").orderBy("sample_idx").rowsBetween(-h, h)
    ranked = layout.own_rows(layout.with_halo(blocks, h, h).withColumn("baseline", nearest_rank(F.sort_array(F.collect_list("value").over(spec)), percentile)))
    return ranked.select("recording_id", F.col("sample_idx").alias("block"), "center", "baseline")
