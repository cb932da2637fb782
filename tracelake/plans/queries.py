"""Registered queries: the engine's operators over whole driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.config import BOTH, DOWN, UP, DetectionConfig, suggest_config
from tracelake.deploy import ship
from tracelake.operators import baseline as B
from tracelake.operators import events as E
from tracelake.operators import filtering, inference, layout, matching, noise, ranges, scalars, scoring, spectrum, states, views
from tracelake.sources import sinks
from tracelake.sources.tables import event_signal, supplier_signals, table, user_signals

Query = Callable[[SparkSession, str], DataFrame]
#: Time ranges in seconds (1 Hz) that the range queries use, as a user would give them.
EXCLUDED = [(100.5, 220.25), (200.0, 300.0), (700.0, 650.0), (900.0, 950.5), (-20.0, 10.0)]
LEVEL = 35.0


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    return df.select(*(F.round(c, special.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event signal against a fixed level."""
    return event_signal(spark, sf_dir).withColumn("baseline", F.lit(LEVEL)).withColumn("residual", F.col("value") - LEVEL)


# noise


def noise_mad(spark, d):
    return rounded(noise.noise_mad(user_signals(spark, d)))


def noise_std(spark, d):
    return rounded(noise.noise_std(user_signals(spark, d)))


def noise_floor_diff(spark, d):
    return rounded(noise.noise_floor_diff(event_signal(spark, d)))


def robust_noise_std(spark, d):
    return rounded(noise.robust_noise_std(user_signals(spark, d)))


# runs and events


def find_runs(spark, d):
    return E.merge_runs(E.find_runs(event_signal(spark, d), E.above("value", 60.0)), 0)


def merge_intervals(spark, d):
    return E.merge_runs(E.find_runs(event_signal(spark, d), E.above("value", 60.0)), 3)


def event_stats(spark, d):
    s = residuals(spark, d)
    return rounded(E.event_stats(s, E.merge_runs(E.find_runs(s, E.above("residual", 40.0)), 2), 1.0))


def _detect(direction):
    def query(spark, d):
        return rounded(E.detect_events(residuals(spark, d), 1.0, -25.0, direction, 3, 1).drop("n_levels", "event_type"))

    return query


def hysteresis_events(spark, d):
    return E.hysteresis_events(event_signal(spark, d), 120.0, 50.0, 2, 1)


# baseline


def baseline_percentile_direct(spark, d):
    return rounded(B.percentile_direct(event_signal(spark, d), 51, 90.0).select("sample_idx", "baseline"))


def baseline_smooth(spark, d):
    return rounded(B.smooth(event_signal(spark, d).withColumn("baseline", F.col("value")), 51).select("sample_idx", "baseline"))


def baseline_masked_fallback(spark, d):
    masked = event_signal(spark, d).withColumn("mask", F.col("value") > 80.0)
    return rounded(B.percentile_direct(masked, 11, 50.0, "mask").select("sample_idx", "baseline"))


def baseline_sparse_interp(spark, d):
    return rounded(B.percentile_sparse(event_signal(spark, d), 401, 90.0).select("sample_idx", "baseline"))


def residual_within(spark, d):
    return residuals(spark, d).where(B.within("residual", F.lit(20.0))).select("sample_idx", F.round("residual", 6).alias("residual"))


def block_median_baseline(spark, d):
    return rounded(B.block_baseline(event_signal(spark, d), 256.0, 2.0, 80.0, 64))


def control_stats(spark, d):
    """Noise, and mean and deviation of the baseline, of the signal as a control trace."""
    from tracelake.plans.pipeline import control_statistics

    config = DetectionConfig(apply_filter=False, baseline_window_sec=51.0, baseline_iterations=1)
    return rounded(control_statistics(event_signal(spark, d), 1.0, config), 4)


def plan_events(spark, d):
    """The detection plan over chunks with a given threshold: refined baseline, runs, merging, statistics, both directions."""
    from tracelake.operators import chunked
    from tracelake.plans.pipeline import detected

    window = 51
    grid = chunked.Layout(2048, window // 2)
    chunks = layout.settled(chunked.to_chunks(event_signal(spark, d), grid.size, grid.halo))
    level = layout.settled(chunked.estimate_baseline(chunks, grid, window, 1))
    cut = spark.createDataFrame([("events", -25.0, None, None)], "recording_id string, threshold double, open_mean double, open_std double")
    return rounded(detected(level, grid, window, 1.0, cut, BOTH, 3, 1))


def suggest_figures(spark, d):
    """Settings suggested from the noise floor and the 1st and 99th percentile of the first samples: a row per recording."""
    s = event_signal(spark, d).where("sample_idx < 500000")
    p = s.groupBy("recording_id").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("p"), F.count("*").alias("n"))
    both = noise.noise_floor_diff(s).join(p, "recording_id").select("recording_id", "noise", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"), "n")
    rows = []
    for r in both.collect():
        c = suggest_config(100.0, r["n"] / 100.0, r["noise"], r["low"], r["high"])
        rows.append((r["recording_id"], r["noise"], r["low"], r["high"], c.baseline_n_sigma, c.baseline_window_sec, c.merge_gap_sec, c.gmm_max_components))
    return rounded(spark.createDataFrame(rows, "recording_id string, noise double, low double, high double, n_sigma double, window_sec double, merge_gap_sec double, components int"))


def detrend_linear(spark, d):
    return rounded(B.detrend_linear(user_signals(spark, d)).select("recording_id", "sample_idx", "trend", "detrended"), 4)


def pipeline_min(spark, d):
    """Percentile baseline, noise, mask, median baseline, noise, threshold of twice the noise, runs, merge, statistics."""
    s = event_signal(spark, d)

    def smoothed(df, p, mask):
        return layout.settled(B.smooth(B.percentile_direct(df, 51, p, mask), 51).withColumn("residual", F.col("value") - F.col("baseline")))

    def scalar(df):
        return noise.noise_mad(df, "residual").first()["noise"]  # one recording: one number

    first = smoothed(s, 90.0, None)
    masked = first.withColumn("mask", B.within("residual", F.lit(5.0 * scalar(first)))).select("recording_id", "sample_idx", "value", "mask")
    last = smoothed(masked, 50.0, "mask")
    level = scalar(last)
    runs = E.merge_runs(E.find_runs(last, E.above("residual", 2.0 * level)), 2).where("end_idx - start_idx >= 3")
    return rounded(E.event_stats(last, runs, 1.0).select("start_idx", "end_idx", "mean_current", "std_current", "baseline_current", "depth", "relative_depth", "area"), area=4)


# ranges


def crop_range(spark, d):
    n = table(spark, d, "events").count()
    return ranges.crop(event_signal(spark, d), 100.3, 600.7, 1.0, n).select("sample_idx", "value")


def _kept(spark, d):
    n = table(spark, d, "events").count()
    return ranges.keep_ranges(ranges.ranges_of(spark, EXCLUDED), float(n)), n


def keep_ranges(spark, d):
    return _kept(spark, d)[0]


def normalise_ranges(spark, d):
    return ranges.normalise(ranges.ranges_of(spark, EXCLUDED), float(table(spark, d, "events").count()))


def concat_ranges(spark, d):
    kept, n = _kept(spark, d)
    return ranges.concatenate(event_signal(spark, d), ranges.range_table(kept, 1.0, n)).select("sample_idx", "orig_idx", "value")


def nan_gaps(spark, d):
    kept, n = _kept(spark, d)
    t = ranges.range_table(kept, 1.0, n)
    return ranges.gap_rows(ranges.concatenate(event_signal(spark, d), t), t).select("position", F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value")).alias("value"))


def restore_mapped(spark, d):
    kept, n = _kept(spark, d)
    t = ranges.range_table(kept, 1.0, n)
    runs = E.merge_runs(E.find_runs(ranges.concatenate(event_signal(spark, d), t), E.above("value", 60.0)), 1)
    timed = runs.withColumn("duration", (F.col("end_idx") - F.col("start_idx")).cast("double"))
    return ranges.restore(timed, t, 1.0).select("start_idx", "end_idx", "start_time", "end_time", "duration")


# filters and views


def lowpass_bessel(spark, d):
    return rounded(filtering.lowpass(event_signal(spark, d), 1.0, 0.1).select("sample_idx", "filtered"))


def lowpass_butter(spark, d):
    return rounded(filtering.lowpass(event_signal(spark, d), 1.0, 0.1, "butterworth").select("sample_idx", "filtered"))


def minmax_downsample(spark, d):
    return views.envelope(event_signal(spark, d), 200).select("sample_idx", "value")


def residual_histogram(spark, d):
    return rounded(views.value_histogram(event_signal(spark, d)).select("bin", "n", "density"), 8)


def dwell_log_histogram(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    waits = table(spark, d, "orders").select((F.timestamp_diff("MICROSECOND", F.lag("o_orderdate").over(order), F.col("o_orderdate")) / 1e6).alias("duration")).where("duration > 0")
    return views.log_histogram(waits)


def events_table(spark, d):
    return views.event_rows(E.detect_events(residuals(spark, d), 100.0, -25.0, BOTH, 3, 1)).drop("recording_id")


def stride_preview(spark, d):
    return views.stride(event_signal(spark, d), 100).select("sample_idx", "value")


def thin_samples(spark, d):
    return views.thin(event_signal(spark, d), 100.0, 7.0).select("sample_idx", "value")


# interval joins


def _two(spark, d):
    s = event_signal(spark, d)

    def found(cut):
        runs = E.merge_runs(E.find_runs(s, E.above("value", cut)), 2)
        return runs.select("recording_id", F.col("start_idx").alias("id"), F.col("start_idx").cast("double").alias("start"), F.col("end_idx").cast("double").alias("end"))

    return found(60.0), found(75.0)


def iou_pairs(spark, d):
    return rounded(matching.overlaps(*_two(spark, d), 64.0).select("truth_id", "det_id", "iou"))


def any_overlap(spark, d):
    truth, det = _two(spark, d)
    return truth.select(F.col("id").alias("truth_id")).join(matching.overlaps(truth, det, 64.0).select("truth_id").distinct(), "truth_id", "left_semi")


def greedy_match(spark, d):
    truth, det = _two(spark, d)
    return rounded(matching.match(truth, det, 64.0, 0.3).select("truth_id", "det_id", "iou"))


def metrics_prf(spark, d):
    """One-to-one matches of an overlap of 0.6 and what they say; depths and levels are made from the ids."""
    truth, det = (x.withColumn("depth", F.col("end") - F.col("start") + F.col("id") % 3).withColumn("n_levels", (F.col("id") % 2 + 1).cast("int")) for x in _two(spark, d))
    return rounded(scoring.evaluate(truth, det, 64.0, 0.6).drop("bound_err_us"))


def nearest_start_asof(spark, d):
    truth, det = _two(spark, d)
    left = truth.select("recording_id", "id", F.col("start").alias("t"))
    return matching.nearest(left, det.select("recording_id", F.col("start").alias("t")), 5.0).select("id", "t", "nearest")


def clean_runs(spark, d):
    truth, _ = _two(spark, d)
    n = event_signal(spark, d).groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    return spectrum.clean_runs(n, truth.select("recording_id", (F.col("start") - 2).cast("long").alias("start_idx"), (F.col("end") + 2).cast("long").alias("end_idx"))).select("start_idx", "end_idx")


def event_waveforms(spark, d):
    s = residuals(spark, d)
    long_ = E.merge_runs(E.find_runs(s, E.above("value", 60.0)), 2).where("end_idx - start_idx >= 6")
    return rounded(sinks.waveforms(s, long_, 100.0, 30.0).drop("recording_id"))


def first_events(spark, d):
    """The first events of a recording, as a grid shows them."""
    return rounded(views.first_events(E.detect_events(residuals(spark, d), 1.0, -25.0, BOTH, 3, 1), 12).select("rank", "start_idx", "end_idx", "direction", "depth"))


def windowed_view(spark, d):
    """Envelope of a part of the concatenated signal, with a break at every gap."""
    kept, n = _kept(spark, d)
    joined = ranges.concatenate(event_signal(spark, d), ranges.range_table(kept, 1.0, n))
    return rounded(views.windowed(joined, 1.0, 50.0, 950.0, 60).drop("recording_id"))


def raw_round_trip(spark, d):
    """The signal written as raw 16-bit files of one folder and read back by byte ranges."""
    from tracelake.sources import raw

    folder = f"{layout.shared(spark)}/raw-{uuid.uuid4().hex}"
    raw.write_raw(event_signal(spark, d), folder, "int16", 0.05, 1.0)
    got, _ = raw.read_signal(spark, folder, 1.0, dtype="int16", scale_factor=0.05, offset=1.0, recording_id="events")
    return got.select("recording_id", "sample_idx", F.round(F.col("value").cast("double"), 3).alias("value"))


def events_csv(spark, d):
    """The event table written as CSV and read back."""
    folder = f"{layout.shared(spark)}/csv-{uuid.uuid4().hex}"
    table_ = sinks.event_table(E.detect_events(residuals(spark, d), 1.0, -25.0, BOTH, 3, 1))
    sinks.write_csv(table_, folder)
    return rounded(spark.read.schema(table_.schema).option("header", True).csv(folder))


# spectra


def _psd(spark, d):
    return layout.settled(spectrum.welch(user_signals(spark, d), 100.0, 32))


def welch_psd(spark, d):
    return rounded(_psd(spark, d))


def cumulative_rms(spark, d):
    return rounded(spectrum.cumulative_rms(_psd(spark, d)).select("recording_id", "bin", "rms"))


def band_rms(spark, d):
    return rounded(spectrum.band_rms(_psd(spark, d)).drop("bins"))


def f3db(spark, d):
    return rounded(spectrum.cutoff_estimate(_psd(spark, d)))


def psd_ratio(spark, d):
    psd = _psd(spark, d)
    control = psd.groupBy("bin").agg(F.median("psd").alias("psd"))
    return rounded(spectrum.ratio(psd, control).drop("freq"), 5)


def spectral_peaks(spark, d):
    return rounded(spectrum.peaks(_psd(spark, d), 2.5), 5)


def spectral_top_peaks(spark, d):
    return rounded(spectrum.top_peaks(spectrum.peaks(_psd(spark, d), 1.2), 2), 5)


def noise_spectrum(spark, d):
    """Spectrum of each user's signal between its high samples."""
    s = user_signals(spark, d)
    high = E.merge_runs(E.find_runs(s, E.above("value", 110.0)), 0)
    return rounded(spectrum.noise_spectrum(s, high, 100.0, 1.0, 0), 5)


# model rules


def gaussian_crossing(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"), F.count("*").cast("double").alias("w"))
    a, b = g.alias("a"), g.alias("b")
    pairs = a.join(b, F.col("a.event_type") < F.col("b.event_type"))
    x = scalars.crossing(F.col("a.m") - 60, F.col("a.s") / 4, F.col("a.w"), F.col("b.m"), F.col("b.s") / 3, F.col("b.w"))
    return rounded(pairs.select(F.col("a.event_type").alias("left_type"), F.col("b.event_type").alias("right_type"), x.alias("crossing")))


def baseline_component(spark, d):
    """Of the event types as components of a recording: the one with the mean nearest to 0 among those of some weight."""
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") - 50).alias("m"), F.count("*").alias("n"))

    def pick(part):
        from tracelake.functions.mixtures import baseline_component as chosen

        part = part.sort_values("event_type")
        return part[["user_id", "event_type"]].rename(columns={"event_type": "component"}).iloc[[chosen(part["m"].to_numpy(), (part["n"] / part["n"].sum()).to_numpy())]]

    ship(spark)
    return g.groupBy("user_id").applyInPandas(pick, f"user_id {dict(g.dtypes)['user_id']}, component string")


def effective_threshold(spark, d):
    g = table(spark, d, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    cuts = E.effective_thresholds(-F.col("m"), F.col("m"), F.col("s"))
    return rounded(g.select("event_type", cuts[DOWN].alias("down"), cuts[UP].alias("up")))


def _features(spark, d):
    return scalars.event_features(E.detect_events(residuals(spark, d), 1.0, -25.0, UP, 2, 1))


def event_features(spark, d):
    return rounded(_features(spark, d).drop("recording_id"))


def zscore_features(spark, d):
    return rounded(scalars.standardised(_features(spark, d)).drop("recording_id"), 5)


def capture_rate_mean(spark, d):
    from tracelake.functions.bayes import capture_rate as posterior

    g = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id") + 1).cast("double").alias("span"))
    return rounded(spark.createDataFrame([(r["event_type"], r["n"], float(posterior(r["n"], r["span"])["mean"])) for r in g.collect()], "event_type string, n long, mean_rate double"))  # a row per type


# states


def _labels(spark, d):
    return user_signals(spark, d).withColumn("label", F.least(F.floor(F.col("value") / 25), F.lit(3)).cast("long"))


def rle_labels(spark, d):
    return states.label_runs(_labels(spark, d))


def merge_same_label(spark, d):
    runs = states.label_runs(_labels(spark, d)).where("end_idx - start_idx >= 2")
    return states.merge_same(runs)


def dwell_times(spark, d):
    return rounded(states.dwell_times(_labels(spark, d), 100.0))


def transition_matrix(spark, d):
    return rounded(states.transition_matrix(_labels(spark, d)))


def segment_stats(spark, d):
    s = event_signal(spark, d)
    cuts = s.where((F.col("sample_idx") > 0) & (F.col("value") > 200)).select("recording_id", F.col("sample_idx").alias("at"))
    return rounded(states.segment_stats(s, cuts).drop("recording_id"))


# arrays


def array_runs(spark, d):
    """Longest run of positive elements of each embedding."""
    v = table(spark, d, "embeddings").select("vec_id", F.expr("aggregate(embedding, struct(0 AS run, 0 AS best), (s, x) -> struct(if(x > 0, s.run + 1, 0) AS run, greatest(s.best, if(x > 0, s.run + 1, 0)) AS best)) AS r"))
    return v.select("vec_id", F.col("r.best").cast("long").alias("longest"))


def array_changepoint_1(spark, d):
    """Best single split of each embedding by the sum of squares between the two means."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    w = Window.partitionBy("vec_id").orderBy("i")
    n, total = F.count("*").over(Window.partitionBy("vec_id")), F.sum("x").over(Window.partitionBy("vec_id"))
    part = v.withColumn("k", F.col("i") + 1).withColumn("s", F.sum("x").over(w)).withColumn("n", n).withColumn("t", total).where("k < n")
    gain = F.pow(F.col("s") / F.col("k") - (F.col("t") - F.col("s")) / (F.col("n") - F.col("k")), F.lit(2)) * F.col("k") * (F.col("n") - F.col("k")) / F.col("n")
    best = part.withColumn("gain", F.round(gain, 9)).groupBy("vec_id").agg(F.max(F.struct("gain", (-F.col("k")).alias("k"))).alias("b"))
    return best.select("vec_id", (-F.col("b.k")).cast("long").alias("split"), F.round("b.gain", 6).alias("gain"))


def array_dft_power(spark, d):
    """Power of the first eight frequencies of each embedding."""
    v = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x"), F.size("embedding").alias("n"))
    f = v.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("a", 2 * 3.141592653589793 * F.col("k") * F.col("i") / F.col("n"))
    g = f.groupBy("vec_id", "k").agg(F.sum(F.col("x").cast("double") * F.cos("a")).alias("c"), F.sum(F.col("x").cast("double") * F.sin("a")).alias("s"))
    return g.select("vec_id", F.col("k").cast("long").alias("k"), F.round(F.col("c") * F.col("c") + F.col("s") * F.col("s"), 6).alias("power"))


# benchmark tables


def seed_mean_std(spark, d):
    return rounded(scoring.over_seeds(table(spark, d, "lineitem"), ("l_returnflag", "l_linestatus", "l_linenumber"), "l_discount"))


def best_config(spark, d):
    """Per line status, and over all of them, the return flag with the best mean score, and its score."""
    return rounded(scoring.best_setting(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "l_discount"))


def sensitivity(spark, d):
    score = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_tax").alias("score"), F.count("*").alias("n"))
    return rounded(scoring.sensitivity(score, F.col("n") % 5, "score"))


# models without an SQL form


def _threshold(method):
    def query(spark, d):
        from tracelake.functions.mixtures import determine_threshold

        most = min(20_000, DetectionConfig().gmm_max_samples) if method == "dpgmm" else DetectionConfig().gmm_max_samples
        rows = views.residual_sample(residuals(spark, d), most).select("residual").toPandas()["residual"].to_numpy()
        t = determine_threshold(-rows, method, 6)
        return spark.createDataFrame([(i, float(m), float(s), float(w), float(t.value), i == t.base) for i, (m, s, w) in enumerate(zip(t.means, t.stds, t.weights, strict=True))], "component int, mean double, std double, weight double, threshold double, is_base boolean")

    return query


def _long_events(spark, d):
    """Users' whole signals as events."""
    s = user_signals(spark, d)
    return s, s.groupBy("recording_id").agg(F.lit(0).cast("long").alias("start_idx"), (F.max("sample_idx") + 1).alias("end_idx"))


def pelt_changepoints(spark, d):
    return inference.change_points(*_long_events(spark, d), "exact", least=8)


def bocpd_changepoints(spark, d):
    return inference.change_points(*_long_events(spark, d), "online", hazard=1 / 50, least=5)


def _sublevels(method):
    def query(spark, d):
        s, ev = _long_events(spark, d)
        return rounded(inference.sublevels(s, ev, 100.0, None, method, 3, 8))

    return query


def hmm_bic(spark, d):
    return rounded(inference.hidden_states(*_long_events(spark, d), 100.0, "bic", 3))


def hmm_sticky_hdp(spark, d):
    return rounded(inference.hidden_states(*_long_events(spark, d), 100.0, "sticky_hdp", 4))


def cluster_events(spark, d):
    features = scalars.event_features(E.detect_events(residuals(spark, d), 1.0, -25.0, UP, 2, 1), ("relative_depth", "log_duration"))
    return rounded(inference.cluster(features, 6)[0])


def capture_rate(spark, d):
    from tracelake.functions.bayes import capture_rate as posterior

    rows = [(r["event_type"], posterior(r["n"], float(r["span"]))) for r in table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (F.max("event_id") - F.min("event_id") + 1).alias("span")).collect()]
    return spark.createDataFrame([(t, p["mean"], p["lower"], p["upper"]) for t, p in rows], "event_type string, mean double, lower double, upper double")


def dwell_mixture(spark, d):
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    waits = table(spark, d, "orders").select("o_orderpriority", (F.timestamp_diff("SECOND", F.lag("o_orderdate").over(order), F.col("o_orderdate")) / 86400).alias("duration")).where("duration > 0")
    return rounded(inference.dwell_posteriors(waits, "o_orderpriority"))


def pipeline_full(spark, d):
    from tracelake.plans.pipeline import run

    config = DetectionConfig(apply_filter=False, pre_applied_filter_cutoff=50.0, baseline_window_sec=0.51, baseline_iterations=1, event_direction=UP, min_event_duration_sec=0.03, merge_gap_sec=0.02, sublevel_method="gmm", min_segment_samples=5)
    return rounded(run(event_signal(spark, d), 100.0, config).events.drop("sublevels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        noise_mad, noise_std, noise_floor_diff, robust_noise_std, find_runs, merge_intervals, event_stats, hysteresis_events,
        baseline_percentile_direct, baseline_smooth, baseline_masked_fallback, baseline_sparse_interp, residual_within,
        block_median_baseline, control_stats, plan_events, suggest_figures, detrend_linear, pipeline_min, crop_range, keep_ranges,
        normalise_ranges, concat_ranges, nan_gaps, restore_mapped, lowpass_bessel, lowpass_butter, minmax_downsample,
        residual_histogram, dwell_log_histogram, events_table, stride_preview, thin_samples, iou_pairs, any_overlap,
        greedy_match, metrics_prf, nearest_start_asof, clean_runs, event_waveforms, first_events, windowed_view, raw_round_trip, events_csv, welch_psd, cumulative_rms, band_rms, f3db,
        psd_ratio, spectral_peaks, spectral_top_peaks, noise_spectrum, gaussian_crossing, baseline_component, effective_threshold, event_features, zscore_features,
        capture_rate_mean, rle_labels, merge_same_label, dwell_times, transition_matrix, segment_stats, array_runs,
        array_changepoint_1, array_dft_power, seed_mean_std, best_config, sensitivity, pelt_changepoints, bocpd_changepoints,
        hmm_bic, hmm_sticky_hdp, cluster_events, capture_rate, dwell_mixture, pipeline_full,
    )
} | {
    "detect_events_up": _detect(UP), "detect_events_down": _detect(DOWN), "detect_events_both": _detect(BOTH),
    "gmm_bic_threshold": _threshold("gmm"), "dpgmm_threshold": _threshold("dpgmm"),
    "sublevels_gmm": _sublevels("gmm"), "sublevels_dpgmm": _sublevels("dpgmm"), "sublevels_bocpd": _sublevels("bocpd"),
}
