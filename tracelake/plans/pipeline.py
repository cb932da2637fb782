"""The detection plan: restrict, filter, baseline, threshold, events, sub-levels, states, clusters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.config import BOTH, DOWN, UP, DetectionConfig
from tracelake.functions.filters import zero_phase_kernel
from tracelake.operators import baseline as B
from tracelake.operators import chunked, filtering, inference, ranges, scalars, views
from tracelake.operators import events as E
from tracelake.operators.layout import settled
from tracelake.sources import raw


@dataclass
class Result:
    """Lazy tables and a few numbers; thresholds: the fitted components of each recording; level: chunks with baseline and
    noise."""

    level: DataFrame
    layout: chunked.Layout
    window: int
    events: DataFrame
    thresholds: DataFrame
    config: DetectionConfig
    rate: float
    states: DataFrame | None = None
    clusters: list[dict] = field(default_factory=list)

    @property
    def samples(self) -> DataFrame:
        """(recording_id, sample_idx, value, baseline, residual)."""
        return chunked.rows_of(self.level, self.layout, self.window)

    @property
    def noise(self) -> DataFrame:
        return self.level.select("recording_id", "noise").distinct()

    def seconds(self) -> float:
        """Length of all recordings."""
        return (self.level.select("recording_id", "n").distinct().agg(F.sum("n")).first()[0] or 0) / self.rate

    def summary(self) -> dict:
        """Counts and extremes of the events."""
        r = self.events.agg(F.count("*").alias("n_events"), F.count_if(F.col("n_levels") > 1).alias("n_multilevel"), F.min("duration").alias("min_duration"), F.max("duration").alias("max_duration"), F.min("depth").alias("min_depth"), F.max("depth").alias("max_depth")).first()
        return r.asDict()

    def summary_text(self, units: str = "pA") -> str:
        """One block of lines per recording, in the order of their names: rate, length, noise, threshold in force, events."""
        base = self.thresholds.groupBy("recording_id").agg(F.count("*").alias("components"), F.first("threshold").alias("cut"), F.max(F.when(F.col("is_base"), F.col("mean"))).alias("mean"), F.max(F.when(F.col("is_base"), F.col("std"))).alias("std"))
        cuts = E.effective_thresholds(F.col("cut"), F.col("mean"), F.col("std"))
        found = self.events.groupBy("recording_id").agg(F.count("*").alias("events"), F.count_if(F.col("n_levels") > 1).alias("several"), F.min("duration").alias("shortest"), F.max("duration").alias("longest"), F.min("depth").alias("least"), F.max("depth").alias("most"))
        length = self.level.groupBy("recording_id").agg(F.first("n").alias("n"), F.first("noise").alias("noise"))
        rows = length.join(base, "recording_id").join(found, "recording_id", "left").select("*", F.abs(cuts[DOWN]).alias("down"), cuts[UP].alias("up")).orderBy("recording_id")
        arrow = {DOWN: "↓", UP: "↑", BOTH: "↕"}[self.config.event_direction]
        out = []
        for r in rows.collect():  # one row per recording
            cut = r["down"] if self.config.event_direction == DOWN else r["up"]
            lines = [r["recording_id"], f"Sampling rate:   {self.rate:.0f} Hz", f"Duration:        {r['n'] / self.rate:.3f} s", f"Samples:         {r['n']}", f"Noise std:       {r['noise']:.4f} {units}", f"Mixture comps.:  {r['components']}", f"Threshold ({arrow}):   {cut:.4f} {units}", f"Events detected: {r['events'] or 0}", f"Multi-level:     {r['several'] or 0}"]
            if r["events"]:
                lines += [f"Duration range:  {r['shortest'] * 1e3:.3f} – {r['longest'] * 1e3:.3f} ms", f"Depth range:     {r['least']:.2f} – {r['most']:.2f} {units}"]
            out.append("\n".join(lines + ([f"Populations:     {len(self.clusters)}"] if self.clusters else [])))
        return "\n\n".join(out)


def signal_chunks(samples: DataFrame, rate: float, config: DetectionConfig, layout: chunked.Layout) -> DataFrame:
    """Chunks of the filtered and, if asked for, detrended samples."""
    kernel = zero_phase_kernel(config.filter_type, config.filter_order, config.cutoff(rate), rate) if config.apply_filter else None
    if config.detrend_method == "none":
        reach = len(kernel) // 2 if kernel is not None else 0
        chunks = chunked.to_chunks(samples, layout.size, layout.halo + reach)
        return chunked.filtered(chunks, layout, kernel) if kernel is not None else chunks
    if kernel is not None:
        samples = filtering.lowpass(samples, rate, config.cutoff(rate), config.filter_type, config.filter_order).select("recording_id", "sample_idx", F.col("filtered").alias("value"))
    if config.detrend_method == "linear":
        detrended = B.detrend_linear(samples)
    elif config.detrend_method == "polynomial":
        detrended = B.detrend_polynomial(samples, config.detrend_order)
    else:
        raise ValueError(f"unknown detrending: {config.detrend_method}")
    return chunked.to_chunks(detrended.select("recording_id", "sample_idx", F.col("detrended").alias("value"), "trend"), layout.size, layout.halo)


def control_statistics(samples: DataFrame, rate: float, config: DetectionConfig | None = None) -> DataFrame:
    """(recording_id, noise_std, baseline_mean, baseline_std, n_samples) of control traces, by the filter and the baseline that
    a detection with this config uses."""
    config = config or DetectionConfig()
    window = config.baseline_window(rate)
    layout = chunked.layout_of(window)
    level = chunked.estimate_baseline(settled(signal_chunks(samples, rate, config, layout)), layout, window, config.baseline_iterations, config.baseline_percentile, config.baseline_n_sigma, config.noise_estimation)
    lines = chunked.rows_of(level, layout, window).groupBy("recording_id").agg(F.avg("baseline").alias("baseline_mean"), F.stddev_pop("baseline").alias("baseline_std"), F.count("*").alias("n_samples"))
    noise = level.groupBy("recording_id").agg(F.first("noise").alias("noise_std"))
    return noise.join(lines, "recording_id")


def detected(level: DataFrame, layout: chunked.Layout, window: int, rate: float, open_level: DataFrame, direction: str, least: int, gap: int) -> DataFrame:
    """Events of one or both directions with statistics, each recording with its own threshold and open level."""
    cuts = E.effective_thresholds(F.col("threshold"), F.col("open_mean"), F.col("open_std"))
    out = None
    for way in (DOWN, UP) if direction == BOTH else (direction,):
        marked = level.join(open_level.withColumn("cut", cuts[way]), "recording_id")
        runs = E.merge_runs(chunked.runs_beyond(marked, layout, window, way == DOWN), 0)
        spans = settled(E.merge_runs(runs, gap).where(F.col("end_idx") - F.col("start_idx") >= least))
        own = E.described(chunked.span_sums(level, layout, window, spans), rate).withColumn("direction", F.lit(way))
        out = own if out is None else out.unionByName(own)
    return out


def run(samples: DataFrame, rate: float, config: DetectionConfig | None = None, analysis_range: tuple[float, float] | None = None, exclude_ranges: list[tuple[float, float]] | None = None) -> Result:
    """Events of every recording in samples (recording_id, sample_idx, value), all of one sampling rate.

    Thresholds are fitted per recording on bounded, seeded samples, one task a recording; all recordings share one plan.
    """
    config = config or DetectionConfig()
    if analysis_range and exclude_ranges:
        raise ValueError("give an analysis range or excluded ranges, not both")
    spark = samples.sparkSession
    offset, mapping = 0, None
    if analysis_range:
        n = (samples.agg(F.max("sample_idx")).first()[0] or -1) + 1
        offset, _ = ranges.crop_bounds(*analysis_range, rate, n)
        samples = ranges.crop(samples, *analysis_range, rate, n)
    elif exclude_ranges:
        n = (samples.agg(F.max("sample_idx")).first()[0] or -1) + 1
        mapping = ranges.range_table(ranges.keep_ranges(ranges.ranges_of(spark, exclude_ranges), n / rate), rate, n)
        samples = ranges.concatenate(samples, mapping).select("recording_id", "sample_idx", "value")
    window = config.baseline_window(rate)
    layout = chunked.layout_of(window)
    return detect(signal_chunks(samples, rate, config, layout), layout, window, rate, config, offset, mapping)


def run_file(spark: SparkSession, path: str, rate: float | None = None, config: DetectionConfig | None = None, analysis_range: tuple[float, float] | None = None, exclude_ranges: list[tuple[float, float]] | None = None, channel: int = 0, **options) -> Result:
    """Events of one recording file. Without ranges and detrending, chunks are read from the file by byte range, and no sample
    ever is a row."""
    config = config or DetectionConfig()
    if analysis_range or exclude_ranges or config.detrend_method != "none":
        samples, rate = raw.read_signal(spark, path, rate, channel, **options)
        return run(samples.select("recording_id", "sample_idx", F.col("value").cast("double").alias("value")), rate, config, analysis_range, exclude_ranges)
    options, rate = raw.reading(path, rate, channel, **options)
    window = config.baseline_window(rate)
    layout = chunked.layout_of(window)
    kernel = zero_phase_kernel(config.filter_type, config.filter_order, config.cutoff(rate), rate) if config.apply_filter else None
    chunks = raw.read_chunks(spark, path, layout.size, layout.halo + (len(kernel) // 2 if kernel is not None else 0), options)
    return detect(chunked.filtered(chunks, layout, kernel) if kernel is not None else chunks, layout, window, rate, config)


def detect(chunks: DataFrame, layout: chunked.Layout, window: int, rate: float, config: DetectionConfig, offset: int = 0, mapping: DataFrame | None = None) -> Result:
    """The plan from filtered chunks on; offset and mapping lead back to the recording that was restricted."""
    cutoff = config.cutoff(rate)
    level = settled(chunked.estimate_baseline(settled(chunks), layout, window, config.baseline_iterations, config.baseline_percentile, config.baseline_n_sigma, config.noise_estimation))
    least, gap = config.durations(rate)
    most = min(config.gmm_max_samples, 20_000) if config.threshold_method == "dpgmm" else config.gmm_max_samples
    sign = -1.0 if config.event_direction == UP else 1.0
    drawn = chunked.drawn_residuals(level, layout, window, most, config.random_seed or 0)
    fitted = settled(inference.thresholds(drawn, config.threshold_method, most, sign, config.gmm_max_components, config.bic_criterion, config.dp_concentration, config.random_seed or 0))
    open_level = fitted.where("is_base").select("recording_id", "threshold", (sign * F.col("mean")).alias("open_mean"), F.col("std").alias("open_std"))
    if open_level.isEmpty():
        raise ValueError("no samples")
    found = settled(detected(level, layout, window, rate, open_level, config.event_direction, least, gap))  # events are few, and every later step reads them
    inside = chunked.rows_of(level, layout, window, found)
    levels = inference.sublevels(inside, None, rate, cutoff, config.sublevel_method, config.max_sublevel_depth, config.min_segment_samples, config.dp_concentration)
    nested = levels.groupBy("recording_id", F.col("event_start").alias("start_idx")).agg(F.sort_array(F.collect_list(F.struct("sublevel_idx", "level_index", F.col("start_idx").alias("from_idx"), F.col("end_idx").alias("to_idx"), "mean_current", "std_current"))).alias("sublevels"))
    events = found.drop("n_levels", "event_type").join(nested, ["recording_id", "start_idx"], "left")
    n_levels = F.when(F.col("sublevels").isNull(), F.lit(1)).otherwise(F.size("sublevels"))
    events = events.withColumn("n_levels", n_levels).withColumn("event_type", F.when(n_levels > 1, "multi_level").otherwise("single_level"))
    hidden = inference.hidden_states(inside, None, rate, config.hmm_method, config.hmm_max_states, views.thinning_step(rate, cutoff)) if config.hmm_analysis else None
    if offset:
        events = ranges.shift(events, offset, rate)
    if mapping is not None:
        events = ranges.restore(events, mapping, rate)
    clusters: list[dict] = []
    if config.cluster_events:
        labelled, clusters = inference.cluster(scalars.event_features(events, ("relative_depth", "log_duration")), config.max_clusters, config.dp_concentration)
        events = events.join(labelled.select("recording_id", "start_idx", "cluster_id", "cluster_prob"), ["recording_id", "start_idx"])
    return Result(level, layout, window, events, fitted, config, rate, hidden, clusters)
