import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.config import DOWN, UP, DetectionConfig
from tracelake.functions.synthetic import Planted, generate, poisson_train, scenario
from tracelake.operators import baseline, events, filtering, layout, matching, noise, ranges, spectrum, states
from tracelake.plans.pipeline import run
from tracelake.sources import raw, sinks
from tracelake.streaming.online import detect_online, scan


def samples(spark, x, rec="a"):
    return spark.createDataFrame(pd.DataFrame({"recording_id": rec, "sample_idx": np.arange(len(x)), "value": np.asarray(x, float)}))


def pairs(df):
    return sorted((r["start_idx"], r["end_idx"]) for r in df.collect())


def test_runs_are_the_same_in_chunks(spark):
    x = (np.random.default_rng(0).random(3000) < 0.4).astype(float)
    s = samples(spark, x)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], x, [0]])))
    want = sorted(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))
    for chunk in (100, 5000):
        assert pairs(events.merge_runs(events.find_runs(s, F.col("value") > 0, chunk=chunk), 0)) == want


def test_merging_by_gap(spark):
    r = spark.createDataFrame([("a", 0, 10), ("a", 13, 20), ("b", 0, 10), ("b", 16, 20)], "recording_id string, start_idx long, end_idx long")
    assert pairs(events.merge_runs(r, 5)) == [(0, 10), (0, 20), (16, 20)]


def test_nan_is_no_event(spark):
    x = np.zeros(100)
    x[10:20], x[50:60] = np.nan, 9.0
    assert pairs(events.merge_runs(events.find_runs(samples(spark, x), events.above("value", 5.0)), 0)) == [(50, 60)]


def test_detection_of_both_directions(spark):
    x = np.random.default_rng(1).normal(0, 0.5, 8000)
    x[2000:3000] += 50
    x[5000:6000] -= 50
    s = samples(spark, x).withColumn("baseline", F.lit(100.0)).withColumn("residual", F.col("value"))
    got = events.detect_events(s, 10_000.0, -10.0, "both", 100, 5).orderBy("start_idx").collect()
    assert [(r["start_idx"], r["end_idx"], r["direction"]) for r in got] == [(2000, 3000, UP), (5000, 6000, DOWN)]
    assert got[0]["depth"] == pytest.approx(50, abs=1) and got[0]["relative_depth"] == pytest.approx(0.5, abs=0.01)


def test_windows_are_the_same_in_chunks(spark):
    s = samples(spark, np.random.default_rng(2).normal(100, 5, 700)).withColumn("mask", F.col("value") > 97)
    one = baseline.percentile_direct(s, 31, 90.0, "mask").orderBy("sample_idx").toPandas()["baseline"]
    many = baseline.percentile_direct(s, 31, 90.0, "mask", chunk=64).orderBy("sample_idx").toPandas()["baseline"]
    x, m = s.toPandas()["value"].to_numpy(), s.toPandas()["mask"].to_numpy()
    want = []
    for c in range(700):
        v = np.sort(x[max(0, c - 15) : c + 15][m[max(0, c - 15) : c + 15]])
        want.append(v[int(0.9 * (len(v) - 1) + 0.5)])
    assert np.allclose(one, want) and np.allclose(many, want)


def test_sparse_windows_follow_the_direct_ones(spark):
    x = 200 + np.linspace(0, 20, 4000) + np.random.default_rng(3).normal(0, 1, 4000)
    s = samples(spark, x)
    a = baseline.percentile_direct(s, 401, 50.0).orderBy("sample_idx").toPandas()["baseline"]
    b = baseline.percentile_sparse(s, 401, 50.0).orderBy("sample_idx").toPandas()["baseline"]
    assert np.abs(a - b)[200:-200].max() < 0.5


def test_baseline_ignores_events(spark):
    x = 100 + np.random.default_rng(4).normal(size=6000)
    x[1000:1200] -= 50
    x[4000:4300] -= 50
    got = baseline.estimate_baseline(samples(spark, x), 10_000.0, 0.05, 1).toPandas()
    assert abs(got["baseline"].median() - 100) < 1 and got["noise"].iloc[0] == pytest.approx(1, abs=0.15)


def test_filter_is_the_same_in_chunks(spark):
    s = samples(spark, np.random.default_rng(5).normal(size=3000))
    a, b = (filtering.lowpass(s, 1.0, 0.1, chunk=c).orderBy("sample_idx").toPandas()["filtered"] for c in (500, 10_000))
    assert np.allclose(a, b, atol=1e-12)
    flat = filtering.lowpass(samples(spark, np.full(300, 7.0)), 1.0, 0.1).toPandas()["filtered"]
    assert np.allclose(flat, 7.0)


def test_prefix_sums_in_two_levels(spark):
    got = layout.prefix_sums(samples(spark, np.ones(1000)), "value", "total", 64).orderBy("sample_idx").toPandas()["total"]
    assert np.allclose(got, np.arange(1, 1001))


def test_noise_of_normal_values(spark):
    s = samples(spark, np.random.default_rng(6).normal(0, 3, 5001))
    x = s.toPandas()["value"].to_numpy()
    want = 1.4826 * np.median(np.abs(x - np.median(x)))
    assert noise.noise_mad(s).first()["noise"] == pytest.approx(want, rel=1e-12)
    assert noise.noise_mad(samples(spark, [np.nan, np.nan])).first()["noise"] == 1.0
    assert noise.robust_noise_std(samples(spark, [1.0, 1.0])).first()["noise"] == 1.0


def test_polynomial_trend(spark):
    t = np.linspace(-1, 1, 3000)
    x = 5 + 3 * t - 2 * t**3 + np.random.default_rng(7).normal(0, 0.1, 3000)
    x[500:520] += 50
    got = baseline.detrend_polynomial(samples(spark, x)).orderBy("sample_idx").toPandas()["trend"]
    assert np.abs(got - (5 + 3 * t - 2 * t**3)).max() < 0.1


def test_ranges(spark):
    with pytest.raises(ValueError):
        ranges.crop_bounds(5, 2, 1000.0, 10_000)
    assert ranges.crop_bounds(2, 5, 1000.0, 10_000) == (2000, 5000)
    kept = ranges.keep_ranges(ranges.ranges_of(spark, [(-5.0, 1.0), (3.0, 4.0), (3.5, 6.0)]), 10.0)
    assert sorted((r["t0"], r["t1"]) for r in kept.collect()) == [(1.0, 3.0), (6.0, 10.0)]
    assert ranges.keep_ranges(ranges.ranges_of(spark, [(0.0, 10.0)]), 10.0).count() == 0


def test_states(spark):
    s = samples(spark, [0, 0, 1, 1, 1, 0, 2]).withColumn("label", F.col("value").cast("long"))
    got = [(r["label"], r["start_idx"], r["end_idx"]) for r in states.label_runs(s, 3).orderBy("start_idx").collect()]
    assert got == [(0, 0, 2), (1, 2, 5), (0, 5, 6), (2, 6, 7)]
    p = {(r["from_label"], r["to_label"]): r["p"] for r in states.transition_matrix(s).collect()}
    assert p[(1, 1)] == pytest.approx(2 / 3) and p[(2, 2)] == 1.0


def test_matching_is_one_to_one(spark):
    kind = "recording_id string, id long, start double, end double"
    truth = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 2.0, 3.0), ("a", 2, 5.0, 6.0)], kind)
    det = spark.createDataFrame([("a", 0, 0.0, 1.1), ("a", 1, 0.1, 1.0), ("a", 2, 2.6, 3.4), ("a", 3, 9.0, 9.5)], kind)
    assert [(r["truth_id"], r["det_id"]) for r in matching.match(truth, det, 0.5).collect()] == [(0, 0)]
    assert matching.overlaps(truth, det, 0.5).select("truth_id").distinct().count() == 2


def test_spectrum_of_white_noise(spark):
    s = samples(spark, np.random.default_rng(8).normal(0, 3, 20_000))
    psd = spectrum.welch(s, 50_000.0, 512)
    rms = spectrum.cumulative_rms(psd).agg(F.max("rms")).first()[0]
    assert rms == pytest.approx(3, rel=0.05)
    runs = spectrum.clean_runs(spark.createDataFrame([("a", 300)], "recording_id string, n long"), spark.createDataFrame([("a", 150, 160), ("a", 155, 170)], "recording_id string, start_idx long, end_idx long"))
    assert pairs(runs) == [(0, 150), (170, 300)]
    rows = spark.createDataFrame([(100.0, 1.0), (60.4, 0.1), (58.9, 0.5), (650.0, 1.0), (20.0, 1.0)], "f double, r double")
    assert [r[0] for r in rows.select(spectrum.mains_label(F.col("f"), F.col("r"))).collect()] == ["mains 50 Hz × 2", "mains 60 Hz", "", "", ""]
    with pytest.raises(ValueError):
        spectrum.ratio(psd, psd.where("bin < 9"))


def test_plan_finds_planted_events(spark):
    planted = [Planted(0.3 + 0.5 * k, [(0.02, 140.0)]) for k in range(3)]
    signal = generate(1.8, 10_000.0, white=2.0, pink=0.0, events=planted)
    config = DetectionConfig(baseline_window_sec=0.3, baseline_iterations=1, gmm_max_components=4, cluster_events=True)
    got = run(samples(spark, signal.values), 10_000.0, config)
    rows = got.events.orderBy("start_idx").collect()
    assert len(rows) == 3 and all(abs(r["start_idx"] - a) < 20 for r, (a, _, _) in zip(rows, signal.truth(), strict=True))
    assert got.summary()["n_events"] == 3
    assert sinks.event_table(got.events).count() == 3 and "cluster_id" in sinks.event_table(got.events).columns
    shifted = run(samples(spark, signal.values), 10_000.0, DetectionConfig(baseline_window_sec=0.3, baseline_iterations=1, gmm_max_components=4), exclude_ranges=[(0.6, 1.0)]).events.orderBy("start_idx").collect()
    assert len(shifted) == 2 and abs(shifted[1]["start_idx"] - signal.truth()[2][0]) < 20
    with pytest.raises(ValueError):
        run(samples(spark, signal.values), 10_000.0, config, analysis_range=(0, 1), exclude_ranges=[(0, 1)])


def test_raw_files(spark, tmp_path):
    spark.dataSource.register(raw.RawSource)
    path = tmp_path / "a.dat"
    path.write_bytes(b"HDR!" + np.array([0, 1, -2, 1000], "<i2").tobytes() + b"x")
    df, _ = raw.read_signal(spark, str(path), 1000.0, dtype="int16", header_bytes=4, scale_factor=0.5, offset=10)
    assert [r["value"] for r in df.orderBy("sample_idx").collect()] == [10.0, 10.5, 9.0, 510.0]
    assert raw.binary_info(str(path), "int16", 4, 1000.0)["n_samples"] == 4
    (tmp_path / "b.raw").write_bytes(b"")
    assert raw.read_signal(spark, str(tmp_path / "b.raw"), 1.0)[0].count() == 0
    assert raw.list_signals(str(tmp_path)) == ["a.dat", "b.raw"]
    with pytest.raises(ValueError):
        raw.read_signal(spark, str(path))
    with pytest.raises(FileNotFoundError):
        raw.binary_info(str(tmp_path / "none.dat"))


def test_stream_equals_batch(spark, tmp_path):
    x = np.zeros(1000)
    for a, b in ((100, 120), (121, 140), (300, 302), (498, 505), (900, 950)):
        x[a:b] = 10.0
    want = pairs(events.merge_runs(events.find_runs(samples(spark, x), events.above("value", 5.0)), 2).where("end_idx - start_idx >= 3"))
    found, state = [], (0, 0, 0, 0.0, 0.0, False)
    for i in range(0, 1000, 50):
        new, state = scan(x[i : i + 50], i, state, 5.0, 2, 3)
        found += [(a, b) for a, b, *_ in new]
    assert sorted(found) == want
    folder = tmp_path / "in"
    rows = pd.DataFrame({"recording_id": "a", "start_idx": np.arange(0, 1000, 50), "values": [x[i : i + 50].tolist() for i in range(0, 1000, 50)]})
    chunks = spark.createDataFrame(rows)
    chunks.coalesce(1).write.parquet(str(folder))
    stream = detect_online(spark.readStream.schema(chunks.schema).parquet(str(folder)), 5.0)
    query = stream.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert pairs(spark.table("found")) == want
    # an event that reaches the end comes out with the last chunk
    x[970:] = 10.0
    rows["values"], rows["last"] = [x[i : i + 50].tolist() for i in range(0, 1000, 50)], [i == 950 for i in range(0, 1000, 50)]
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "ended"))
    schema = spark.createDataFrame(rows).schema
    stream = detect_online(spark.readStream.schema(schema).parquet(str(tmp_path / "ended")), 5.0, idle_ms=60_000)
    stream.writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start().awaitTermination(120)
    assert pairs(spark.table("ended")) == sorted([*want, (970, 1000)])


def test_scenarios():
    assert len(scenario("basic", 10_000.0).events) == 4
    train = poisson_train(5.0, 20.0)
    assert all(a.start + a.duration < b.start for a, b in zip(train, train[1:], strict=False))
    with pytest.raises(ValueError):
        scenario("other")


def test_spectrum_between_events(spark):
    x = np.random.default_rng(9).normal(0, 2, 20_000)
    ev = []
    for k in range(8):
        a = 1500 + 2300 * k
        x[a : a + 200] -= 80
        ev.append(("a", a, a + 200))
    events_df = spark.createDataFrame(ev, "recording_id string, start_idx long, end_idx long")
    psd = spectrum.noise_spectrum(samples(spark, x), events_df, 20_000.0, 0.05)
    low = psd.where("freq > 0 AND freq < 2000").agg(F.avg("psd")).first()[0]
    assert low == pytest.approx(2 * 2**2 / 20_000, rel=0.3)
    assert spectrum.noise_summary(psd)["rms_total"] == pytest.approx(2, rel=0.1)
    assert sum(b - a for a, b in spectrum.spread_budget([(0, 10_000)], 2000, 100)) <= 2600
    tone = 1.5 * np.sin(2 * np.pi * 50 * np.arange(20_000) / 1000.0) + np.random.default_rng(1).normal(size=20_000)
    found = spectrum.noise_summary(spectrum.welch(samples(spark, tone), 1000.0, 1000))["peaks"]
    assert found[0]["label"] == "mains 50 Hz"


def test_segment_detector(spark):
    from tracelake.operators import inference

    x = np.random.default_rng(2).normal(0, 1, 1200)
    x[400:500] -= 20
    spans = spark.createDataFrame([("a", 0, 600), ("a", 600, 1200)], "recording_id string, start_idx long, end_idx long")
    sigma = spark.createDataFrame([("a", 1.0)], "recording_id string, noise double")
    assert pairs(inference.segment_detector(samples(spark, x), spans, sigma)) == [(400, 500)]


def test_selection_of_ranges(spark):
    assert ranges.apply_selection("exclude", (3, 1), [(5.0, 6.0)], 10.0) == [(5.0, 6.0), (1, 3)]
    assert ranges.apply_selection("keep", (1.0, 3.0), [], 10.0) == [(0.0, 1.0), (3.0, 10.0)]
    table = spark.createDataFrame([(2, 5), (7, 9)], "i0 long, i1 long")
    assert pairs(ranges.outside(table, 12)) == [(0, 2), (5, 7), (9, 12)]


def test_command_line(spark, tmp_path):
    from tracelake import cli

    planted = [Planted(0.3 + 0.5 * k, [(0.02, 140.0)]) for k in range(3)]
    signal = generate(1.8, 10_000.0, white=2.0, pink=0.0, events=planted)
    (tmp_path / "a.bin").write_bytes((signal.values * 10).astype("<i2").tobytes())
    common = [str(tmp_path / "a.bin"), "--sampling-rate", "10000", "--scale-factor", "0.1", "--output-dir", str(tmp_path)]
    got = cli.main(["analyze", *common, "--baseline-window-sec", "0.3", "--baseline-iterations", "1", "--gmm-max-components", "4"])
    assert got["n_events"] == 3 and spark.read.option("header", True).csv(str(tmp_path / "events.csv")).count() == 3
    assert cli.main(["spectrum", *common, "--segment-sec", "0.1"])["rms_total"] > 0


def test_wide_means_equal_narrow_ones(spark, monkeypatch):
    s = samples(spark, np.random.default_rng(11).normal(size=900)).withColumn("baseline", F.col("value"))
    a = baseline.smooth(s, 310, chunk=128).orderBy("sample_idx").toPandas()["baseline"]
    monkeypatch.setattr(baseline, "NARROW", 0)
    b = baseline.smooth(s, 310, chunk=128).orderBy("sample_idx").toPandas()["baseline"]
    assert np.allclose(a, b)


@pytest.mark.parametrize("kind", ["ties", "two", "heavy"])
def test_medians_of_large_groups_are_exact(spark, monkeypatch, kind):
    from tracelake.operators import quantiles

    monkeypatch.setattr(quantiles, "SMALL", 0)
    rng = np.random.default_rng(12)
    made = {"ties": lambda n: rng.integers(0, 4, n).astype(float), "two": lambda n: np.where(rng.random(n) < 0.5, -1e300, 1e300), "heavy": lambda n: rng.standard_cauchy(n)}[kind]
    parts = {"a": made(3000), "b": made(1501), "c": made(1), "d": made(2)}
    df = spark.createDataFrame(pd.concat([pd.DataFrame({"recording_id": k, "value": v}) for k, v in parts.items()]))
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (8, 20))
    got = {r["recording_id"]: r["median"] for r in quantiles.medians(df, F.col("value")).collect()}
    assert got == {k: 0.5 * np.sort(v)[(len(v) - 1) // 2] + 0.5 * np.sort(v)[len(v) // 2] for k, v in parts.items()}
    upper = {r["recording_id"]: r["u"] for r in quantiles.upper_medians(df, F.col("value"), "u").collect()}
    assert upper == {k: np.sort(v)[len(v) // 2] for k, v in parts.items()}


def test_baseline_of_a_recording_does_not_depend_on_others(spark, monkeypatch):
    monkeypatch.setattr(baseline, "DIRECT", 100_000)
    x = 100 + np.random.default_rng(13).normal(0, 5, 5000)
    short, long = samples(spark, x[:900], "short"), samples(spark, x, "long")
    alone = baseline.local_baseline(short, 101, 90.0).orderBy("sample_idx").toPandas()["baseline"]
    both = baseline.local_baseline(short.union(long), 101, 90.0)
    assert np.allclose(both.where("recording_id = 'short'").orderBy("sample_idx").toPandas()["baseline"], alone)
    sparse = baseline.local_baseline(long, 101, 90.0).orderBy("sample_idx").toPandas()["baseline"]
    assert np.allclose(both.where("recording_id = 'long'").orderBy("sample_idx").toPandas()["baseline"], sparse)


def test_recordings_go_in_one_plan(spark):
    """Each recording's events are those that it has alone, with a threshold of its own."""
    config = DetectionConfig(baseline_window_sec=0.3, baseline_iterations=1, gmm_max_components=4)
    made = [generate(1.8, 10_000.0, white=w, pink=0.0, events=[Planted(0.3 + 0.5 * k, [(0.02, d)]) for k in range(3)], seed=n) for n, (w, d) in enumerate([(2.0, 140.0), (1.0, 60.0)])]
    alone = [run(samples(spark, m.values, f"r{n}"), 10_000.0, config) for n, m in enumerate(made)]
    both = run(samples(spark, made[0].values, "r0").union(samples(spark, made[1].values, "r1")), 10_000.0, config)
    for n, one in enumerate(alone):
        assert pairs(both.events.where(f"recording_id = 'r{n}'")) == pairs(one.events) and one.events.count() == 3
    assert both.thresholds.where("is_base").select("threshold").distinct().count() == 2


def test_hysteresis_in_both_directions(spark):
    x = np.zeros(60)
    x[10:14], x[20:26], x[22] = 3.0, 3.0, 9.0
    s = samples(spark, x)
    assert pairs(events.hysteresis_events(s, 5.0, 2.0, 2, 1)) == [(20, 26)]
    assert pairs(events.hysteresis_events(samples(spark, -x), -5.0, -2.0, 2, 1, "down")) == [(20, 26)]


@pytest.mark.parametrize(("direct", "noise_way"), [(10_000_000, "mad"), (1000, "std")])
def test_chunked_baseline_is_the_one_of_rows(spark, monkeypatch, direct, noise_way):
    """Small chunks with borrowed borders give the rows' baseline, noise and residual, exactly selected."""
    from tracelake.operators import chunked

    for m in (baseline, chunked):
        monkeypatch.setattr(m, "DIRECT", direct)
    monkeypatch.setattr(chunked, "PARTS", 16)
    monkeypatch.setattr(chunked, "FEW", 20)
    x = 100 + np.linspace(0, 5, 3000) + np.random.default_rng(14).normal(0, 2, 3000)
    x[1000:1100] -= 40
    x[1700:1705] = np.nan
    both = samples(spark, x, "a").union(samples(spark, x[:311], "b"))
    rows = baseline.estimate_baseline(both, 1.0, 201.0, 1, noise_estimation=noise_way)
    layout = chunked.Layout(401, 100)
    level = chunked.estimate_baseline(chunked.to_chunks(both, layout.size, layout.halo), layout, 201, 1, noise_estimation=noise_way)
    got = chunked.rows_of(level, layout, 201).orderBy("recording_id", "sample_idx").toPandas()
    want = rows.orderBy("recording_id", "sample_idx").toPandas()
    assert len(got) == len(want) == 3311 and np.allclose(got["baseline"], want["baseline"], rtol=0, atol=1e-9)
    ours = dict(level.select("recording_id", "noise").distinct().collect())
    assert ours == pytest.approx(want.groupby("recording_id")["noise"].first().to_dict(), rel=1e-9)


def test_baseline_does_not_switch_by_size(spark):
    """A recording of over 10 million samples x window has every sample's own percentile, as its first part alone has."""
    from tracelake.functions import windows
    from tracelake.operators import chunked

    x = 100 + np.random.default_rng(16).normal(0, 5, 200_000)
    long = spark.createDataFrame(pd.DataFrame({"recording_id": "r", "sample_idx": np.arange(len(x)), "value": x}))
    grid = chunked.layout_of(51)
    want = windows.smooth_lines(windows.every_percentile(x, np.ones(len(x), bool), np.arange(len(x)), 25, 50.0), 0, len(x), 1, len(x), 51, 0, len(x))
    level = chunked.estimate_baseline(chunked.to_chunks(long, grid.size, grid.halo), grid, 51, 0, 50.0, 1000.0)
    got = chunked.rows_of(level, grid, 51).orderBy("sample_idx").toPandas()["baseline"]
    assert np.allclose(got, want, rtol=0, atol=1e-9)
    rows = baseline.local_baseline(long, 51, 50.0).orderBy("sample_idx").toPandas()["baseline"]
    assert np.allclose(rows, want, rtol=0, atol=1e-9)


def test_runs_are_merged_in_stretches(spark):
    """Whatever the stretches, and in none of them more than its own runs and those that reach it."""
    x = (np.random.default_rng(18).random(3000) < 0.5).astype(float)
    x[700:1500] = 1.0
    runs = events.find_runs(samples(spark, x).union(samples(spark, 1 - x, "b")), F.col("value") > 0, (F.max("sample_idx").alias("top"),), 50).localCheckpoint()
    for gap in (0, 1, 4):
        whole = sorted(map(tuple, events.merge_runs(runs, gap, ("top",), 10**9).collect()))
        assert whole == sorted(map(tuple, events.merge_runs(runs, gap, ("top",), 64).collect()))
        y = np.concatenate([np.zeros(10), x, np.zeros(10)]) > 0
        edge = np.flatnonzero(np.diff(y.astype(np.int8))) - 9
        begin, end = edge[0::2], edge[1::2]
        far = begin[1:] - end[:-1] > gap
        assert [(r[1], r[2]) for r in whole if r[0] == "a"] == list(zip(begin[np.r_[True, far]].tolist(), end[np.r_[far, True]].tolist(), strict=True))


def test_lots_hold_whole_events(spark, monkeypatch):
    from tracelake.operators import inference

    monkeypatch.setattr(inference, "LOT", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        spans = [(0, 20), (20, 300), (300, 310), (310, 347), (347, 1000)]
        ev = spark.createDataFrame([("a", a, b) for a, b in spans], "recording_id string, start_idx long, end_idx long")
        got = inference._per_event(samples(spark, np.arange(1000)), ev, "value", lambda lot: [(r, a, len(x), float(x.sum()), bool((np.diff(x) == 1).all())) for r, a, x in lot], "recording_id string, start long, n long, total double, dense boolean").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got)) == [("a", a, b - a, float(sum(range(a, b))), True) for a, b in spans]


def test_narrow_means_are_plain_ones():
    """Not differences of running sums: a residual that lies on a threshold stays there."""
    from tracelake.functions import windows

    x = np.round(np.random.default_rng(17).gamma(2.0, 50.0, 5000), 2)
    got = windows.smooth_lines(x, 0, 5000, 1, 5000, 51, 0, 5000)
    want = [0.0] * 5000
    for i in range(5000):
        part = x[max(0, i - 2) : i + 3].tolist()
        total = 0.0
        for v in part:
            total += v
        want[i] = total / len(part)
    assert got.tolist() == want
    assert windows.smooth_lines(x[90:], 90, 5000, 1, 5000, 51, 100, 50).tolist() == want[100:150]


def test_sparse_chunks_are_those_of_rows(spark, monkeypatch):
    from tracelake.operators import chunked

    for m in (baseline, chunked):
        monkeypatch.setattr(m, "DIRECT", 100)
    x = 100 + np.linspace(0, 5, 3000) + np.random.default_rng(14).normal(0, 2, 3000)
    x[1000:1100] -= 40
    grid = chunked.Layout(401, 100)
    level = chunked.estimate_baseline(chunked.to_chunks(samples(spark, x), 401, 100), grid, 201, 1)
    got = chunked.rows_of(level, grid, 201).orderBy("sample_idx").toPandas()["baseline"]
    want = baseline.estimate_baseline(samples(spark, x), 1.0, 201.0, 1).orderBy("sample_idx").toPandas()["baseline"]
    assert np.allclose(got, want, rtol=0, atol=1e-9)


def test_chunked_filter_is_the_one_of_rows(spark):
    from tracelake.functions.filters import zero_phase_kernel
    from tracelake.operators import chunked

    x = np.random.default_rng(15).normal(size=1000)
    both = samples(spark, x, "a").union(samples(spark, x[:7], "b"))
    kernel = zero_phase_kernel("bessel", 4, 0.05, 1.0)
    layout = chunked.Layout(300, 20)
    got = chunked.filtered(chunked.to_chunks(both, 300, 20 + len(kernel) // 2), layout, kernel).collect()
    want = filtering.lowpass(both, 1.0, 0.05).toPandas().sort_values(["recording_id", "sample_idx"])
    for r in got:
        own = want[want["recording_id"] == r["recording_id"]]["filtered"].to_numpy()
        y = np.frombuffer(r["data"])
        assert np.allclose(y, own[r["first"] : r["first"] + len(y)], atol=1e-9) and r["first"] == max(0, r["chunk"] * 300 - 20)


def test_joined_signals_lead_back(spark):
    """Sub-levels, times and clean runs of a signal that was joined from ranges."""
    table = spark.createDataFrame([(0, 10, 20, 0), (1, 50, 80, 10)], "range long, i0 long, i1 long, base long")
    level = "array<struct<sublevel_idx: int, from_idx: long, to_idx: long>>"
    ev = spark.createDataFrame([("a", 12, 20, 0.0, 0.0, [(0, 12, 15), (1, 15, 20)])], f"recording_id string, start_idx long, end_idx long, start_time double, end_time double, sublevels {level}")
    r = ranges.restore(ev, table, 10.0).first()
    assert (r["start_idx"], r["end_idx"], r["start_time"]) == (52, 60, 5.2) and [(s["from_idx"], s["to_idx"]) for s in r["sublevels"]] == [(52, 55), (55, 60)]
    moved = ranges.shift(ev, 100, 10.0).first()
    assert (moved["start_idx"], moved["sublevels"][1]["to_idx"]) == (112, 120)
    times = [x["time"] for x in ranges.times_of(samples(spark, np.zeros(40)), 10.0, table).orderBy("sample_idx").collect()]
    assert times[9:11] == [1.9, 5.0] and len(times) == 40
    assert ranges.index_range(table, 1.5, 5.2, 10.0) == (5, 12) and ranges.index_range(table, 2.0, 5.0, 10.0) == (0, 0)
    n = spark.createDataFrame([("a", 40)], "recording_id string, n long")
    gone = spark.createDataFrame([("a", 3, 5)], "recording_id string, start_idx long, end_idx long")
    assert pairs(spectrum.clean_runs(n, gone, spark.createDataFrame([("a", 10)], "recording_id string, at long"))) == [(0, 3), (5, 10), (10, 40)]
    assert sinks.csv_text(n).splitlines() == ["recording_id,n", "a,40"]
    with pytest.raises(ValueError):
        sinks.csv_text(spark.range(5), 4)


def test_scores_of_each_recording(spark):
    from tracelake.operators import scoring

    kind = "recording_id string, id long, start double, end double, depth double, n_levels int, level_bounds array<double>"
    truth = spark.createDataFrame([("a", 0, 0.0, 1.0, 10.0, 2, [0.5]), ("a", 1, 2.0, 3.0, 10.0, 1, []), ("b", 0, 0.0, 1.0, 5.0, 1, [])], kind)
    det = spark.createDataFrame([("a", 0, 0.0, 1.1, 11.0, 2, [0.6]), ("a", 1, 5.0, 6.0, 1.0, 1, []), ("c", 0, 0.0, 1.0, 5.0, 1, [])], kind)
    got = {r["recording_id"]: r for r in scoring.evaluate(truth, det, 1.0).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a["tp"], a["recall"], a["precision"], a["f1"], a["f1_any"]) == (1, 0.5, 0.5, 0.5, 0.5)
    assert a["dwell_err"] == pytest.approx(0.1) and a["depth_err"] == pytest.approx(0.1) and a["level_acc"] == 1.0 and a["bound_err_us"] == pytest.approx(1e5)
    assert (b["tp"], b["recall"], b["precision"], b["f1"]) == (0, 0.0, 0.0, 0.0) and np.isnan(b["dwell_err"])
    assert np.isnan(c["recall"]) and (c["precision"], c["f1"]) == (0.0, 0.0)


def test_the_shared_folder_is_cleaned(spark):
    import os

    one = layout.settled(spark.range(5))
    folder = layout.shared(spark).removeprefix("file://")
    assert one.count() == 5 and os.listdir(folder)
    layout.clean(spark)
    assert not os.path.exists(folder) and layout.settled(spark.range(3)).count() == 3
