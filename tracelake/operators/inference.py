"""Per-event models: lots of whole events, NumPy kernels in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.deploy import ship
from tracelake.operators.events import contained

SUBLEVEL = "recording_id string, event_start long, sublevel_idx int, level_index int, start_idx long, end_idx long, start_time double, end_time double, duration double, mean_current double, std_current double"
STATES = "recording_id string, event_start long, n_states int, state int, mean double, std double, dwell_mean double, n_runs int, log_likelihood double, bic double"


def dealt(groups: DataFrame, *by: str) -> DataFrame:
    """Rows dealt by key into as many parts as the session's shuffles have. Adaptive execution joins parts by their bytes, which
    would put costly models of small groups into a few tasks; a number that is asked for stays."""
    return groups.repartition(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


#: Samples of a lot: a task works on whole events of so many samples at a time, or on one longer event.
LOT = 1 << 18


def _per_event(samples: DataFrame, events: DataFrame | None, column: str, kernel, schema: str) -> DataFrame:
    """Rows that a kernel gives for lots of events, (recording_id, start_idx, values) each.

    events None: samples hold those of the events alone, with their start_idx.
    """
    ship(samples.sparkSession)
    if events is None:
        inside = samples.select("recording_id", "start_idx", "sample_idx", F.col(column).cast("double").alias("x"))
    else:
        inside = contained(samples.select("recording_id", "sample_idx", F.col(column).cast("double").alias("x")), events.select("recording_id", "start_idx", "end_idx"))
    sorted_ = dealt(inside.select("recording_id", "start_idx", "sample_idx", "x"), "recording_id", "start_idx").sortWithinPartitions("recording_id", "start_idx", "sample_idx")

    def borders(part: pd.DataFrame) -> np.ndarray:
        """First rows of events but the first one."""
        rec, start = part["recording_id"].to_numpy(), part["start_idx"].to_numpy()
        return np.flatnonzero((rec[1:] != rec[:-1]) | (start[1:] != start[:-1])) + 1

    def lot(parts: list[pd.DataFrame]) -> list[tuple[str, int, np.ndarray]]:
        part = pd.concat(parts)
        edge = [0, *borders(part).tolist(), len(part)]
        rec, start, x = part["recording_id"].to_numpy(), part["start_idx"].to_numpy(), part["x"].to_numpy()
        return [(rec[a], int(start[a]), x[a:b].copy()) for a, b in zip(edge, edge[1:], strict=False)]

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not len(batch):
                continue
            if rows + len(batch) >= LOT:
                cut = borders(pd.concat([held[-1].iloc[-1:], batch]) if held else batch)
                if len(cut):
                    at = int(cut[-1]) - bool(held)
                    yield _frame(schema, kernel(lot([*held, batch.iloc[:at]])))
                    held, rows, batch = [], 0, batch.iloc[at:]
            held.append(batch)
            rows += len(batch)
        if held:
            yield _frame(schema, kernel(lot(held)))

    return sorted_.mapInPandas(run, schema)


def _frame(schema: str, rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])


def sublevels(samples: DataFrame, events: DataFrame | None, rate: float, cutoff: float | None, method: str = "dpgmm", most: int = 5, least: int = 50, concentration: float | None = None, column: str = "value") -> DataFrame:
    """One row per level of each event with two levels or more."""

    def kernel(lot):
        from tracelake.functions.sublevels import find_sublevels

        out = []
        for rec, start, x in lot:
            found = find_sublevels(x, start, rate, cutoff, method, most, least, concentration)
            out += [(rec, start, i, s["level_index"], s["start_idx"], s["end_idx"], s["start_time"], s["end_time"], s["duration"], s["mean_current"], s["std_current"]) for i, s in enumerate(found)]
        return out

    return _per_event(samples, events, column, kernel, SUBLEVEL)


def hidden_states(samples: DataFrame, events: DataFrame | None, rate: float, method: str = "bic", most: int = 5, step: int = 1, column: str = "value") -> DataFrame:
    """One row per hidden state of each event of ten samples or more."""

    def kernel(lot):
        from tracelake.functions.hmm import states_by_criterion
        from tracelake.functions.sticky import states_sticky_many

        found = [states_by_criterion(x, most) for _, _, x in lot] if method == "bic" else states_sticky_many([x for _, _, x in lot], rate, step, most=most)
        out = []
        for (rec, start, _), got in zip(lot, found, strict=True):
            if got is not None:
                dwell = got.dwell_times(rate)
                out += [(rec, start, len(got.means), s, float(got.means[s]), float(got.stds[s]), float(np.mean(dwell[s])) if len(dwell[s]) else None, len(dwell[s]), got.log_likelihood, got.bic) for s in range(len(got.means))]
        return out

    return _per_event(samples, events, column, kernel, STATES)


def change_points(samples: DataFrame, events: DataFrame, method: str = "exact", factor: float = 1.5, least: int = 10, hazard: float = 1 / 100, column: str = "value") -> DataFrame:
    """(recording_id, event_start, at) of each change point, as an index of the recording."""
    schema = "recording_id string, event_start long, at long"

    def kernel(lot):
        from tracelake.functions.changepoints import online, optimal_partition

        out = []
        for rec, start, x in lot:
            cuts = optimal_partition(x, factor, least) if method == "exact" else online(x, hazard, least=least)[0]
            out += [(rec, start, start + c) for c in cuts]
        return out

    return _per_event(samples, events, column, kernel, schema)


def thresholds(drawn: DataFrame, method: str, most: int, sign: float = 1.0, components: int = 10, criterion: str = "bic", concentration: float | None = None, seed: int = 0) -> DataFrame:
    """(recording_id, component, mean, std, weight, is_base, threshold) of the mixture of each recording's residuals.

    drawn: recording_id, sample_idx, draw, residual. A recording is fitted on its `most` smallest draws in one task;
    recordings go in parallel. Residuals are multiplied by `sign` first.
    """
    ship(drawn.sparkSession)
    schema = "recording_id string, component int, mean double, std double, weight double, is_base boolean, threshold double"

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        from tracelake.functions.mixtures import determine_threshold

        part = part.sort_values(["draw", "sample_idx"]).head(most)
        t = determine_threshold(sign * part["residual"].to_numpy(), method, components, criterion, concentration, seed)
        return _frame(schema, [(part["recording_id"].iloc[0], i, float(m), float(s), float(w), i == t.base, float(t.value)) for i, (m, s, w) in enumerate(zip(t.means, t.stds, t.weights, strict=True))])

    return drawn.groupBy("recording_id").applyInPandas(fit, schema)


def dwell_posteriors(durations: DataFrame, by: str, draws: int = 3000, burn: int = 1000) -> DataFrame:
    """Mixture of dwell times per group of a table (by, duration); groups under five durations are left out.

    A group's task gets each different duration once, with its count.
    """
    ship(durations.sparkSession)
    schema = f"{by} string, component int, n_components int, tau_mean double, tau_lower double, tau_upper double, weight double, n_events long"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        from tracelake.functions.bayes import dwell_mixture

        part = part.sort_values("duration")
        t, counts = part["duration"].to_numpy(float), part["count"].to_numpy()
        if counts[t > 0].sum() < 5:
            return _frame(schema, [])
        m = dwell_mixture(t, draws=draws, burn=burn, counts=counts)
        return _frame(schema, [(part[by].iloc[0], i, m.n_components, m.tau_mean[i], m.tau_lower[i], m.tau_upper[i], m.weights[i], m.n_events) for i in range(m.n_components)])

    counted = durations.select(F.col(by).cast("string").alias(by), F.col("duration").cast("double").alias("duration")).groupBy(by, "duration").count()
    return dealt(counted, by).groupBy(by).applyInPandas(run, schema)


def cluster(features: DataFrame, most: int = 10, concentration: float | None = None, least: float = 2.0, sample: int = 20_000, seed: int = 0) -> tuple[DataFrame, list[dict]]:
    """(features with cluster_id and cluster_prob, summary per cluster, largest first).

    The mixture is fitted on a bounded sample of events (those with the smallest hashes); every event is assigned.
    """
    from tracelake.functions.mixtures import fit_dirichlet_process

    spark = features.sparkSession
    ship(spark)
    names = [c for c in features.columns if c.startswith("f_")]
    kind = ", ".join(f"{c} {t}" for c, t in features.dtypes) + ", cluster_id int, cluster_prob double"
    drawn = features.orderBy(F.xxhash64("recording_id", "start_idx", F.lit(seed)), "recording_id", "start_idx").limit(sample).select(*names).toPandas().to_numpy(float)
    n = len(drawn)
    if n == 0:
        return features.withColumn("cluster_id", F.lit(None).cast("int")).withColumn("cluster_prob", F.lit(None).cast("double")), []
    if n < 3:
        return features.withColumn("cluster_id", F.lit(0)).withColumn("cluster_prob", F.lit(1.0)), [{"cluster_id": 0, "n_events": n, "weight": 1.0, "mean": drawn.mean(axis=0).tolist(), "std": drawn.std(axis=0).tolist()}]
    drawn = drawn[np.lexsort(drawn.T)]
    center, scale = drawn.mean(axis=0), drawn.std(axis=0)
    scale = np.where(scale == 0, 1.0, scale)
    fit = fit_dirichlet_process((drawn - center) / scale, most, concentration, steps=1000, starts=3, seed=seed)
    used = np.flatnonzero(fit.weights * n >= least)
    used = used if len(used) else np.array([int(fit.weights.argmax())])
    used = used[np.argsort(-fit.weights[used], kind="stable")]
    share = fit.weights[used] / fit.weights[used].sum()
    logs = fit.log_parts

    def assign(parts):
        for part in parts:
            z = logs((part[names].to_numpy(float) - center) / scale)[:, used]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            yield part.assign(cluster_id=p.argmax(axis=1).astype("int32"), cluster_prob=p.max(axis=1))

    out = features.mapInPandas(assign, kind)
    return out, [{"cluster_id": i, "weight": float(w), "n_events": int(round(float(w) * n)), "mean": (fit.means[j] * scale + center).tolist(), "std": (np.sqrt(np.diag(fit.covariances[j])) * scale).tolist()} for i, (j, w) in enumerate(zip(used, share, strict=True))]


def statistics_summary(events: DataFrame, seconds: float, draws: int = 3000, burn: int = 1000) -> dict:
    """Capture rate and dwell-time mixture of all events and, where there are clusters, of each one.

    A mixture needs five durations. Groups are clusters, so only a handful of rows reach the driver.
    """
    from tracelake.functions.bayes import capture_rate

    groups = events.withColumn("group", F.lit("all"))
    if "cluster_id" in events.columns:
        groups = groups.unionByName(events.where("cluster_id IS NOT NULL").withColumn("group", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string"))))
    out: dict[str, dict] = {r["group"]: {"rate": capture_rate(r["n"], seconds)} for r in groups.groupBy("group").agg(F.count("*").alias("n")).collect()}
    for r in dwell_posteriors(groups, "group", draws, burn).orderBy("group", "component").collect():
        out[r["group"]].setdefault("dwell", []).append({k: r[k] for k in ("tau_mean", "tau_lower", "tau_upper", "weight")})
    return out


def segment_detector(samples: DataFrame, spans: DataFrame, sigma: DataFrame, factor: float = 1.5, k_sigma: float = 3.0, least: int = 10, column: str = "value") -> DataFrame:
    """Events as runs of change-point segments whose mean lies k_sigma deviations below 0; spans cut the signal beforehand."""
    ship(samples.sparkSession)
    schema = "recording_id string, start_idx long, end_idx long"
    inside = contained(samples.select("recording_id", "sample_idx", F.col(column).cast("double").alias("x")), spans).join(sigma.select("recording_id", F.col("noise").alias("sd")), "recording_id")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        from tracelake.functions.changepoints import optimal_partition, segments

        part = part.sort_values("sample_idx")
        x, first = part["x"].to_numpy(), int(part["sample_idx"].iloc[0])
        low = [s for s in segments(x, optimal_partition(x, factor, least)) if s["mean"] < -k_sigma * part["sd"].iloc[0]]
        return _frame(schema, [(part["recording_id"].iloc[0], first + s["start"], first + s["end"]) for s in low])

    found = inside.groupBy("recording_id", "start_idx").applyInPandas(run, schema)
    from tracelake.operators.events import merge_runs

    return merge_runs(found, 0)
