"""Online detection: chunks of samples in, finished events out, with a bounded state per recording.

The threshold is frozen beforehand. State is the open run's sums and the pending event that may still be merged; a chunk must
come in the order of its samples, later chunks of a batch are sorted by their first index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracelake.deploy import ship

EVENT = "recording_id string, start_idx long, end_idx long, mean double, area double"
STATE = "next long, start long, end long, total double, area double, held boolean"


def scan(x: np.ndarray, first: int, state: tuple, threshold: float, gap: int, least: int) -> tuple[list[tuple], tuple]:
    """Events that are over after the samples x from index `first` on, and the new state.

    state: (next index, start, end, sum, sum of magnitudes, whether an event is held); the sums leave out bridged gaps.
    """
    nxt, start, end, total, area, held = state
    out = []
    if first < nxt:
        x, first = x[nxt - first :], nxt
    on = np.flatnonzero(x > threshold)
    cut = np.flatnonzero(np.diff(on) > 1) + 1
    for run in np.split(on, cut):
        if not len(run):
            continue
        a, b = first + int(run[0]), first + int(run[-1]) + 1
        part = x[run[0] : run[-1] + 1]
        if held and a - end <= gap:
            end, total, area = b, total + float(part.sum()), area + float(np.abs(part).sum())
        else:
            if held and end - start >= least:
                out.append((start, end, total / (end - start), area))
            start, end, total, area, held = a, b, float(part.sum()), float(np.abs(part).sum()), True
    nxt = max(nxt, first + len(x))
    if held and nxt - end > gap:
        if end - start >= least:
            out.append((start, end, total / (end - start), area))
        held = False
    return out, (nxt, start, end, total, area, held)


def finish(state: tuple, least: int) -> list[tuple]:
    """The held event, if there is one of enough samples: nothing more is to come."""
    _, start, end, total, area, held = state
    return [(start, end, total / (end - start), area)] if held and end - start >= least else []


def detect_online(chunks: DataFrame, threshold: float, gap: int = 2, least: int = 3, idle_ms: int | None = None) -> DataFrame:
    """Events of a stream of chunks (recording_id, start_idx, values array<double> and, if there is one, `last`).

    An event that may still grow is held back. It comes out when samples beyond the gap have come, with a chunk whose `last` is
    true, or, with idle_ms, when a recording has had no chunk for that long; the recording's state goes with the latter two.
    """
    ship(chunks.sparkSession)
    names = ["recording_id", "start_idx", "end_idx", "mean", "area"]
    ends = "last" in chunks.columns

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            found = finish(tuple(state.get), least)
            state.remove()
            yield pd.DataFrame([(key[0], *f) for f in found], columns=names)
            return
        now = tuple(state.get) if state.exists else (0, 0, 0, 0.0, 0.0, False)
        rows = pd.concat(list(parts)).sort_values("start_idx")
        found = []
        for first, values in zip(rows["start_idx"], rows["values"], strict=True):
            new, now = scan(np.asarray(values, float), int(first), now, threshold, gap, least)
            found += new
        if ends and rows["last"].fillna(False).any():
            found += finish(now, least)
            if state.exists:
                state.remove()
        else:
            state.update(now)
            if idle_ms is not None:
                state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(key[0], *f) for f in found], columns=names)

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy("recording_id").applyInPandasWithState(step, EVENT, STATE, "append", timeout)
