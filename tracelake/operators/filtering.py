"""Low-pass filtering of distributed signals: each chunk is convolved with borrowed borders."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.deploy import ship
from tracelake.functions.filters import zero_phase_kernel
from tracelake.operators.layout import CHUNK, with_halo


def lowpass(samples: DataFrame, rate: float, cutoff: float, kind: str = "bessel", order: int = 4, chunk: int = CHUNK) -> DataFrame:
    """samples with `filtered`; a recording's ends are mirrored, other borders take their neighbours' samples."""
    ship(samples.sparkSession)
    kernel = zero_phase_kernel(kind, order, cutoff, rate)
    h = len(kernel) // 2
    n = samples.groupBy("recording_id").agg((F.max("sample_idx") + 1).alias("n"))
    haloed = with_halo(samples.select("recording_id", "sample_idx", "value"), h, h, chunk).join(n, "recording_id")

    def convolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample_idx")
        x, first, total = part["value"].to_numpy(float), int(part["sample_idx"].iloc[0]), int(part["n"].iloc[0])
        last = first + len(x) - 1
        left, right = (h if first == 0 else 0), (h if last == total - 1 else 0)
        # mirrored ends, as often as a short recording needs
        at = np.arange(-left, len(x) + right)
        period = max(1, 2 * (len(x) - 1))
        at = np.abs((at + period // 2) % period - period // 2) if left and right else np.where(at < 0, -at, np.where(at >= len(x), 2 * (len(x) - 1) - at, at))
        y = np.convolve(x[np.clip(at, 0, len(x) - 1)], kernel, mode="valid")
        out = pd.DataFrame({"recording_id": part["recording_id"].iloc[0], "sample_idx": np.arange(len(y)) + first - left + h, "filtered": y})
        own = out["sample_idx"] // chunk == part["chunk"].iloc[0]
        return out[own]

    got = haloed.groupBy("recording_id", "chunk").applyInPandas(convolve, "recording_id string, sample_idx long, filtered double")
    return samples.join(got, ["recording_id", "sample_idx"])
