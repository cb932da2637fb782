"""Reader of raw sample files as a Spark data source, `format("rawsignal")`, and of the ABF 2 container's layout.

Each partition is a byte range of whole samples, decoded to Arrow batches; options give what the file does not say:
sampling_rate, dtype (int16, int32, uint16, float32, float64, each with _le or _be), header_bytes, scale_factor, offset,
max_samples, channels and channel (interleaved files: one channel is read), recording_id.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Sample types; fixed values of the format.
KINDS = {"int16": "i2", "int32": "i4", "uint16": "u2", "float32": "f4", "float64": "f8"}
SCHEMA = "recording_id string, channel int, sample_idx long, value float"
PART_BYTES = 32 << 20
BATCH = 1 << 18


def sample_type(name: str) -> np.dtype:
    base, _, order = name.partition("_")
    if base not in KINDS or order not in ("", "le", "be"):
        raise ValueError(f"unknown sample type: {name}")
    return np.dtype((">" if order == "be" else "<") + KINDS[base])


def opened(path: str):
    """(file system, path): any store that Arrow reads, or a local path."""
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def binary_info(path: str, dtype: str = "int16", header_bytes: int = 0, sampling_rate: float | None = None, channels: int = 1) -> dict:
    """Size, samples and duration of a raw file, without reading it."""
    import pyarrow.fs as pafs

    fs, local = opened(path)
    info = fs.get_file_info(local)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    n = max(0, info.size - header_bytes) // (sample_type(dtype).itemsize * channels)
    return {"file_size": info.size, "n_samples": n, "duration": n / sampling_rate if sampling_rate else None}


def pieces(path: str, dtype: str, header_bytes: int, channels: int) -> list[tuple[str, int, int]]:
    """(file, number of its first sample, samples) of a file, or of a folder's raw files in the order of their names: those are
    one signal after the other, each with a header of its own."""
    import pyarrow.fs as pafs

    fs, local = opened(path)
    if fs.get_file_info(local).type != pafs.FileType.Directory:
        return [(path, 0, binary_info(path, dtype, header_bytes, channels=channels)["n_samples"])]
    out, at = [], 0
    for name in sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(local)) if f.is_file and not f.base_name.startswith((".", "_"))):
        n = binary_info(f"{path}/{name}", dtype, header_bytes, channels=channels)["n_samples"]
        out.append((f"{path}/{name}", at, n))
        at += n
    return out


def write_raw(samples, folder: str, dtype: str = "int16", scale_factor: float = 1.0, offset: float = 0.0, name: str | None = None) -> None:
    """One recording's samples as raw files of a folder, in the order of their names: value = stored * scale + offset. Integers
    are rounded to the nearest even and clipped. Files take their final names only when they are complete."""
    import uuid

    from tracelake.deploy import ship

    ship(samples.sparkSession)
    kind = sample_type(dtype)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = opened(folder)
        sink, first, part = None, None, f"{local}/.{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                fs.create_dir(local, recursive=True)
                sink, first = fs.open_output_stream(part, compression=None), batch.column(0)[0].as_py()
            v = (batch.column(1).to_numpy(zero_copy_only=False) - offset) / scale_factor
            if kind.kind != "f":
                v = np.clip(np.rint(v), np.iinfo(kind).min, np.iinfo(kind).max)
            sink.write(v.astype(kind).tobytes())
        if sink is not None:
            sink.close()
            fs.move(part, f"{local}/part-{first:015d}.raw")
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64())], names=["first"])

    from pyspark.sql import functions as F

    samples.select("sample_idx", F.col("value").cast("double").alias("value")).repartitionByRange("sample_idx").sortWithinPartitions("sample_idx").mapInArrow(run, "first long").collect()  # a row per part


class Range(InputPartition):
    """count samples of a file from number `first` on; `base` is the number of the file's first sample in the signal."""

    def __init__(self, path: str, first: int, count: int, base: int = 0):
        self.path, self.first, self.count, self.base = path, first, count, base


class RawReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("a path is needed")
        self.dtype = options.get("dtype", "int16")
        self.header = int(options.get("header_bytes", 0))
        self.scale, self.shift = float(options.get("scale_factor", 1)), float(options.get("offset", 0))
        self.channels, self.channel = int(options.get("channels", 1)), int(options.get("channel", 0))
        if not 0 <= self.channel < self.channels:
            raise ValueError(f"channel {self.channel} of {self.channels}")
        self.most = int(options["max_samples"]) if "max_samples" in options else None
        self.name = options.get("recording_id") or os.path.basename(self.path)
        sample_type(self.dtype)

    def ranges(self, first: int, count: int | None) -> list[Range]:
        """Parts of files that hold `count` samples of the signal from number `first` on."""
        out = []
        for path, base, n in pieces(self.path, self.dtype, self.header, self.channels):
            low, high = max(first, base), base + n if count is None else min(first + count, base + n)
            if low < high:
                out.append(Range(path, low - base, high - low, base))
        return out

    def partitions(self) -> list[Range]:
        step = max(1, PART_BYTES // (sample_type(self.dtype).itemsize * self.channels))
        cut = [Range(r.path, i, min(step, r.first + r.count - i), r.base) for r in self.ranges(0, self.most) for i in range(r.first, r.first + r.count, step)]
        return cut or [Range(self.path, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        kind = sample_type(self.dtype)
        width = kind.itemsize * self.channels
        if not part.count:
            return
        fs, local = opened(part.path)
        with fs.open_input_file(local) as src:
            for at in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - at)
                raw = np.frombuffer(src.read_at(n * width, self.header + at * width), dtype=kind).reshape(-1, self.channels)[:, self.channel]
                value = (raw.astype(np.float32) * np.float32(self.scale) + np.float32(self.shift)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([self.name] * n), pa.array(np.full(n, self.channel, np.int32)), pa.array(np.arange(at, at + n) + part.base), pa.array(value)], names=["recording_id", "channel", "sample_idx", "value"])


class RawSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawsignal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(dict(self.options))


def abf_layout(path: str) -> dict:
    """Where and how an ABF 2 file holds its samples: offset, type, channels, rate, gain and offset per channel.

    Only the fixed header and the protocol, ADC and data sections are read.
    """
    fs, local = opened(path)
    with fs.open_input_file(local) as src:
        head = src.read_at(512, 0)
        if head[:4] != b"ABF2":
            raise ValueError("only ABF 2 files are known")

        def section(at: int) -> tuple[int, int, int]:
            return struct.unpack_from("<IIq", head, at)

        kind = struct.unpack_from("<H", head, 30)[0]
        protocol, adc, data = section(76), section(92), section(236)
        body = src.read_at(protocol[1], protocol[0] * 512)
        interval = struct.unpack_from("<f", body, 2)[0]
        adc_range, resolution = struct.unpack_from("<f", body, 118)[0], struct.unpack_from("<i", body, 126)[0]
        gains = []
        for n in range(adc[2]):
            part = src.read_at(adc[1], adc[0] * 512 + n * adc[1])
            tele_on, tele_gain = struct.unpack_from("<h", part, 2)[0], struct.unpack_from("<f", part, 6)[0]
            program, inst_scale, inst_offset, signal_gain, signal_offset = (struct.unpack_from("<f", part, o)[0] for o in (28, 40, 44, 48, 52))
            factor = inst_scale * signal_gain * program * (tele_gain if tele_on else 1.0)
            gains.append((adc_range / resolution / factor if factor else 1.0, inst_offset - signal_offset))
    return {"data_offset": data[0] * 512, "dtype": "float32" if kind == 1 else "int16", "channels": adc[2], "n_samples": data[2] // max(1, adc[2]), "sampling_rate": 1e6 / interval, "scaling": gains}


def reading(path: str, sampling_rate: float | None = None, channel: int = 0, **options) -> tuple[dict, float]:
    """(reader options, sampling rate) by the file's extension: .abf says all itself, other files need a sampling rate."""
    if path.lower().endswith(".abf"):
        a = abf_layout(path)
        if not 0 <= channel < a["channels"]:
            raise ValueError(f"channel {channel} of {a['channels']}")
        gain, shift = a["scaling"][channel] if a["dtype"] == "int16" else (1.0, 0.0)
        options = {"dtype": a["dtype"], "header_bytes": a["data_offset"], "channels": a["channels"], "channel": channel, "scale_factor": gain, "offset": shift, "max_samples": a["n_samples"], **options}
        sampling_rate = a["sampling_rate"]
    elif not sampling_rate or sampling_rate <= 0:
        raise ValueError("a raw file needs a sampling rate")
    return {k: str(v) for k, v in options.items() if v is not None}, sampling_rate


def read_signal(spark: SparkSession, path: str, sampling_rate: float | None = None, channel: int = 0, **options):
    """(samples, sampling rate) of a signal file."""
    from tracelake.deploy import ship

    ship(spark)
    spark.dataSource.register(RawSource)
    options, rate = reading(path, sampling_rate, channel, **options)
    return spark.read.format("rawsignal").options(**options).load(path), rate


def read_chunks(spark: SparkSession, path: str, size: int, halo: int, options: dict[str, str]) -> DataFrame:
    """Chunks of a signal file as operators.chunked has them: each is read by its own byte range, neighbours' samples included."""
    from pyspark.sql import functions as F

    from tracelake.deploy import ship
    from tracelake.operators.chunked import KIND

    ship(spark)
    reader = RawReader({"path": path, **options})
    n = sum(r.count for r in reader.ranges(0, reader.most))
    count = -(-n // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                first, last = max(0, c * size - halo), min(n, (c + 1) * size + halo)
                parts = [b.column(3).to_numpy() for r in reader.ranges(first, last - first) for b in reader.read(r)]
                yield pa.RecordBatch.from_arrays([pa.array([reader.name]), pa.array([c], pa.int64()), pa.array([n], pa.int64()), pa.array([first], pa.int64()), pa.array([np.concatenate(parts).astype(float).tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=[f.split()[0] for f in KIND.split(", ")])

    return spark.range(0, count, 1, max(1, min(count, 10_000))).select(F.col("id")).mapInArrow(run, KIND)


def recording_info(path: str) -> dict:
    """What a file's header says, for display before it is read: name, size, format, and for ABF files channels, rate, length."""
    fs, local = opened(path)
    info = fs.get_file_info(local)
    if not info.is_file:
        raise FileNotFoundError(path)
    out = {"path": path, "name": info.base_name, "size_mb": info.size / 1e6, "format": "abf" if path.lower().endswith(".abf") else "binary"}
    if out["format"] == "abf":
        a = abf_layout(path)
        out |= {"n_channels": a["channels"], "sampling_rate_hz": float(a["sampling_rate"]), "duration_sec": a["n_samples"] / a["sampling_rate"]}
    return out


def list_signals(folder: str) -> list[str]:
    """Signal files and sub-folders of a folder, hidden ones left out."""
    import pyarrow.fs as pafs

    fs, local = opened(folder)
    found = [f for f in fs.get_file_info(pafs.FileSelector(local)) if not f.base_name.startswith(".")]
    return sorted(f.base_name for f in found if f.type == pafs.FileType.Directory or f.extension.lower() in ("abf", "bin", "dat", "raw"))
