"""Shared plumbing: the shared folder, written tables, and small Arrow helpers."""

from __future__ import annotations

import ctypes
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.deploy import ship
from tracelake.operators.layout import shared

#: Bytes of one Arrow batch sent to a Python worker; with long rows this bounds the worker's memory.
BATCH_BYTES = 8 << 20
#: Regular expression of a word, in the syntax of Spark's (Java) regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: The whitespace bytes that part words; fixed values.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def prepare(spark: SparkSession) -> SparkSession:
    """Ship the package, and bound Arrow batches by bytes, so that very long rows do not pile up in a worker."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the application's shared folder, which layout.clean() deletes."""
    return f"{shared(spark)}/{name}-{int(time.time())}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write df as Parquet to the shared folder and read it back with its own schema."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str):
    """(file system, path) of a URI, for Python code on executors."""
    import pyarrow.fs as pafs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


def put_bytes(uri: str, name: str, data: bytes) -> None:
    """Write uri/name at once: under a name of this attempt first, then moved, so that retries are harmless."""
    fs, path = open_store(uri)
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, f"{path}/{name}")


def get_bytes(uri: str, name: str) -> bytes | None:
    """Content of uri/name, None where it is missing."""
    import pyarrow.fs as pafs

    fs, path = open_store(uri)
    if fs.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{path}/{name}", compression=None) as src:
        return src.read()


def trim() -> None:
    """Give freed memory back to the system: Spark keeps idle Python workers, and their heaps would stay as large as ever."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows one after the other, offsets of n + 1) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]] if len(offsets) else data[:0]
    return data, offsets - offsets[0]


def long_column(column: pa.Array, null: int = -(2**63)) -> np.ndarray:
    """A long column as int64; null counts as the smallest value."""
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def row_slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes, never fewer than one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def total_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column over all rows."""
    return int(df.agg(F.sum(F.octet_length(column)).cast("long")).first()[0] or 0)
