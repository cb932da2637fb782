"""Blocks of whole texts, and exchanges of keys between blocks.

pack() writes the texts as blocks of some megabytes, each one file in the shared folder: a block is the durable unit that both
sends keys and gets replies. Python workers write and read these files themselves and only their names are rows, since rows
of megabytes cost the JVM several times their size in column vectors, Arrow buffers and humongous objects. exchange() deals every block's distinct keys to hash ranges ("deals"), merges
them there over all blocks, and writes the replies as one file per block. A key occurs at most once per block, so a frequent
key cannot load one task: each deal gets one entry of it per block. All steps can be run again after a lost executor.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import get_bytes, long_column, prepare, put_bytes, scratch, text_bytes, trim, written

BLOCK_BYTES = 4 << 20
#: Bytes of packed keys that one deal merges, about.
DEAL_BYTES = 6 << 20
#: Integers below which a message is not deflated.
FEW = 64
#: Bytes of messages that go to the JVM at once, about.
BATCH_OUT = 1 << 20
#: Blocks of one task.
BLOCKS_A_TASK = 2
PACKED = "block long, folder string, n_bytes long"


def pack(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> DataFrame:
    """A table of blocks, whose files hold document ids (64 bits; null as the smallest), offsets, texts one after the other, and
    the columns of `carry` as one JSON string per row."""
    folder = scratch(prepare(docs.sparkSession), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, sizes, extra, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            data = np.concatenate(parts)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
            name = uuid.uuid4().int >> 65
            columns = [pa.array(np.concatenate(ids).astype("<i8")), pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])]
            rows = pa.RecordBatch.from_arrays([*columns, *([pa.array(extra, pa.string())] if carry else [])], names=["ids", "texts", *(["carry"] if carry else [])])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(rows)
            put_bytes(folder, f"{name}.block", sink.getvalue())
            return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([folder]), pa.array([len(data)], pa.int64())], names=["block", "folder", "n_bytes"])

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            key = long_column(batch.column(0))
            at = 0
            while at < len(key):
                to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max(1, block_bytes - held), side="right")) - 1)
                to = min(to, len(key))
                ids.append(key[at:to])
                parts.append(data[offsets[at] : offsets[to]].copy())
                sizes.append(np.diff(offsets[at : to + 1]))
                extra += batch.column(2).slice(at, to - at).to_pylist() if carry else []
                held += int(offsets[to] - offsets[at])
                at = to
                if held >= block_bytes:
                    yield block()
                    ids, parts, sizes, extra, held = [], [], [], [], 0
                    trim()
        if ids:
            yield block()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.to_json(F.struct(*carry)).alias("carry")] if carry else []))
    table = written(rows.mapInArrow(run, PACKED), "blocks")
    return table.repartition(max(1, -(-table.count() // BLOCKS_A_TASK)))


def unpack(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """(block, ids, offsets, data, carry) of each block of a packed table; one at a time is in memory."""
    for block, folder in zip(batch.column("block").to_pylist(), batch.column("folder").to_pylist(), strict=True):
        if (raw := get_bytes(folder, f"{block}.block")) is None:
            raise FileNotFoundError(f"{folder}/{block}.block")
        rows = pa.ipc.open_stream(raw).read_next_batch()
        del raw
        data, offsets = text_bytes(rows.column("texts"))
        yield block, rows.column("ids").to_numpy(), offsets, data, rows.column("carry") if rows.num_columns > 2 else None
        del rows, data, offsets


def squeeze(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, deflated: high planes of small values vanish, random ones stay as they are.

    Few integers stay plain with a head of five bytes, so that a message of a few keys is not much larger than they are.
    """
    width = values.dtype.itemsize
    if len(values) < FEW:
        return struct.pack("<IB", len(values), width | 128) + np.ascontiguousarray(values).tobytes()
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T)
    out = [struct.pack("<IB", len(values), width)]
    for plane in planes:
        raw = plane.tobytes()
        small = zlib.compress(raw, 1) if int(plane.max()) < 64 or len(np.unique(plane[:512])) < 200 else raw
        out.append(struct.pack("<BI", small is not raw, len(small)) + small)
    return b"".join(out)


def unsqueeze(data: bytes, kind: str, at: int = 0) -> tuple[np.ndarray, int]:
    """(integers, position behind them)."""
    n, width = struct.unpack_from("<IB", data, at)
    at += 5
    if width & 128:
        width &= 127
        return np.frombuffer(data, kind, n, at), at + n * width
    planes = np.empty((width, n), dtype=np.uint8)
    for p in range(width):
        deflated, size = struct.unpack_from("<BI", data, at)
        at += 5
        raw = data[at : at + size]
        planes[p] = np.frombuffer(zlib.decompress(raw) if deflated else raw, np.uint8)
        at += size
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind), at


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys by their differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def unsqueeze_sorted(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    steps, at = unsqueeze(data, "<u8", at)
    return np.cumsum(steps, dtype=np.uint64), at


def deals_of(packed: DataFrame, share: float) -> int:
    """How many deals make about DEAL_BYTES each, if packed keys take `share` bytes for each byte of text."""
    size = packed.agg(F.sum("n_bytes")).first()[0] or 0
    return max(4, int(size * share / DEAL_BYTES) + 1)


def exchange(
    packed: DataFrame,
    deals: int,
    send: Callable[[int, np.ndarray, np.ndarray, np.ndarray, int], Iterator[tuple[int, bytes]]],
    merge: Callable[[list[bytes]], list[bytes]],
    name: str,
) -> str:
    """Run one exchange; the folder with one reply file per block.

    send(block, ids, offsets, data, deals) gives (deal, message) pairs; merge gets the messages of one deal and gives as many
    replies. A block's reply file holds (deal, reply) in the order of deals, see replies().
    """
    spark = packed.sparkSession
    folder = scratch(spark, name)

    def sending(block: int, found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in found], pa.int32()), pa.array([block] * len(found), pa.int64()), pa.array([m for _, m in found], pa.binary())], names=["deal", "block", "message"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, offsets, data, _ in unpack(batch):
                found, held = [], 0
                for deal, message in send(block, ids, offsets, data, deals):
                    found.append((deal, message))
                    held += len(message)
                    if held >= BATCH_OUT:
                        yield sending(block, found)
                        found, held = [], 0
                if found:
                    yield sending(block, found)
                del ids, offsets, data, found
                trim()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, messages = None, [], []

        def reply() -> Iterator[pa.RecordBatch]:
            if messages:
                out = merge(messages)
                for i in range(0, len(out), 64):
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[i : i + 64], pa.int64()), pa.array([now] * len(out[i : i + 64]), pa.int32()), pa.array(out[i : i + 64], pa.binary())], names=["block", "deal", "reply"])
                trim()

        for batch in batches:
            for deal, block, message in zip(*(batch.column(c).to_pylist() for c in ("deal", "block", "message")), strict=True):
                if deal != now:
                    yield from reply()
                    now, blocks, messages = deal, [], []
                blocks.append(block)
                messages.append(message)
        yield from reply()

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, n = None, [], 0

        def store() -> None:
            if now is not None:
                put_bytes(folder, f"{now}.reply", b"".join(parts))

        for batch in batches:
            for block, deal, reply in zip(*(batch.column(c).to_pylist() for c in ("block", "deal", "reply")), strict=True):
                if block != now:
                    store()
                    now, parts, n = block, [], n + 1
                parts.append(struct.pack("<iQ", deal, len(reply)) + reply)
        store()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    messages = packed.mapInArrow(sent, "deal int, block long, message binary")
    ordered = messages.repartition(deals, "deal").sortWithinPartitions("deal", "block")
    answers = ordered.mapInArrow(merged, "block long, deal int, reply binary")
    answers.repartition(max(1, deals // 2), "block").sortWithinPartitions("block", "deal").mapInArrow(stored, "n long").agg(F.sum("n")).collect()
    return folder


def replies(folder: str, block: int) -> dict[int, bytes]:
    """A block's replies by deal; none where it sent nothing."""
    data = get_bytes(folder, f"{block}.reply") or b""
    out, at = {}, 0
    while at < len(data):
        deal, size = struct.unpack_from("<iQ", data, at)
        out[deal] = data[at + 12 : at + 12 + size]
        at += 12 + size
    return out
