"""Token ids as length-delimited binary records, with a separate offset index.

A record is: payload length (unsigned 64 bits), masked CRC-32 of those eight bytes, payload, masked CRC-32 of the payload;
all little-endian. A mask is a rotation by 15 bits plus a constant, so that checksums of data that hold checksums stay
sound. A payload is the document id (64 bits) and the ids (16 bits each where the vocabulary allows, else 32; the file name
says which). The index file of a part holds (document id, offset, length of the whole record) per record, 24 bytes each.
Readers go by the index: a stretch of records is one read of its index entries and one of its bytes, and a shuffled read
takes any single record. A part is written under a name of its attempt and then moved, so a lost executor leaves nothing
that a reader would take.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import long_column, open_store, prepare, row_slices, scratch, text_bytes, trim, written
from tracelake.llm.tokens import byte_level

#: Added to the rotated checksum; fixed value of this record format.
MASK = 0xA282EAD8
HEAD = 12
TAIL = 4
#: Bytes of texts that are encoded at once, and of records that one task of a reader takes, about.
SLICE = 8 << 20
STRETCH = 16 << 20
ENTRY = np.dtype([("id", "<i8"), ("offset", "<u8"), ("length", "<u8")])
MANIFEST = "part long, path string, first long, n_records long, n_ids long, n_bytes long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview, at: int) -> tuple[memoryview, int] | None:
    """(payload, next position), None if the record is not complete; ValueError if a checksum does not fit."""
    if at + HEAD > len(data):
        return None
    size, check = struct.unpack_from("<QI", data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError("damaged record length")
    end = at + HEAD + size + TAIL
    if end > len(data):
        return None
    payload = data[at + HEAD : end - TAIL]
    if masked(payload) != struct.unpack_from("<I", data, end - TAIL)[0]:
        raise ValueError("damaged record")
    return payload, end


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", threads: int = 1) -> DataFrame:
    """Encode every whole text and write record and index files in ascending id order; the manifest, a row per stretch of
    about STRETCH bytes: part, path, number of its first record, records, ids, bytes.

    Null texts count as empty, null ids come first (as the smallest long), rows of one id are ordered by a hash of their
    text, so that ranges can part them, texts of any length are one record, an empty table writes no part, other columns
    are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        encoder, tail, sink, at, index, stretches = None, b"", None, 0, [], []
        part = TaskContext.get().partitionId()
        n = ids_n = begun = 0

        def stretch() -> None:
            nonlocal n, ids_n, begun
            if n:
                stretches.append((part, f"{folder}/{name}", len(index) - n, n, ids_n, at - begun))
            n, ids_n, begun = 0, 0, at

        for batch in batches:
            if not batch.num_rows:
                continue
            if encoder is None:
                encoder = byte_level(tokenizer, threads)
                tail = np.array([end_id], encoder.kind).tobytes() if end_id is not None else b""
                fs, base = open_store(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}.{'u16' if encoder.kind == '<u2' else 'u32'}"
                sink = fs.open_output_stream(f"{base}/.{name}", compression=None)
            ids = long_column(batch.column(0))
            for i, j in row_slices(text_bytes(batch.column(1))[1], SLICE):
                out = []
                for doc, code in zip(ids[i:j].tolist(), encoder.encode(batch.column(1).slice(i, j - i)), strict=True):
                    record = frame(b"".join((struct.pack("<q", doc), code, tail)))
                    out.append(record)
                    index.append(struct.pack("<qQQ", doc, at, len(record)))
                    at, n, ids_n = at + len(record), n + 1, ids_n + (len(code) + len(tail)) // int(encoder.kind[-1])
                    if at - begun >= STRETCH:
                        stretch()
                sink.write(b"".join(out))
                del out
            trim()
        if sink is not None:
            stretch()
            sink.close()
            with fs.open_output_stream(f"{base}/.{name}.index", compression=None) as out:
                out.write(b"".join(index))
            fs.move(f"{base}/.{name}.index", f"{base}/{name}.index")
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*stretches, strict=True)], names=[f.split()[0] for f in MANIFEST.split(", ")])
        trim()

    return dealt.mapInArrow(run, MANIFEST)


def read_records(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read by the index and checked, stretch by stretch.

    start counts the ids of all records before; ids_crc32 is over the ids as little-endian unsigned 32 bits. An empty
    manifest gives no rows.
    """
    spark = prepare(manifest.sparkSession)
    files = manifest.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    inside = Window.partitionBy("part").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("head"))
    placed = manifest.withColumn("inner", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(heads, "part")
    stretches = placed.select("path", "first", "n_records", (F.col("head") + F.col("inner")).cast("long").alias("base"))
    stretches = stretches.repartition(max(1, spark.sparkContext.defaultParallelism * 4), "path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, n, start in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                rows = []
                for doc, ids in read_stretch(path, first, n):
                    rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4"))))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["id", "start", "n_tokens", "ids_crc32"])
        trim()

    return stretches.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")


def _ids(payload: memoryview, path: str) -> tuple[int, np.ndarray]:
    return struct.unpack_from("<q", payload)[0], np.frombuffer(payload[8:], dtype="<u2" if path.endswith(".u16") else "<u4")


def read_stretch(path: str, first: int, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(document id, ids) of the records from number `first` on, where the index says they are."""
    fs, local = open_store(path)
    with fs.open_input_file(f"{local}.index") as src:
        index = np.frombuffer(src.read_at(n * ENTRY.itemsize, first * ENTRY.itemsize), dtype=ENTRY)
    begin = int(index["offset"][0])
    size = int(index["offset"][-1]) + int(index["length"][-1]) - begin
    with fs.open_input_file(local) as src:
        data = memoryview(src.read_at(size, begin))
    for entry in index:
        at = int(entry["offset"]) - begin
        found = unframe(data[at : at + int(entry["length"])], 0)
        if found is None:
            raise ValueError(f"{path} ends within a record")
        doc, ids = _ids(found[0], path)
        if doc != entry["id"]:
            raise ValueError(f"the index of {path} names another document")
        yield doc, ids


def read_at(path: str, offset: int, length: int) -> tuple[int, np.ndarray]:
    """(document id, ids) of one record by its index entry, for shuffled reads."""
    fs, local = open_store(path)
    with fs.open_input_file(local) as src:
        payload, _ = unframe(memoryview(src.read_at(length, offset)), 0)
    doc, ids = _ids(payload, path)
    return doc, ids.astype(np.int64)


def read_index(path: str) -> np.ndarray:
    """(document id, offset, length) per record of a part."""
    fs, local = open_store(f"{path}.index")
    with fs.open_input_stream(local, compression=None) as src:
        return np.frombuffer(src.read(), dtype=ENTRY)


def token_records(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents as records, read the files back: (id, start, n_tokens, ids_crc32) per document."""
    folder = scratch(prepare(docs.sparkSession), "records")
    manifest = written(write_records(docs, tokenizer, folder, id_col=id_col, text_col=text_col), "manifest")
    return read_records(manifest).withColumnRenamed("id", id_col)
