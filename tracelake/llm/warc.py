"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each task appends one gzip member per record to a file of its own in the store and hands out index rows
(file, offset, length, URL, digest); a file takes its final name only when it is complete. Payloads of at least
`revisit_bytes` bytes that equal an earlier one (the smallest id) become revisit records without a body.
Reading: the index is filtered to the wanted records, neighbours in a file are coalesced into one range, and every range is
one sequential read, parsed and checked against the digest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm.common import open_store, prepare, scratch, written

ROLL = 512 << 20
RANGE = 8 << 20
GAP = 64 << 10
BLANK = b"\r\n"
INDEX = "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: a response with the payload as its block, or a revisit of an identical payload of `size` bytes."""
    revisit = refers_to is not None
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([] if url is None else ["WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)]),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}"]
    block = b"" if revisit else payload
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"".join(("\r\n".join(head).encode(), BLANK * 2, block, BLANK * 2))


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields in lower case, block) of one record."""
    head, _, rest = data.partition(BLANK * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(fields["content-length"])
    if rest[size:] != BLANK * 2:
        raise ValueError("a record's length does not fit")
    return fields, rest[:size]


def write_warc(pages: DataFrame, folder: str, revisit_bytes: int = 100, level: int = 6, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Write one record per page; the index, written as a table.

    Which pages are revisits is worked out without bodies, by (id, digest); bodies are then joined to that on the same two
    columns, so a popular payload does not gather in one task, and revisits send none.
    A null body is empty; null URLs have no target field; repeated ids give as many records; an id of null is kept and never
    the one that others refer to, except where all ids of a payload are null: then all are responses. Bodies of any length
    are one record; an empty table gives an empty index; other columns, whatever their names, are ignored.
    """
    spark = prepare(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    hashed = rows.withColumn("digest", F.sha2("body", 256)).withColumn("size", F.octet_length("body"))
    long = hashed.where(F.col("size") >= revisit_bytes).select("page_id", "digest")
    again = long.groupBy("digest").agg(F.min("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").select("digest", "original")
    again = written(again, "repeated")
    other = ~F.col("page_id").eqNullSafe(F.col("original"))
    refs = written(long.join(again, "digest").where(other).distinct(), "revisits").alias("r")
    typed = hashed.alias("h").join(refs, F.col("h.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("h.digest") == F.col("r.digest")), "left")
    typed = typed.select("h.page_id", "url", F.when(F.col("original").isNull(), F.col("body")).alias("body"), "size", "h.digest", F.col("original").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        sink, name, at, rows = None, "", 0, []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal sink, rows
            if sink is not None:
                sink.close()
                fs.move(f"{base}/.{name}", f"{base}/{name}")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                    names=["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"],
                )
                sink, rows = None, []

        for batch in batches:
            for page, url, body, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url")), batch.column("body"), *(batch.column(c).to_pylist() for c in ("size", "digest", "refers_to")), strict=True):
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    sink = fs.open_output_stream(f"{base}/.{name}", compression=None)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = squeeze.compress(record(page, url, body.as_py(), size, digest, refers)) + squeeze.flush()
                sink.write(data)
                rows.append((page, url, digest, "response" if refers is None else "revisit", refers, f"{folder}/{name}", at, len(data)))
                at += len(data)
                if at >= ROLL:
                    yield from close()
        yield from close()

    return written(typed.mapInArrow(run, INDEX), "warc-index")


def ranges(index: DataFrame, most: int = RANGE, gap: int = GAP) -> DataFrame:
    """(file, start, stop, records) of sorted, coalesced reads: records of one stretch of `most` bytes with gaps below `gap`.

    A stretch has its bytes bounded, so no group grows with a file.
    """
    cut = index.select("file", "offset", "length", F.floor(F.col("offset") / most).alias("stretch"))
    near = Window.partitionBy("file", "stretch").orderBy("offset")
    new = F.coalesce((F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(near) > gap).cast("int"), F.lit(1))
    runs = cut.withColumn("new", new).withColumn("run", F.sum("new").over(near))
    return runs.groupBy("file", "stretch", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("records"))


def read_warc(index: DataFrame, most: int = RANGE, gap: int = GAP, payloads: bool = False) -> DataFrame:
    """Records that an index (or a part of it) names: page_id, payload_bytes, payload_digest, record_type, refers_to, and
    with `payloads` the body (null for revisits).

    An empty index gives no rows; a row that occurs twice gives its record twice; records of any length are read whole;
    other columns of the index are ignored; a record that does not fit its digest fails the job.
    """
    spark = prepare(index.sparkSession)
    wanted = ranges(index, most, gap).repartition(max(1, spark.sparkContext.defaultParallelism * 4), "file", "start")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["body"] if payloads else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                fs, path = open_store(batch.column("file")[n].as_py())
                start, stop = batch.column("start")[n].as_py(), batch.column("stop")[n].as_py()
                with fs.open_input_file(path) as src:
                    data = src.read_at(stop - start, start)
                found = []
                for r in batch.column("records")[n].as_py():
                    at = r["offset"] - start
                    head, block = parse(zlib.decompress(data[at : at + r["length"]], 31))
                    digest, kind, size = head["warc-payload-digest"].removeprefix("sha256:"), head["warc-type"], int(head["x-payload-length"])
                    if kind == "response" and (hashlib.sha256(block).hexdigest() != digest or len(block) != size):
                        raise ValueError(f"damaged record at {r['offset']} of {path}")
                    page, refers = head.get("x-page-id"), head.get("x-refers-to-page")
                    found.append((page and int(page), size, digest, kind, refers and int(refers), None if kind == "revisit" else block))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*found, strict=True))[: len(names)], kinds, strict=False)], names=names)

    return wanted.select("file", "start", "stop", "records").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", body binary" if payloads else ""))


def archive_round_trip(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """Write all pages as archives, then read every record back through the index."""
    folder = scratch(prepare(pages.sparkSession), "warc")
    return read_warc(write_warc(pages, folder, revisit_bytes))
