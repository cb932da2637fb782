"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed here, field by field. From it are rebuilt: the normaliser (the model's character map if it
has one, removal of extra blanks, the dummy blank in front), the metaspace marker, the model (unigram scores, or for BPE
models the merges in the order of their scores), byte fallback, and the decoder. Batches are encoded by the library's threads,
the ids of every text are decoded again and compared with it, and in every batch a hash-drawn share of the texts is
encoded by the sentencepiece library too and has to get the same ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import prepare, row_slices, text_bytes, trim
from tracelake.llm.tokens import WordEncoder, gather, kept

MARK = "▁"
#: Kinds of a piece and of a model in the protobuf; fixed values of the format.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SLICE = 1 << 20
#: Bytes of words that a worker remembers: ids go out as arrays here, which take memory of their own.
REMEMBERED = 40 << 20
#: One text in so many, drawn by its checksum, is compared with the sentencepiece library.
PARITY = 32


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of one protobuf message; sub-messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            yield key >> 3, struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        elif kind == 5:
            yield key >> 3, struct.unpack_from("<f", data, at)[0]
            at += 4
        else:
            raise ValueError("not a SentencePiece model")


class SpmModel:
    """What the protobuf says: pieces as (text, score, kind), model kind, and the normaliser's settings."""

    def __init__(self, path: str):
        with open(path, "rb") as src:
            data = src.read()
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f[1].decode(), float(f.get(2, 0.0)), int(f.get(3, NORMAL))))
            elif number == 2:
                f = dict(_fields(value))
                self.kind, self.byte_fallback = int(f.get(3, UNIGRAM)), bool(f.get(35, 0))
            elif number == 3:
                f = dict(_fields(value))
                self.charsmap = f.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(f.get(n, 1)) for n in (3, 4, 5))
        self.unk = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    def merges(self) -> list[tuple[str, str]]:
        """Pairs that make a piece, best piece first; of one piece's pairs, those of the earlier pieces first."""
        ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER, UNUSED)}
        found = []
        for i, (piece, score, kind) in enumerate(self.pieces):
            if kind == NORMAL and len(piece) > 1:
                pairs = [(piece[:k], piece[k:]) for k in range(1, len(piece)) if piece[:k] in ids and piece[k:] in ids]
                found += [(-score, ids[piece], ids[a], ids[b], a, b) for a, b in pairs]
        return [(a, b) for *_, a, b in sorted(found)]

    def tokenizer(self, whole: bool = True):
        """The library's tokenizer: for texts, or (whole=False) for strings that are already normalised and marked."""
        from tokenizers import Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == BPE:
            model = models.BPE(vocab, self.merges(), unk_token=self.pieces[self.unk][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        elif self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unk, self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are known")
        out = Tokenizer(model)
        if whole:
            steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
            if self.trim:
                steps += [normalizers.Strip(), normalizers.Replace(_regex(" {2,}"), " ")]
            if self.dummy_prefix:
                steps.append(normalizers.Prepend(MARK if self.escape else " "))
            if self.escape:
                steps.append(normalizers.Replace(" ", MARK))
            out.normalizer = normalizers.Sequence(steps)
        parts = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
        out.decoder = decoders.Sequence(parts + ([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else []))
        return out

    def piece_bytes(self) -> list[bytes]:
        """What each id stands for in a decoded text."""
        return [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind in (CONTROL,) else b" \xe2\x81\x87 " if kind == UNKNOWN else p.replace(MARK, " ").encode() for p, _, kind in self.pieces]


def _regex(pattern: str):
    from tokenizers import Regex

    return Regex(pattern)


class SpmEncoder:
    """Batches of texts to ids, as the sentencepiece library gives them, and back."""

    def __init__(self, path: str, threads: int = 1):
        self.path, self.threads, self.theirs = path, threads, None
        self.model = SpmModel(path)
        self.bytes = self.model.piece_bytes()
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.sizes = np.array([len(b) for b in self.bytes], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.kind = "<u2" if len(self.bytes) <= 1 << 16 else "<u4"
        m = self.model
        alone = [p for p, _, kind in m.pieces if kind == NORMAL and (MARK in p.lstrip(MARK) or "\n" in p)]
        #: Words may be taken alone if no piece runs over a marker or a line break, and blanks stay as they are.
        by_word = m.kind == BPE and not m.charsmap and not m.trim and m.escape and m.dummy_prefix and not alone
        if by_word:
            starts = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
            self.words = WordEncoder(m.tokenizer(whole=False), MARK, starts, self.kind, prefix=True, threads=threads, remembered=REMEMBERED)
        else:
            self.words = WordEncoder(m.tokenizer(), " ", np.zeros(len(self.bytes), bool), self.kind, prefix=False, threads=threads, by_word=False)
        trim()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        return [code if text else b"" for text, code in zip(texts if isinstance(texts, list) else texts.to_pylist(), self.words.encode(texts), strict=True)]

    def decode_batch(self, codes: list[bytes]) -> list[bytes]:
        """What the ids of each text stand for, as bytes, without the blank that the model puts in front."""
        ids = np.frombuffer(b"".join(codes), self.kind)
        size = self.sizes[ids]
        raw = gather(self.flat, self.starts[ids], size).tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *(len(c) // int(self.kind[-1]) for c in codes)])].tolist()
        out = [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return [o[1:] if o[:1] == b" " else o for o in out] if self.model.dummy_prefix else out

    def decode(self, code: bytes) -> str:
        return self.decode_batch([code])[0].decode("utf-8", "replace")

    def check_parity(self, texts: list[str], codes: list[bytes]) -> None:
        """Raise if the sentencepiece library gives other ids."""
        if self.theirs is None:
            import sentencepiece

            self.theirs = sentencepiece.SentencePieceProcessor(model_file=self.path)
        for text, ids, code in zip(texts, self.theirs.encode(texts, num_threads=self.threads), codes, strict=True):
            if ids != np.frombuffer(code, self.kind).tolist():
                raise ValueError(f"parity is lost at {text[:80]!r}")


def _encoder(model: str, threads: int, kind: type) -> SpmEncoder:
    return kept(("pieces", kind.__module__, kind.__qualname__, model, threads), lambda: kind(model, threads))


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, threads: int = 2, parity: int = PARITY) -> DataFrame:
    """Per document: id, n_tokens, n_fallback (tokens that stand for one byte), ids_crc32 (over the ids as little-endian
    unsigned 32 bits), back_crc32 (over the UTF-8 bytes of the decoded text), round_trip, and ids unless that is False.

    threads: those of the library for a batch. parity: one text in so many is compared with the sentencepiece library, and
    the job fails if an id differs or the library is missing; 0 leaves that out.
    Null and empty texts give no tokens; what a model without byte fallback does not know becomes its unknown piece, and
    round_trip is false there; texts of any length are encoded whole; null ids and repeated rows stay as they are; an empty
    table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    kind = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_fallback", pa.int64()), ("ids_crc32", pa.int64()), ("back_crc32", pa.int64()), ("round_trip", pa.bool_()), *([("ids", pa.list_(pa.int32()))] if ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model, threads, SpmEncoder)
        for batch in batches:
            column = batch.column(1).fill_null("")
            data, offsets = text_bytes(column)
            for i, j in row_slices(offsets, SLICE):
                part = column.slice(i, j - i)
                codes = encoder.encode(part)
                whole = [data[a:b].tobytes() for a, b in zip(offsets[i:j].tolist(), offsets[i + 1 : j + 1].tolist(), strict=True)]
                if parity and (drawn := [k for k, w in enumerate(whole) if zlib.crc32(w) % parity == 0]):
                    encoder.check_parity([whole[k].decode() for k in drawn], [codes[k] for k in drawn])
                back = [b if b == w else b.decode("utf-8", "replace").encode() for b, w in zip(encoder.decode_batch(codes), whole, strict=True)]
                flat = np.frombuffer(b"".join(codes), encoder.kind).astype("<i4")
                ends = np.cumsum([0, *(len(c) // int(encoder.kind[-1]) for c in codes)])
                fallback = np.concatenate([[0], np.cumsum(encoder.single[flat])])
                columns = [
                    batch.column(0).slice(i, j - i).cast(pa.int64()),
                    pa.array(np.diff(ends), pa.int64()),
                    pa.array(np.diff(fallback[ends]), pa.int64()),
                    pa.array([zlib.crc32(flat[a:b]) for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.int64()),
                    pa.array([zlib.crc32(b) for b in back], pa.int64()),
                    pa.array([b == w for b, w in zip(back, whole, strict=True)], pa.bool_()),
                ]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, schema=kind)
                del columns, codes, whole, back, flat, fallback
            trim()

    spark_type = "id long, n_tokens long, n_fallback long, ids_crc32 long, back_crc32 long, round_trip boolean" + (", ids array<int>" if ids else "")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, spark_type).withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with a further column text: what the ids stand for, whatever their number.

    Null ids give null, no ids the empty text; other columns, repeated rows and an empty table stay as they are, but a
    column of the name text_col gives way.
    """
    prepare(rows.sparkSession)

    @F.pandas_udf("string")
    def text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(model, 1, SpmEncoder)
        for ids in parts:
            yield pd.Series([None if x is None else encoder.decode(np.asarray(x, encoder.kind).tobytes()) for x in ids])

    return rows.withColumn(text_col, text(F.col(ids_col)))
