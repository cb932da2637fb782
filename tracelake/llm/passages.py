"""Removal of repeated passages of 50 bytes and more, by prefix-free parsing.

Rolling hashes of TRIGGER bytes set triggers: the trigger of a window of PASSAGE bytes is its smallest rolling hash, so equal
windows have equal triggers and every window has one. Windows in a row with one trigger form a phrase, the bytes they cover.
A text is thus parsed into overlapping phrases, and no phrase of a trigger can hide a match with another's.

1. Triggers. Every block sends its distinct trigger strings' hashes; those seen in one document only are settled, with all
   their windows. (A hash collision here only lets a phrase into step 2.)
2. Dictionary and parse. Blocks send their distinct phrases of shared triggers, bytes and smallest document. Per range of
   triggers they become a dictionary; the suffixes of its phrases that start a window are sorted by their first PASSAGE
   bytes, and equal neighbours in that suffix order get the smallest document of their phrases' parse positions. Bytes
   are compared here, not hashes, so matches are exact.
3. Each block learns, per phrase and window, whether a smaller document has it, marks the bytes, and cuts them out.

Phrases are sent once per block, whatever their frequency; nothing about a document is collected. A trigger that very many
blocks have is hot: its phrases are taken apart into single windows, which are dealt by their own bytes, so its surroundings
spread over all ranges. The general method sorts the parse as well, to order equal dictionary suffixes by what follows
them; here phrases overlap by PASSAGE - 1 bytes, a window of PASSAGE bytes never leaves its phrase, and equal windows are one
group whatever follows, so the parse needs no suffix array: it gives each suffix its documents.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import hashing as H
from tracelake.llm.blocks import deals_of, exchange, pack, replies, squeeze, squeeze_sorted, unpack, unsqueeze, unsqueeze_sorted
from tracelake.llm.common import prepare, trim

PASSAGE = 50
TRIGGER = 24
SPAN = PASSAGE - TRIGGER + 1
#: Bytes a phrase can have: windows with one trigger start at most SPAN places apart.
LONGEST = SPAN + PASSAGE - 1
ROW = 80
CHUNK = 1 << 16
KEY_SHIFT = np.uint64(16)
#: Windows that are sorted at once; more are first parted by a hash of their first bytes.
SORTED = 1 << 16
#: Blocks that have a trigger from which on it is hot: its phrases are dealt window by window.
HOT_BLOCKS = 256
MULTIPLIERS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x7FEB352D)


def _rolling(data: np.ndarray) -> np.ndarray:
    """32-bit hash of each TRIGGER bytes, by doubling: 1, 2, 4, 8, 16 and then 16 + 8 bytes."""
    m = [np.uint32(x) for x in MULTIPLIERS]
    h = data.astype(np.uint32) * m[0] + np.uint32(1)
    h ^= h >> np.uint32(15)
    eight, n = None, 1
    for step in range(4):
        h = h[:-n] * m[1 + step] + h[n:]
        n *= 2
        if n == 8:
            eight = h
    h = h[: len(h) - 8] * m[5] + eight[16:]
    h ^= h >> np.uint32(16)
    h *= m[2]
    return h ^ (h >> np.uint32(13))


def phrases(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window start, number of window starts, trigger position) of each phrase of all rows, in order."""
    length = np.diff(offsets)
    usable = np.zeros(len(data) + 1, dtype=np.int8)
    long = length >= PASSAGE
    np.add.at(usable, offsets[:-1][long], 1)
    np.add.at(usable, offsets[1:][long] - PASSAGE + 1, -1)
    valid = np.cumsum(usable[:-1], dtype=np.int8) > 0  # rows do not overlap: 0 or 1
    first, count, trigger = [], [], []
    for c in range(0, len(data) - PASSAGE + 1, CHUNK):
        seg = data[c : c + CHUNK + PASSAGE - 1]
        h = _rolling(seg)
        low = (h.astype(np.uint64) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
        n = 1
        while 2 * n <= SPAN:
            low = np.minimum(low[:-n], low[n:])
            n *= 2
        if n < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - n)], low[SPAN - n :])
        at = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        here = np.flatnonzero(valid[c : c + len(at)])
        if not len(here):
            continue
        best = at[here]
        new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (here[1:] != here[:-1] + 1)]))
        first.append(here[new] + c)
        count.append(np.diff(np.append(new, len(here))))
        trigger.append(best[new] + c)
    if not first:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(first), np.concatenate(count), np.concatenate(trigger)


def _words(data: np.ndarray, order: str = "<") -> np.ndarray:
    """The eight bytes from each position on as one integer, without a copy; zeros follow the end."""
    flat = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), dtype=f"{order}u8", buffer=flat.data, strides=(1,))


def trigger_keys(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit hash of the TRIGGER bytes at each position."""
    if not len(at):
        return np.zeros(0, np.uint64)
    word = _words(data)
    key = H.mix(word[at] + np.uint64(TRIGGER))
    for step in range(8, TRIGGER, 8):
        key = H.mix(key + word[at + step])
    return key


def _cuts(keys: np.ndarray, deals: int) -> list[int]:
    edges = np.array([((d << 64) // deals) >> int(KEY_SHIFT) for d in range(1, deals)], dtype=np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]


def _bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _distinct_triggers(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct keys, whether each is in more than one row); docs ascend with the positions."""
    if not len(keys):
        return keys, np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k, d = keys[order], docs[order]
    head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    tail = np.append(head[1:], len(k)) - 1
    return k[head], d[head] != d[tail]


def _merge_triggers(messages: list[bytes]) -> list[bytes]:
    """For each key of a message, whether more than one document has it, and whether it is hot."""
    parts, flags = [], []
    for m in messages:
        keys, at = unsqueeze_sorted(m)
        parts.append(keys)
        flags.append(_flags(m[at:], len(keys)))
    unique, place, count = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    shared = (count > 1) | (np.bincount(place, np.concatenate(flags), len(unique)) > 0)
    ends = np.cumsum([len(k) for k in parts])[:-1]
    return [_bits(shared[p]) + _bits(count[p] >= HOT_BLOCKS) for p in np.split(place, ends)]


def _strided(data: np.ndarray, pad: int, width: int) -> np.ndarray:
    """Row i is the `width` bytes from position i on, without a copy; rows that reach over the end see zeros."""
    flat = np.concatenate([data, np.zeros(pad, np.uint8)])
    return np.ndarray((len(flat) - width + 1, width), dtype=np.uint8, buffer=flat.data, strides=(1, 1))


def _rows(data: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Phrases as rows of ROW bytes, padded with zeros."""
    source, out = _strided(data, ROW, ROW), np.empty((len(first), ROW), np.uint8)
    for c in range(0, len(first), CHUNK):
        some = out[c : c + CHUNK]
        some[:] = source[first[c : c + CHUNK]]
        some[np.arange(ROW, dtype=np.int16) >= (count[c : c + CHUNK] + PASSAGE - 1).astype(np.int16)[:, None]] = 0
    return out


def _equal_rows(key: np.ndarray, count: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each distinct phrase, ordered by key; place of every row among them).

    Rows are ordered by a hash, and neighbours of one hash are compared byte by byte. Should two different rows have one
    hash, their bytes order all.
    """
    word = text.view("<u8")
    mark = H.mix(key + H.mix(count.astype(np.uint64) + np.uint64(1)))
    for c in range(word.shape[1]):
        mark = H.mix(mark + word[:, c])
    order = np.argsort(mark)
    mark = mark[order]
    same = mark[1:] == mark[:-1]
    del mark
    near = np.flatnonzero(same)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = (key[a] == key[b]) & (count[a] == count[b])
        for c in range(word.shape[1]):
            out &= word[a, c] == word[b, c]
        return out

    if not alike(order[near], order[near + 1]).all():
        order = np.lexsort((*(word[:, c] for c in range(word.shape[1])), count, key))
        same = alike(order[:-1], order[1:])
    head = np.concatenate([np.ones(min(1, len(order)), bool), ~same])
    one = order[head]
    rank = np.argsort(key[one], kind="stable")
    back = np.empty(len(one), dtype=np.int64)
    back[rank] = np.arange(len(one))
    place = np.empty(len(order), dtype=np.int64)
    place[order] = back[np.cumsum(head) - 1]
    return one[rank], place


def _single(data, first, count, key, hot):
    """Phrases of hot triggers as single windows, with keys of their own, so that no trigger loads one range alone."""
    n = count[hot]
    start = np.repeat(first[hot], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    word = _words(data)
    own = H.mix(np.repeat(key[hot], n))
    for step in (*range(0, PASSAGE - 7, 8), PASSAGE - 8):
        own = H.mix(own + word[start + step])
    first = np.concatenate([first[~hot], start])
    order = np.argsort(first, kind="stable")
    return first[order], np.concatenate([count[~hot], np.ones(len(start), count.dtype)])[order], np.concatenate([key[~hot], own >> KEY_SHIFT])[order]


def _distinct_phrases(data, offsets, ids, marks):
    """Phrases of shared triggers, and their distinct ones ordered by key.

    marks(ascending distinct keys) tells which of them are shared, and which hot. Gives first, count, row, place (of each phrase
    among the distinct), and key, length, smallest id per distinct one; then the bytes of all phrases, and which of these rows
    are the distinct ones: a copy of the rows would be as large again.
    """
    first, count, trigger = phrases(data, offsets)
    key = trigger_keys(data, trigger) >> KEY_SHIFT
    del trigger
    unique, back = np.unique(key, return_inverse=True)
    shared, hot = marks(unique)
    use, hot = shared[back], hot[back]
    del unique, back
    first, count, key, hot = first[use], count[use], key[use], hot[use]
    if hot.any():
        first, count, key = _single(data, first, count, key, hot)
    row = np.searchsorted(offsets, first, side="right") - 1
    text = _rows(data, first, count)
    one, place = _equal_rows(key, count, text)
    least = np.full(len(one), 2**63 - 1, dtype=np.int64)
    np.minimum.at(least, place, ids[row])
    return first, count, row, place, key[one], count[one], least, text, one


def _phrase_message(count: np.ndarray, text: np.ndarray, least: np.ndarray) -> bytes:
    flat = text[np.arange(ROW) < (count + PASSAGE - 1)[:, None]].tobytes()
    return squeeze(count.astype("<u1")) + squeeze(least.astype("<i8")) + zlib.compress(flat, 3)


def _suffix_minima(text: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Smallest of `least` for each window of the dictionary's phrases, windows phrase by phrase.

    The suffix array of the dictionary as far as PASSAGE bytes go: windows are sorted by their bytes, and a run of equal
    neighbours takes the least document of its phrases.
    """
    total = int(count.sum())
    parts = max(1, -(-total // SORTED))
    out = np.empty(total, dtype=least.dtype)
    window = _strided(np.ascontiguousarray(text).ravel(), ROW, PASSAGE)
    phrase = np.repeat(np.arange(len(count), dtype=np.int32), count)
    place = phrase * np.int32(ROW) + (np.arange(total, dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count))
    part = None
    if parts > 1:
        word = _words(np.ascontiguousarray(text).ravel())
        part = np.concatenate([(H.mix(word[p] ^ H.mix(word[p + 24])) % np.uint64(parts)).astype(np.int16) for p in np.split(place, range(SORTED, total, SORTED))])
    for p in range(parts):
        own = np.flatnonzero(part == p) if part is not None else np.arange(total)
        if not len(own):
            continue
        rows = window[place[own]].view(f"V{PASSAGE}").ravel()
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        head = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        own = own[order]
        low = np.minimum.reduceat(least[phrase[own]], head)
        out[own] = np.repeat(low, np.diff(np.append(head, len(own))))
    return out


def _merge_phrases(messages: list[bytes]) -> list[bytes]:
    """For each window of a message's phrases, whether a smaller document than the message's smallest one has it."""
    counts, leasts, texts = [], [], []
    for m in messages:
        count, at = unsqueeze(m, "<u1")
        least, at = unsqueeze(m, "<i8", at)
        count = count.astype(np.int32)
        text = np.zeros((len(count), ROW), np.uint8)
        text[np.arange(ROW) < (count + PASSAGE - 1)[:, None]] = np.frombuffer(zlib.decompress(m[at:]), np.uint8)
        counts.append(count)
        leasts.append(least)
        texts.append(text)
    count, text = np.concatenate(counts), np.concatenate(texts)
    least = np.unique(np.concatenate(leasts), return_inverse=True)[1].astype(np.int32)  # ranks serve as well as ids
    del leasts, texts
    one, place = _equal_rows(np.zeros(len(count), np.uint64), count, text)
    low = np.full(len(one), 2**31 - 1, dtype=np.int32)
    np.minimum.at(low, place, least)
    size = count[one]
    first = _suffix_minima(text[one], size, low)
    head = np.cumsum(size, dtype=np.int64) - size
    out, at = [], 0
    for own in counts:
        mine = slice(at, at + len(own))
        inside = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        out.append(_bits(first[np.repeat(head[place[mine]], own) + inside] < np.repeat(least[mine], own)))
        at += len(own)
    return out


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Marks that cover whole characters: one of which a byte is to stay, stays."""
    if not len(data):
        return gone
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    lead = lead if len(lead) and lead[0] == 0 else np.concatenate([[0], lead])
    return np.repeat(np.minimum.reduceat(gone.astype(np.uint8), lead), np.diff(np.append(lead, len(data)))).astype(bool)


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = False, carry: list[str] | None = None) -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, kept_sha256; with `texts` also text (what is left, as a string).

    Every byte goes that lies in a 50-byte string of the document which also starts in a document with a smaller id; strings
    are judged on the input and never cross documents. With `texts`, a character stays unless all its bytes go, and the
    columns of `carry` come back with their types.
    Defined cases: a null text is empty; a null id counts as the smallest and comes back as null; rows of equal id do not
    count as smaller to each other; texts under 50 bytes stay; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    packed = pack(docs, id_col, text_col, carry=carry)

    def send_triggers(block, ids, offsets, data, deals):
        _, _, trigger = phrases(data, offsets)
        keys, many = _distinct_triggers(trigger_keys(data, trigger) >> KEY_SHIFT, np.searchsorted(offsets, trigger, side="right"))
        for d, (a, b) in enumerate(zip((cut := _cuts(keys, deals)), cut[1:], strict=False)):
            if a < b:
                yield d, squeeze_sorted(keys[a:b]) + _bits(many[a:b])

    seen = exchange(packed, deals_of(packed, 0.4), send_triggers, _merge_triggers, "triggers")
    deals_one = deals_of(packed, 0.4)

    def marks_of(block):
        def marks(keys):
            got, shared, hot = replies(seen, block), [np.zeros(0, bool)], [np.zeros(0, bool)]
            for d, (a, b) in enumerate(zip((cut := _cuts(keys, deals_one)), cut[1:], strict=False)):
                if a < b:
                    shared.append(_flags(got[d], b - a))
                    hot.append(_flags(got[d][(b - a + 7) // 8 :], b - a))
            return np.concatenate(shared), np.concatenate(hot)

        return marks

    def send_phrases(block, ids, offsets, data, deals):
        *_, key, count, least, text, one = _distinct_phrases(data, offsets, ids, marks_of(block))
        del _
        for d, (a, b) in enumerate(zip((cut := _cuts(key, deals)), cut[1:], strict=False)):
            if a < b:
                yield d, _phrase_message(count[a:b], text[one[a:b]], least[a:b])

    deals_two = deals_of(packed, 2.0)
    known = exchange(packed, deals_two, send_phrases, _merge_phrases, "phrases")
    kind = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("text", pa.string())] if texts else []), *([("carry", pa.string())] if carry else [])])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, offsets, data, more in unpack(batch):
                first, count, row, place, key, size, least, text, one = _distinct_phrases(data, offsets, ids, marks_of(block))
                del text, one
                got, flags = replies(known, block), [np.zeros(0, bool)]
                for d, (a, b) in enumerate(zip((cut := _cuts(key, deals_two)), cut[1:], strict=False)):
                    if a < b:
                        flags.append(_flags(got[d], int(size[a:b].sum())))
                flag = np.concatenate(flags)
                del got, flags
                head = np.cumsum(size) - size
                own = ids[row] > least[place]
                del row, least
                edge = np.zeros(len(data) + 1, dtype=np.int8)  # a byte lies in PASSAGE windows at most
                for c in range(0, len(first), CHUNK):  # some phrases at a time: a position each takes eight bytes
                    each = count[c : c + CHUNK]
                    inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
                    gone = flag[np.repeat(head[place[c : c + CHUNK]], each) + inside] | np.repeat(own[c : c + CHUNK], each)
                    start = (np.repeat(first[c : c + CHUNK], each) + inside)[gone]
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + PASSAGE, -1)
                del key, size, flag, head, own, first, count, place
                covered = np.cumsum(edge[:-1], dtype=np.int8) > 0
                sums = np.concatenate([[0], np.cumsum(covered, dtype=np.int32)])
                opens = covered.copy()
                opens[1:] &= ~covered[:-1]
                heads = offsets[:-1][np.diff(offsets) > 0]
                opens[heads] = covered[heads]
                spans = np.concatenate([[0], np.cumsum(opens, dtype=np.int32)])
                removed = (sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64)
                n_spans = (spans[offsets[1:]] - spans[offsets[:-1]]).astype(np.int64)
                del sums, spans, opens, edge
                marks, left = [], []
                for a, b, r in zip(offsets.tolist(), offsets[1:].tolist(), removed.tolist(), strict=False):
                    text, gone = data[a:b], covered[a:b]
                    marks.append(hashlib.sha256(text[~gone] if r else text).hexdigest())
                    if texts:
                        left.append((text[~_whole_characters(text, gone)] if r else text).tobytes().decode())
                columns = [pa.array(ids, mask=ids == -(2**63)), pa.array(np.diff(offsets)), pa.array(removed), pa.array(n_spans), pa.array(marks, pa.string())]
                if texts:
                    columns.append(pa.array(left, pa.string()))
                if carry:
                    columns.append(more)
                yield pa.RecordBatch.from_arrays(columns, schema=kind)
                del columns, left, marks, covered, ids, offsets, data, more
                trim()

    fields = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", text string" if texts else "") + (", carry string" if carry else "")
    out = packed.mapInArrow(cut_out, fields)
    if carry:
        out = out.withColumn("carry", F.from_json("carry", docs.select(*carry).schema)).select(*(c for c in out.columns if c != "carry"), *(F.col(f"carry.{c}").alias(c) for c in carry))
    return out.withColumnRenamed("id", id_col)
