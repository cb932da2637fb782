"""Encoding whole texts with the tokenizers library, each distinct word once.

A space between two characters that are no whitespace always starts a new piece, for byte-level pre-tokenizers as for the
metaspace marker, and so does a line break between two such characters. So the ids of a text are those of its words one
after the other, and a worker only asks the library for words that it has not met. Texts where that does not hold (runs of
whitespace, whitespace at an end, strings of added tokens) are encoded as they are.

Texts are split and their words numbered by Arrow, ids are gathered by NumPy: Python looks at distinct words only.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of words and ids that a worker remembers, about, before it starts anew.
REMEMBERED_BYTES = 128 << 20
#: What an entry of the memory takes beside its word and ids: string, dictionary and list entries, two numbers.
ENTRY = 200
TOGETHER = 500
#: Bits by which a word's first sight is noted; a word is remembered from its second on.
SIGHTS = 1 << 22
MISS = 1 << 60

_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What make() gives, once per Python worker: workers are used again for later tasks."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def gather(ids: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """ids[start : start + size] of all rows, one after the other."""
    ends = np.cumsum(size)
    at = np.repeat(start - (ends - size), size)
    at += np.arange(len(at))
    return ids[at]


class WordEncoder:
    """encode(texts) gives, for each text, its ids as little-endian bytes of `kind`.

    model: the library's tokenizer for strings as they are; space: what stands for a leading blank in its input; starts:
    for each id, whether its token starts with that blank; newline: the ids of a lone line break; prefix: whether a text
    starts with the blank; by_word: False if words may not be taken alone; added: strings that the model takes whole.
    """

    def __init__(self, model, space: str, starts: np.ndarray, kind: str, prefix: bool, threads: int = 1, by_word: bool = True, added: tuple[str, ...] = (), remembered: int = REMEMBERED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.model, self.space, self.starts, self.kind, self.prefix, self.by_word, self.added = model, space, starts, kind, prefix, by_word, added
        self.remembered = remembered
        self.newline = np.frombuffer(self._direct(["\n"])[0], kind)
        self._forget()

    def _forget(self) -> None:
        """Per way (0: after a blank, 1: at the start of a line) the remembered words' places in `known`."""
        self.place: tuple[dict[str, int], dict[str, int]] = ({}, {})
        self.sizes: list[int] = []
        self.parts: list[bytes] = []
        self.held = 0
        self.sights, self.noted = bytearray(SIGHTS), 0

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype=self.kind).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _after(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each word's) of words that follow a blank: many of them in one string, cut where
        tokens start with the blank."""
        lots = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        flat, sizes = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]
        for lot, e in zip(lots, self.model.encode_batch_fast([self.space + self.space.join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.kind)
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) == len(lot):
                flat.append(ids)
                sizes.append(np.diff(np.append(cut, len(ids))))
            else:  # a token that starts with a blank inside a word: then one by one
                one = [np.frombuffer(c, self.kind) for c in self._direct([self.space + w for w in lot])]
                flat += one
                sizes.append(np.array([len(c) for c in one], dtype=np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _places(self, words: list[str], way: int, passing: tuple[list[int], list[bytes]]) -> np.ndarray:
        """Place of each distinct word: among the remembered ones, or, as -1 - place, among those of this call (`passing`: sizes
        and ids). Words that are not to be taken alone have a negative size."""
        have, get = self.place[way], self.place[way].get
        place = np.fromiter((get(w, MISS) for w in words), np.int64, len(words))
        at = np.flatnonzero(place == MISS)
        if not len(at):
            return place
        new = [words[i] for i in at.tolist()]
        odd = np.fromiter((not w or w.strip() != w or (self.space != " " and self.space in w) for w in new), bool, len(new))
        plain = [w for w, o in zip(new, odd.tolist(), strict=True) if not o] if odd.any() else new
        if way:
            codes = self._direct(plain)
            ids, sizes = np.frombuffer(b"".join(codes), self.kind), np.array([len(c) // int(self.kind[-1]) for c in codes], dtype=np.int64)
        else:
            ids, sizes = self._after(plain)
        size = np.full(len(new), -1, dtype=np.int64)
        size[~odd] = sizes
        start = np.zeros(len(new), dtype=np.int64)
        start[~odd] = np.cumsum(sizes) - sizes
        mask, sights = SIGHTS - 1, self.sights
        marks = [hash(w) & mask for w in new]
        again = np.fromiter((sights[m] for m in marks), bool, len(new))
        for m in marks:
            sights[m] = 1
        self.noted += len(new)
        if self.noted > SIGHTS // 4:
            self.sights, self.noted = bytearray(SIGHTS), 0
        kept_, rest = np.flatnonzero(again), np.flatnonzero(~again)
        have.update(zip([new[i] for i in kept_.tolist()], range(len(self.sizes), len(self.sizes) + len(kept_)), strict=True))
        place[at[kept_]] = np.arange(len(self.sizes), len(self.sizes) + len(kept_))
        self.held += sum(len(new[i]) for i in kept_.tolist()) + int(np.abs(size[kept_]).sum()) * ids.itemsize + ENTRY * len(kept_)
        place[at[rest]] = -1 - np.arange(len(passing[0]), len(passing[0]) + len(rest))
        for own, sizes_, parts in ((kept_, self.sizes, self.parts), (rest, *passing)):
            n = np.maximum(size[own], 0)
            sizes_ += size[own].tolist()
            parts.append(gather(ids, start[own], n).tobytes())
        return place

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if not self.by_word:
            return self._direct([self.whole(t) for t in column.to_pylist()])
        lines = pc.split_pattern(column, "\n")
        words = pc.split_pattern(lines.values, " ")
        # the first word of a line has no blank before it, but for a text's first one where the model puts one there
        line_at, text_at = words.offsets.to_numpy(), lines.offsets.to_numpy()
        way = np.zeros(line_at[-1], dtype=np.int8)
        way[line_at[:-1]] = 1
        opens = np.zeros(len(way), dtype=bool)
        opens[line_at[:-1]] = True
        opens[line_at[text_at[:-1]]] = False
        if self.prefix:
            way[line_at[text_at[:-1]]] = 0
        coded = words.values.dictionary_encode()
        number, distinct = coded.indices.to_numpy(), coded.dictionary
        place, passing = np.empty(len(way), dtype=np.int64), ([], [])
        for w in (0, 1):
            mine = np.flatnonzero(way == w)
            used, inverse = np.unique(number[mine], return_inverse=True)
            place[mine] = self._places(distinct.take(pa.array(used)).to_numpy(zero_copy_only=False).tolist(), w, passing)[inverse]
        self.parts = [b"".join(self.parts)]
        known = np.frombuffer(b"".join((*self.parts, *passing[1])), self.kind)
        sizes = np.array(self.sizes + passing[0], dtype=np.int64)
        starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
        place = np.where(place < 0, len(self.sizes) - 1 - place, place)
        size, start = sizes[place], starts[place]
        breaks = np.where(opens, len(self.newline), 0)
        first = line_at[text_at]  # first word of each text
        odd = np.add.reduceat(np.append(size < 0, False), first)[:-1] > 0 if len(column) else np.zeros(0, bool)
        for string in self.added:
            odd |= pc.match_substring(column, string).to_numpy(zero_copy_only=False)
        # line breaks stand before their line's first word
        both = np.column_stack([breaks, np.maximum(size, 0)]).ravel()
        ids = gather(np.concatenate([self.newline, known]), np.column_stack([np.zeros(len(size), np.int64), start + len(self.newline)]).ravel(), both)
        ends = np.concatenate([[0], np.cumsum(both)])[2 * first] * ids.itemsize
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
        if odd.any():
            which = np.flatnonzero(odd)
            for i, code in zip(which.tolist(), self._direct([self.whole(column[i].as_py()) for i in which.tolist()]), strict=True):
                out[i] = code
        if self.held > self.remembered:
            self._forget()
        return out

    def whole(self, text: str) -> str:
        if self.space == " ":
            return text
        return (self.space if self.prefix and text else "") + text.replace(" ", self.space)


def byte_level(path: str, threads: int = 1, special_as_text: bool = True) -> WordEncoder:
    """Encoder of a tokenizer file of the library; one per worker.

    With special_as_text, strings of special tokens in a text are ordinary text, so no document can forge a token; without,
    they become the special ids. Words are taken alone only where the file says byte-level pieces cut at blanks, with
    no normaliser; other files encode whole texts.
    """

    def make() -> WordEncoder:
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.encode_special_tokens = special_as_text
        size = model.get_vocab_size()
        starts = np.zeros(size, dtype=bool)
        starts[[i for token, i in model.get_vocab().items() if token.startswith("Ġ")]] = True
        with open(path, encoding="utf-8") as src:
            said = json.load(src)
        cut = said.get("pre_tokenizer") or {}
        by_word = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and said.get("normalizer") is None
        added = tuple(t.content for t in model.get_added_tokens_decoder().values() if not (special_as_text and t.special))
        return WordEncoder(model, " ", starts, "<u2" if size <= 1 << 16 else "<u4", prefix=False, threads=threads, by_word=by_word, added=added)

    return kept(("byte level", path, threads, special_as_text), make)
