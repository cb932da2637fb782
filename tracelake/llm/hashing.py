"""Vectorised hashes of byte spans, the same on every machine and for every batch layout.

A span's hash is its polynomial over 64-bit words with an odd base, from prefix sums times inverse powers, mixed with the
span's length. All arithmetic wraps at 2**64.
"""

from __future__ import annotations

import numpy as np

from tracelake.llm.common import SPACES, row_slices

U = np.uint64
BASE = 0x9E3779B97F4A7C55
#: Table of the bytes that part words, and of lower case for A to Z alone.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _table(base: int, n: int, key: str) -> np.ndarray:
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.ones(size, dtype=U)
        done, step = 1, U(base)
        while done < size:  # doubling: powers of the second half are those of the first times base ** done
            have[done : 2 * done] = have[:done] * step
            done, step = 2 * done, step * step
        _powers[key] = have
    return have[:n]


def powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _table(BASE, n, "up")


def inverses(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _table(pow(BASE, -1, 1 << 64), n, "down")


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power; n + 1 values."""
    out = np.empty(len(data) + 1, dtype=U)
    out[0] = 0
    np.cumsum(data * powers(len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span [start, end) of the bytes that `sums` was made of."""
    length = (ends - starts).astype(U)
    return mix((sums[ends] - sums[starts]) * inverses(len(sums))[starts] + length * U(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are no whitespace."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.empty(len(data) + 2, dtype=bool)
    space[0] = space[-1] = True
    np.take(IS_SPACE, data, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[0::2], edge[1::2]


def joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with one blank after each, so that no word runs over a row's end; and each row's start."""
    n = len(offsets) - 1
    starts = offsets[:-1] + np.arange(n)
    out = np.full(len(data) + n, 0x20, dtype=np.uint8)
    if len(data):
        row = np.repeat(np.arange(n), np.diff(offsets))
        out[np.arange(len(data)) + row] = data
    return out, starts


#: Bytes that are hashed at once; rows stay whole.
SLICE = 1 << 19


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all rows in order, index of the first word of each row with the total at the end)."""
    hashes, heads, n = [], [], 0
    for i, j in row_slices(offsets, SLICE):
        text, starts = joined(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if lower:
            text = LOWER[text]
        first, last = word_spans(text)
        hashes.append(span_hashes(prefix(text), first, last))
        heads.append(np.searchsorted(first, starts) + n)
        n += len(first)
    if not hashes:
        return np.zeros(0, U), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.append(np.concatenate(heads), n)
