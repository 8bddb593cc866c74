"""NumPy kernels over Arrow text columns, shared by the corpus operators.

Everything here works on a whole batch of texts at once: the UTF-8 bytes of the batch
lie in one buffer, words are byte ranges of it, and a word's hash is the difference of
two running sums (``sum(code[byte] * base**position)`` with wrapping 64-bit arithmetic,
divided by ``base**start``), so no Python loop runs per word.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix64: a bijection that spreads every bit."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64, for i < n."""
    inverse = U64(pow(int(_BASE), -1, 1 << 64))
    up = np.full(n, _BASE, dtype=U64)
    down = np.full(n, inverse, dtype=U64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 16
    while size < n:
        size *= 2
    return _powers(size)


class Words(NamedTuple):
    """Words of a batch: byte range and hash of each, and where each text's words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # len(texts) + 1 offsets into the arrays above


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes that ``words_of`` works on at once: its arrays take some 40 bytes for each.
CHUNK = 4 << 20


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every text, with 64-bit hashes.

    A longer buffer (one very long text) is cut between words, so that it takes a few bytes for each of its bytes.
    """
    if len(data) <= CHUNK:
        return _words(data, offsets, lower)
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + CHUNK)
        while hi < len(data):  # on to the next white space
            blank = np.flatnonzero(_SPACE[data[hi : hi + CHUNK]])
            if len(blank):
                hi += int(blank[0])
                break
            hi = min(len(data), hi + CHUNK)
        inner = offsets[(offsets > lo) & (offsets < hi)] - lo
        w = _words(data[lo:hi], np.r_[0, inner, hi - lo], lower)
        parts.append((w.start + lo, w.end + lo, w.hash))
        lo = hi
    start, end, value = (np.concatenate(c) for c in zip(*parts, strict=True))
    return Words(start, end, value, np.searchsorted(start, offsets))


def _words(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    if lower:
        data = _LOWER[data]
    solid = ~_SPACE[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    cut = offsets[1:-1]
    cut = cut[cut < n]
    opens[cut] = solid[cut]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    cut = cut[cut > 0]
    closes[cut - 1] = solid[cut - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        run = np.zeros(n + 1, dtype=U64)
        np.cumsum(_CODES[data] * up[:n], out=run[1:])
        value = mix((run[end] - run[start]) * down[start] + (end - start).astype(U64))
    return Words(start, end, value, np.searchsorted(start, offsets))


def shingles(value: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive word hashes."""
    n = len(value) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = value[:n].copy()
        for i in range(1, width):
            out = mix(out * U64(0x2545F4914F6CDD1D) + value[i : i + n])
    return out


def whole_sequence(value: np.ndarray) -> np.ndarray:
    """Hash of a text of too few words for one shingle, apart from all shingles' hashes."""
    with np.errstate(over="ignore"):
        out = np.array([0xA5A5A5A5A5A5A5A5 + len(value)], dtype=U64)
        for x in value:
            out = mix(out * U64(0x2545F4914F6CDD1D) + x)
    return out


def shingle_set(value: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; the whole sequence as one when it is shorter; empty without words."""
    if len(value) == 0:
        return np.zeros(0, U64)
    return np.unique(shingles(value, width)) if len(value) >= width else whole_sequence(value)
