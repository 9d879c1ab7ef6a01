"""Words, word hashes and word n-grams of Arrow string columns, as NumPy arrays.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text.
No Python string is made: the functions work on the column's own buffers, block by
block, so memory is bounded by a block (or by the longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
U64 = np.uint64

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P = 0x9E6C63D0876A9A47
_Q = U64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the output."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, p in enumerate((_P, pow(_P, -1, 2**64))):
            a = np.full(n, p, U64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=U64)
    return _powers[0], _powers[1]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


@dataclass
class Words:
    """Words of a block of texts, in order. doc: row of the block; rows: rows of the column."""

    rows: slice
    n_docs: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text: index of its first word; one entry more than texts


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    if lower:
        data = _LOWER[data]
    sep = _SPACE[data]
    word = ~sep
    begin, last = word.copy(), word.copy()
    begin[1:] &= sep[:-1]
    last[:-1] &= sep[1:]
    edge = off[(off > 0) & (off < n)]
    begin[edge] = word[edge]
    last[edge - 1] = word[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(U64) * _Q)
    first = np.searchsorted(starts, off)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(slice(0, len(off) - 1), len(off) - 1, data, starts, ends, doc, h, first)


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK) -> Iterator[Words]:
    """The words of a column, in blocks of whole texts of about ``limit`` bytes."""
    data, off = utf8(column)
    lo, rows = 0, len(off) - 1
    while lo < rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        out = words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], lower)
        out.rows = slice(lo, hi)
        yield out
        lo = hi


def ngrams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start words and hashes of the n-word sequences inside one text, in order."""
    m = len(w.hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(w.doc[:m] == w.doc[n - 1 :]) if n > 1 else np.arange(m)
    h = w.hash[:m].copy()
    for j in range(1, n):
        h = h * _Q + w.hash[j : j + m]
    return at, mix(h[at] + U64(n))


def shingle_sets(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingle hashes of each text, ascending, and each text's first index.

    A text of 1 to n-1 words has its whole sequence as its one shingle; a text
    without words has none.
    """
    at, h = ngrams(w, n)
    doc = w.doc[at]
    short = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < n))
    if len(short):
        own = np.zeros(len(short), U64)
        size = np.diff(w.first)[short]
        for j in range(n - 1):
            has = size > j
            own[has] = own[has] * _Q + w.hash[w.first[short[has]] + j]
        doc, h = np.concatenate([doc, short]), np.concatenate([h, mix(own + size.astype(U64))])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[keep], h[keep]
    return h, np.searchsorted(doc, np.arange(w.n_docs + 1))
