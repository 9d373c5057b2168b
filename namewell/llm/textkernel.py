"""Vectorised word kernel shared by the text operators.

An Arrow string array is one byte buffer plus offsets.  Words are found and hashed over that
buffer with numpy alone, so a batch costs a handful of array passes and no Python object per
word.  A word is a maximal run of ASCII letters, ASCII digits and non-ASCII bytes, compared
in lower case; its hash is a polynomial over its bytes modulo 2**64 (taken out of prefix sums,
the base being odd and so invertible) sent through a bit mixer.

Null texts count as empty ones: no word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_WORD = np.zeros(256, np.bool_)
_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _WORD[_c] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.cumprod(t, dtype=np.uint64))
        _powers[size] = (tables[0], tables[1])
    return _powers[size]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective bit mixer over uint64 (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


@dataclass
class Words:
    """Words of a batch of texts: hash, byte span in ``data``, and the words of text i at bounds[i]:bounds[i+1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts)


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array, nulls as empty texts, offsets from 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_of(texts: pa.Array) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    data, offsets = text_buffers(pc.utf8_lower(texts))
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    inside = _WORD[data]
    before = np.empty(n, np.bool_)
    before[0] = False
    before[1:] = inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after = np.empty(n, np.bool_)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(n)
    prefix = np.empty(n + 1, np.uint64)
    prefix[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = mix64((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))
    return Words(data, offsets, start, end, h, np.searchsorted(start, offsets))


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word shingles and their bounds by text; a text of fewer words has one of all its words, one without words none."""
    counts = w.counts
    h, n = w.hash, len(w.hash)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(w.bounds), np.int64)
    doc = w.doc_of_word()
    place = np.arange(n) - w.bounds[doc]
    short = counts < size
    out = mix64(h + np.uint64(1))
    for j in range(1, size):
        there = place + j < counts[doc]
        step = np.empty_like(out)
        step[: n - j] = h[j:]
        step[n - j :] = 0
        out = np.where(there, mix64(out * np.uint64(0x100000001B3) + step), out)
    keep = (place + size <= counts[doc]) | (short[doc] & (place == 0))
    return out[keep], np.concatenate([[0], np.cumsum(np.where(short, np.minimum(counts, 1), counts - size + 1))])


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text each, never splitting a row."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // limit
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1), len(lengths)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def reduce_add(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]] along the first axis, 0 for empty spans."""
    out = np.zeros((len(bounds) - 1, *values.shape[1:]), values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.diff(bounds) > 0
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full], axis=0, dtype=out.dtype)
    return out
