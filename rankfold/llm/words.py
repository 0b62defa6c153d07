"""Words and word n-grams of whole Arrow text columns as NumPy arrays.

A word is a run of bytes other than the six ASCII white-space characters, which is the
same as ``[^\\x20\\x09-\\x0D]+`` on the text, as no byte of a longer UTF-8 sequence is ASCII.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.RandomState(11).randint(1, 1 << 62, 256).astype(np.uint64)
_powers = {_BASE: np.ones(1, dtype=np.uint64), _BASE_INVERSE: np.ones(1, dtype=np.uint64)}


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer."""
    h = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power(base: int, length: int) -> np.ndarray:
    """base**0 .. base**(length - 1) modulo 2**64."""
    known = _powers[base]
    if len(known) < length:
        factors = np.full(max(length, 2 * SLICE_BYTES), base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return known[:length]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes of text, at least one row each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    piece = np.cumsum(sizes) // limit
    edges = np.flatnonzero(np.diff(piece)) + 1
    for start, end in zip([0, *edges], [*edges, batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


class Words(NamedTuple):
    """Words of one slice: byte ranges, first word of each document, 64-bit hashes."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray


def split_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; nulls have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    space = _SPACE[raw]
    cut = np.ones(len(raw) + 1, dtype=bool)
    cut[1:-1] = space[:-1] | space[1:]
    cut[offsets] = True
    start = np.flatnonzero(cut[:-1] & ~space)
    end = np.flatnonzero(cut[1:] & ~space) + 1
    data = _LOWER[raw] if lower else raw
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _power(_BASE, len(raw)), out=sums[1:])
    spread = (sums[end] - sums[start]) * _power(_BASE_INVERSE, len(raw) + 1)[start]
    return Words(data, start, end, np.searchsorted(start, offsets), mix(spread, 1) + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, whatever document they belong to."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(count, dtype=np.uint64)
    for j in range(length):
        h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[j : j + count]
    return mix(h, length)
