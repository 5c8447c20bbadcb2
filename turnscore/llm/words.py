"""Words of whole text batches, found and fingerprinted on the UTF-8 bytes.

A batch is a string array of Arrow; all work is numpy over its bytes, with no
Python loop over rows or words. Null texts count as empty. Bytes from 0x80 on
are word bytes under both definitions, so a multi-byte character never splits.

A word's fingerprint is 64 bits (or two of them, 128 bits, where a result
rests on equality alone): a polynomial over its bytes from prefix sums modulo
2**64, then a bit mixer."""

from __future__ import annotations

import ctypes
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library: freed memory stays with the process
    _LIBC = None


def release() -> None:
    """Hands freed memory back to the system. Python workers are reused and the
    C library keeps what numpy frees, so without this each idle worker would
    hold the peak of its last task."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def lean(run):
    """A function over batches that releases memory when its partition ends."""

    def leaned(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return leaned


def lean2(f):
    """Likewise for a function of a group's key and rows."""

    def leaned(key, rows):
        try:
            return f(key, rows)
        finally:
            release()

    return leaned


def lean3(f):
    """Likewise for a function of a key and two groups of rows."""

    def leaned(key, rows, more):
        try:
            return f(key, rows, more)
        finally:
            release()

    return leaned

BASES = (U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F))
WINDOW_BASES = (U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F))

#: Bytes that end a word: blanks for ``[^\x20\x09-\x0D]+``.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: For ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` over lower-cased text.
NON_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (cached, grown by doubling)."""
    key = int(base)
    if key not in _POWERS or len(_POWERS[key][0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = U64(pow(key, -1, 1 << 64))
        out = []
        for b in (base, inverse):
            p = np.full(size, b, U64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS[key] = (out[0], out[1])
    p, q = _POWERS[key]
    return p[:n], q[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 output bits (a bijection)."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words in text order. ``bounds[r]:bounds[r+1]`` are those of row r;
    ``starts``/``ends`` are byte offsets into ``data``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: tuple[np.ndarray, ...]

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def split(texts, separators: bytes = SPACES, lower: bool = False, n_hashes: int = 1) -> Words:
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    mask = np.zeros(len(data) + 2, bool)
    mask[1:-1] = inside[data]
    begin, end = mask[1:-1] & ~mask[:-2], mask[1:-1] & ~mask[2:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut):  # a word never runs on into the next row
        begin[cut] = mask[1:-1][cut]
        end[cut - 1] = mask[1:-1][cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(starts, offsets)
    hashes = tuple(span_hash(data, starts, ends, b) for b in BASES[:n_hashes])
    return Words(data, starts, ends, bounds, hashes)


#: Bytes or words whose prefix sums are taken at a time: few enough that they stay in a core's cache.
STRETCH = 1 << 15


def _stretches(starts: np.ndarray, ends: np.ndarray):
    """Ranges of consecutive spans that begin within ``STRETCH`` of one another."""
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(starts, starts[i] + STRETCH, side="left"))
        yield i, max(j, i + 1)
        i = max(j, i + 1)


def _span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64, shift: int) -> np.ndarray:
    out = np.empty(len(starts), U64)
    for i, j in _stretches(starts, ends):
        first, last = int(starts[i]), int(ends[i:j].max())
        part = values[first:last].astype(U64)
        if shift:
            part += U64(shift)
        p, q = powers(base, len(part) + 1)
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(part * p[:-1], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * q[a]
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Fingerprint of each span of bytes (spans in order of their starts)."""
    return mix(_span_sums(data, starts, ends, base, 1) + (ends - starts).astype(U64))


def window_hash(hashes: np.ndarray, starts: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Fingerprint of the ``size`` values from each of ``starts`` (in order) on."""
    return mix(_span_sums(hashes, starts, starts + size, base, 0))


def chunks(table: pa.Table | pa.RecordBatch, column: str, most: int = 4 << 20):
    """Slices of consecutive rows with about ``most`` bytes of text (one row at least)."""
    _, offsets = utf8(table[column] if isinstance(table, pa.Table) else table.column(column))
    at, n = 0, table.num_rows
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield table.slice(at, to - at)
        at = to


def sorted_unique(values: np.ndarray) -> np.ndarray:
    """Distinct values in order, by a sort."""
    v = np.sort(values)
    return v[np.flatnonzero(np.r_[True, v[1:] != v[:-1]])] if len(v) else v


def word_text(w: Words, i: int) -> str:
    return w.data[w.starts[i] : w.ends[i]].tobytes().decode("utf-8", "replace")
