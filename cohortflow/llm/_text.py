"""Vectorised text helpers for Arrow batches: words, hashes and windows over whole texts.

A word is a maximal run of bytes other than the ASCII white space 0x20 and
0x09-0x0D.  Helpers work on the UTF-8 buffer of a whole Arrow column at once, so
that no Python loop runs over words.  Hashes are 64 bit and depend only on the
bytes, never on the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_WS = np.zeros(256, dtype=bool)
_WS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 20
SLICE = 2 << 20  # bytes of text that the vectorised helpers work on at a time (one row may be larger)
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (the SplitMix64 finaliser)."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE)) | U64(1)


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    up = np.ones(1, dtype=U64)
    down = np.ones(1, dtype=U64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 1 << 16)
            cls.up = np.cumprod(np.concatenate([[U64(1)], np.full(size, U64(_BASE), dtype=U64)]))
            inv = U64(pow(_BASE, -1, 1 << 64))
            cls.down = np.cumprod(np.concatenate([[U64(1)], np.full(size, inv, dtype=U64)]))
        return cls.up, cls.down


def column_buffers(arr: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null counts as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_string()).fill_null("")
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset: arr.offset + len(arr) + 1]
    if len(offs) == 0:
        offs = np.zeros(1, dtype=np.int64)
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0]: offs[-1]], offs - offs[0]


def row_slices(offs: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each (one row may be larger), covering all rows."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi
        lo = hi


def text_slices(batches, text: str = "text", limit: int = SLICE):
    """For every slice of rows of every batch: (the rows as a RecordBatch, bytes, offsets)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        data, offs = column_buffers(batch.column(batch.schema.get_field_index(text)))
        for lo, hi in row_slices(offs, limit):
            yield batch.slice(lo, hi - lo), data[offs[lo]: offs[hi]], offs[lo: hi + 1] - offs[lo]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte unchanged."""
    return _LOWER[data]


def _is_start(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offs] = True
    return edge


def spans(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = _WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words, and the word bounds of each row (length rows + 1)."""
    if len(data) == 0:
        z = np.zeros(0, dtype=np.int64)
        return z, z, np.zeros(len(offs), dtype=np.int64)
    ink = ~sep[data]
    edge = _is_start(data, offs)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; spans are sorted and do not overlap.  Works in pieces of about 1 MB."""
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, side="right")))
        stop = int(ends[hi - 1])
        up, down = _Powers.get(stop - base + 1)
        total = np.zeros(stop - base + 1, dtype=U64)
        np.cumsum(_BYTE[data[base:stop]] * up[: stop - base], out=total[1:])
        s, e = starts[lo:hi] - base, ends[lo:hi] - base
        out[lo:hi] = mix((total[e] - total[s]) * down[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, byte starts, byte ends, word bounds of each row)."""
    starts, ends, bounds = spans(data, offs)
    return span_hashes(data, starts, ends), starts, ends, bounds


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive entries (order matters); empty if there are fewer."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    acc = np.zeros(m, dtype=U64)
    for k in range(n):
        acc = acc * U64(0xD1342543DE82EF95) + hashes[k: k + m] + U64(k + 1)
    return mix(acc)


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as int64 (Spark LONG)."""
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


def list_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A list column whose row k is values[bounds[k]:bounds[k + 1]]."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(bounds, dtype=np.int32)), pa.array(values))


def code_points(data: np.ndarray) -> np.ndarray:
    """Number of code points before each byte (length bytes + 1)."""
    out = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
