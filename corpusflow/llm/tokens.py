"""Words, hashes and windows of whole texts as numpy arrays, straight from Arrow buffers.

A batch's texts are one byte array and row offsets. It is cut into spans of whole texts of about
``SPAN_BYTES`` (a longer text makes a span of its own), so memory per task is bounded by the span or
the longest text, whichever is larger. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN_BYTES = 1 << 18

U64 = np.uint64
_RNG = np.random.default_rng(20_240_229)
#: Random 64-bit value of each byte, and the odd base of the rolling hash with its inverse.
BYTE_VALUE = _RNG.integers(1 << 40, (1 << 63) - 1, 256).astype(U64) | U64(1)
_BASE = int(_RNG.integers(1 << 40, (1 << 63) - 1)) | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def _power(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n, kept and doubled as needed."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, U64)
        have[0] = 1
        k = 1
        while k < size:
            m = min(k, size - k)
            have[k : k + m] = have[:m] * U64(pow(base, k, 1 << 64))
            k += m
        _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the row offsets into them (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()), b"")
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1 + column.offset)[column.offset :].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray, limit: int = SPAN_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Running sums from which the hash of any byte range follows (see range_hash)."""
    out = np.empty(len(data) + 1, U64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[data] * _power(_BASE, len(data)), out=out[1:])
    return out


def value_prefix(values: np.ndarray) -> np.ndarray:
    """As prefix_hash, for a sequence of 64-bit values."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * _power(_BASE, len(values)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [start, end), the same wherever they stand."""
    inverse = _power(_INVERSE, len(prefix))
    return mix64((prefix[end] - prefix[start]) * inverse[start])


def word_bounds(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words never cross rows."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~breaks[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def shingle_hashes(word: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every k consecutive words of a row, and the place of its first word."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h = np.zeros(len(at), U64)
    for j in range(k):
        h = h * U64(0x9E3779B97F4A7C15) + word[at + j]
    return mix64(h), at


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (by doubling)."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def text_batches(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    """Every batch's spans: (batch, first row, row after the last, bytes, offsets)."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for lo, hi, d, o in spans(data, offsets):
            yield batch, lo, hi, d, o
