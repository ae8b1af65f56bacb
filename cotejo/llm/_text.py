"""Whole texts of an Arrow batch as flat NumPy arrays: bytes, words and hashes.

A *word* is a run of characters other than space and U+0009..U+000D. Those
separators are single ASCII bytes, so words are found on UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of text handled at once in a task, unless one text alone is longer.
CHUNK_BYTES = 2 << 20

IS_SEPARATOR = np.zeros(256, bool)
IS_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.default_rng(20240607)
BYTE_CODES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = int(_rng.integers(2**60, 2**63)) * 2 + 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """BASE (or its inverse modulo 2**64) to the powers 0..n-1, kept for the next call."""
    key = "inverse" if inverse else "plain"
    have = _powers.get(key)
    if have is None or len(have) < n:
        base = pow(BASE, -1, 2**64) if inverse else BASE
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        have = _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: equal inputs, and only they, give equal outputs."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """n+1 prefix sums of codes[i] * BASE**i; ``span_hashes`` reads spans off them."""
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * powers(len(codes)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans [start, end), alike wherever the same codes stand."""
    if len(start) == 0:
        return np.empty(0, np.uint64)
    spans = (prefix[end] - prefix[start]) * powers(len(prefix), inverse=True)[start]
    return mix(spans ^ (U64(0x9E3779B97F4A7C15) * (end - start).astype(np.uint64)))


def sliding_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all len(codes)-width+1 runs of ``width`` codes, by doubling."""
    if len(codes) < width:
        return np.empty(0, np.uint64)
    done, out, power, step = 0, None, BASE, codes
    span = 1
    left = width
    while left:
        if left & 1:
            n = len(codes) - done - span + 1
            part = step[done : done + n]
            out = part.copy() if out is None else out[:n] * U64(power % 2**64) + part
            done += span
        left >>= 1
        if left:
            n = len(step) - span
            step = step[:n] * U64(power % 2**64) + step[span:]
            span *= 2
            power = power * power % 2**64
    return mix(out[: len(codes) - width + 1])


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_ranges(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes of text, or of one longer text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and n+1 offsets of each text's words."""
    if len(data) == 0:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = ~IS_SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(prefix_hashes(BYTE_CODES[data]), starts, ends)


def text_chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of their texts, of bounded size."""
    data, offsets = strings(batch.column(column))
    for lo, hi in row_ranges(offsets, limit):
        yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
