"""Vectorised words, word hashes and shingles over the UTF-8 buffer of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once, about 50 MB of working memory; a longer text is handled alone.
CHUNK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_R = 0x9E3779B97F4A7C15
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** i for i < n, modulo 2 ** 64; kept for the next call."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        step = np.full(max(n, CHUNK + 1), base, np.uint64)
        step[0] = 1
        have = _powers[key] = np.cumprod(step, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, first and end byte of each word, and each row's offsets into the words."""
    low = _LOWER[data]
    n = len(low)
    if not n:
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    text = np.empty(n + 1, bool)
    text[:n] = ~_SPACE[low]
    text[n] = False
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = text[:n]
    starts = np.flatnonzero(text & (~before | edge))
    ends = np.flatnonzero(before & (~text | edge))
    return low, starts, ends, np.searchsorted(starts, offsets)


def hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random byte values, mixed with the length."""
    n = len(low)
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[low] * _power(_R, n), dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * _power(_R_INV, n)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_COEF = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(h: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each row's runs of `size` words; a shorter row has one run, an empty row none."""
    n = len(h)
    runs = np.zeros(max(0, n - size + 1), np.uint64)
    for k in range(size):
        runs += h[k : n - size + 1 + k] * _COEF[k]
    runs = mix(runs)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            x = np.sort(runs[a : b - size + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif b > a:
            whole = (h[a:b] * _COEF[: b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(whole + np.full(1, b - a, np.uint64) * _COEF[63:]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def rows_with(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
