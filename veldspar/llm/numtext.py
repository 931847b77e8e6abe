"""Vectorised word and shingle hashes of Arrow string columns, for operators that run in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_STEP = U(0xD6E8FEB86659FD93)
#: Bytes of text hashed at a time, and the longest word that is hashed by the vectorised path.
_SPAN, _LONG = 1 << 19, 1 << 12
#: Bytes and rows taken from a batch at a time; a longer single text is taken alone.
_BLOCK, _ROWS = 2 << 20, 4096

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_powers: list[np.ndarray] = []


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = (h ^ (h >> U(32))) * _STEP
    h = (h ^ (h >> U(32))) * _STEP
    return h ^ (h >> U(32))


def _tables() -> list[np.ndarray]:
    if not _powers:
        n = _SPAN + _LONG + 8
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, U)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def blocks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, about _BLOCK bytes each; null counts as empty."""
    a = pa.compute.fill_null(column, "") if column.null_count else column
    if not len(a):
        return
    wide = pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type)
    off = np.frombuffer(a.buffers()[1], np.int64 if wide else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(a):
        end = min(max(row + 1, int(np.searchsorted(off, off[row] + _BLOCK, "right")) - 1), row + _ROWS)
        yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the A-Z-lower-cased words of all rows, and where each row's words begin (one more than rows)."""
    if not len(data):
        return np.zeros(0, U), np.zeros(len(off), np.int64)
    word = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    starts = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    power, inverse = _tables()
    out = np.empty(len(starts), U)
    i = 0
    while i < len(starts):
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _SPAN, "right")))
        if ends[j - 1] - base > _SPAN:  # one word longer than a span
            out[i] = U(xxhash.xxh64_intdigest(_LOWER[data[base : ends[i]]].tobytes()))
            i = j
            continue
        seen = np.zeros(ends[j - 1] - base + 1, U)
        np.cumsum((_LOWER[data[base : ends[j - 1]]].astype(U) + U(1)) * power[: len(seen) - 1], out=seen[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((seen[e] - seen[s]) * inverse[s] + (e - s).astype(U))
        i = j
    return out, np.searchsorted(starts, off)


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(h) - k + 1
    out = np.zeros(max(n, 0), U)
    for j in range(k if n > 0 else 0):
        out = mix(out * U(_BASE) + h[j : j + n])
    return out


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ascending distinct hashes of its k-word shingles); with fewer words the whole sequence is one shingle."""
    for first, data, off in blocks(column):
        h, at = word_hashes(data, off)
        chain = chained(h, k)
        for r in range(len(off) - 1):
            a, b = at[r], at[r + 1]
            if b - a >= k:
                yield first + r, np.unique(chain[a : b - k + 1])
            else:
                yield first + r, mix(chained(h[a:b], int(b - a)) + U(b - a)) if b > a else np.zeros(0, U)
