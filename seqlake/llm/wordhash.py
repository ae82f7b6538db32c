"""Vectorised word and word n-gram hashing straight on Arrow string buffers.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Both rules touch ASCII
bytes only, so they hold on UTF-8 bytes as they stand and no text is decoded.
A batch is cut into runs of whole documents of about ``RUN_BYTES`` bytes (a
longer document is a run of its own), which bounds the scratch arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

RUN_BYTES = 255 << 10
LONG = 64
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []  # the largest tables so far, at most 16 bytes for each of 2 * RUN_BYTES; they stay in the worker


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (splitmix64)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _power_tables(n: int) -> "list[np.ndarray]":
    size = 1 << max(16, (n + 1).bit_length())
    if _powers and size <= len(_powers[0]):
        return _powers
    made = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE)]
    if size <= 2 * RUN_BYTES:  # else a single huge document: not kept
        _powers[:] = made
    return made


def runs(column) -> "list[tuple[int, int, np.ndarray, np.ndarray]]":
    """Yield ``(first row, last row + 1, bytes, row offsets)`` over whole texts; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + RUN_BYTES, side="right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(word hashes, first word of each row, word starts, word ends)`` of one run."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), z, z
    low = _LOWER[data] if lower else data
    word = ~_WS[data]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True  # a row's first byte never continues the row before
    starts = np.flatnonzero(word & (first[:n] | np.concatenate(([True], ~word[:-1]))))
    ends = np.flatnonzero(word & (first[1:] | np.concatenate((~word[1:], [True])))) + 1
    return span_hashes(low, starts, ends), np.searchsorted(starts, offsets), starts, ends


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span (equal spans, equal hashes).

    Spans up to ``LONG`` bytes get a polynomial modulo 2^64; there, different long spans of a
    regular build meet (a Thue-Morse word and its complement from 1,024 bytes on), so longer ones get blake2b.
    """
    n = len(data)
    power, inverse = _power_tables(n)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    h = mix((total[ends] - total[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def shingles(h: np.ndarray, bounds: np.ndarray, k: int = 5) -> "list[np.ndarray]":
    """Yield each row's sorted distinct k-word shingle hashes; under k words the whole sequence is one."""
    mult = [np.uint64(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    if len(h) >= k:
        acc = np.zeros(len(h) - k + 1, dtype=np.uint64)
        for j in range(k):
            acc += h[j:len(h) - k + 1 + j] * mult[j]
        full = mix(acc + np.uint64(k))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        m = b - a
        if m >= k:
            yield np.unique(full[a:b - k + 1])
        elif m:
            acc = np.zeros(1, dtype=np.uint64)
            for j in range(m):
                acc += h[a + j:a + j + 1] * mult[j]
            yield mix(acc + np.uint64(m))
        else:
            yield np.zeros(0, dtype=np.uint64)
