"""Word and shingle hashes of many texts at once, in numpy over the UTF-8 bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed in one go; a longer text is hashed alone, whole.
CHUNK_BYTES = 1 << 19

_U = np.uint64
_P, _PI = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit numbers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        made = []
        for base in (_P, _PI):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if size > 4 * CHUNK_BYTES:  # not kept: one very long text
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of up to ``most`` bytes. Null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word ``[^\\x20\\x09-\\x0D]+``, and where each text's words begin (one more than texts)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:n]
    last[:-1] &= ~ink[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw] if lower else raw).astype(np.uint64) * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))
    return h, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and where each text's begin.

    A text with fewer than k words, but one at least, has one shingle: its whole sequence.
    """
    count = np.diff(bounds)
    n_sh = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(n_sh)])
    step = [_U(x) for x in np.random.default_rng(k).integers(1, 1 << 63, k, dtype=np.uint64) * _U(2) + _U(1)]
    total = len(h)
    full = np.zeros(max(0, total - k + 1), dtype=np.uint64)
    for i in range(k):
        full += h[i : i + len(full)] * step[i]
    text_of = np.repeat(np.arange(len(n_sh)), n_sh)
    where = np.arange(out_bounds[-1]) - out_bounds[:-1][text_of] + bounds[:-1][text_of]
    out = np.zeros(len(where), dtype=np.uint64)
    whole = count[text_of] >= k
    out[whole] = full[where[whole]]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        x = count[short].astype(np.uint64)
        for i in range(k - 1):
            more = i < count[short]
            x = np.where(more, x * _U(_P) + h[np.where(more, bounds[short] + i, 0)] * step[i], x)
        out[out_bounds[short]] = x
    return mix(out), out_bounds
