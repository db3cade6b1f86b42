"""Vectorised word splitting and hashing over Arrow string columns.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` of one document.
All work is done on the UTF-8 buffer of a batch with numpy, in pieces of bounded
size, so that one very long text or word does not raise the peak memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
#: Words longer than this are hashed by BLAKE2b; a polynomial modulo 2**64 is weak on long input.
LONG = 256

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = [mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(s)) for s in _ODD]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(seed: int) -> tuple[np.ndarray, np.ndarray]:
    if seed not in _POWERS:
        r = _ODD[seed]
        up = np.full(PIECE + 1, r, np.uint64)
        down = np.full(PIECE + 1, pow(r, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[seed] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _POWERS[seed]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset:]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes each, or one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word."""
    word = ~_SPACE[buf]
    n = len(buf)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    finish = word.copy()
    finish[:-1] &= ~word[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; equal words, equal hashes."""
    up, down = _powers(seed)
    out = np.empty(len(starts), np.uint64)
    length = (ends - starts).astype(np.uint64)
    k = 0
    while k < len(starts):
        base = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, base + PIECE, "right")))
        if ends[stop - 1] - base > PIECE:  # one word longer than a piece: hashed below
            k = stop
            continue
        b = buf[base:ends[stop - 1]]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTES[seed][b] * up[:len(b)], out=sums[1:])
        s, e = starts[k:stop] - base, ends[k:stop] - base
        out[k:stop] = (sums[e] - sums[s]) * down[s]
        k = stop
    out = mix(out + length * np.uint64(_ODD[1 - seed]))
    for k in np.flatnonzero(length > LONG):
        digest = hashlib.blake2b(buf[starts[k]:ends[k]].tobytes(), digest_size=8, salt=bytes([seed])).digest()
        out[k] = np.frombuffer(digest, np.uint64)[0]
    return out


def windows(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of ``size`` consecutive words from each position that has so many after it."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(_ODD[seed])
    h = words[:n].copy()
    for k in range(1, size):
        h = h * factor + words[k:k + n]
    return mix(h + np.uint64(size))


def lowered(buf: np.ndarray) -> np.ndarray:
    """The same bytes with A-Z in lower case."""
    return _LOWER[buf]
