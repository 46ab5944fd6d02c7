"""Vectorised splitting and hashing of the words of Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text.
Texts are worked on in groups of about SLICE bytes, so memory doesn't follow the batch;
a single longer text forms a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE = 1 << 21
#: Longer words are hashed one by one.
LONG = 64
ODD = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and bytes of a string column, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return offsets.astype(np.int64), data


def groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) of runs of rows of about SLICE bytes."""
    if not len(column):
        return
    offsets, data = buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def spans(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of its first word (one more at the end)."""
    solid = ~_SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    opens = np.empty(len(data), dtype=bool)
    opens[0] = True
    np.logical_not(solid[:-1], out=opens[1:])
    opens[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(solid & opens)
    closes = np.empty(len(data), dtype=bool)
    closes[-1] = True
    np.logical_not(solid[1:], out=closes[:-1])
    inner = offsets[1:]
    closes[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(solid & closes) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def _lane(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes at each place, those beyond `left` (1 at least) as zeros."""
    unused = (np.uint64(64) - np.uint64(8) * np.minimum(left, 8).astype(np.uint64)).astype(np.uint64)
    return (lanes[at] << unused) >> unused


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands; seeds give independent hashes.

    Eight bytes at a time go through the finaliser, words over LONG bytes through XXH3. Different words may agree by chance only.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lower:
        data = _LOWER[data]
    lanes, sizes = _lanes(data), ends - starts
    h = mix(sizes.astype(np.uint64) * np.uint64(ODD) + np.uint64((seed + 1) * ODD * ODD % (1 << 64)))
    h = mix(h ^ _lane(lanes, starts, sizes))
    todo = np.flatnonzero((sizes > 8) & (sizes <= LONG))
    k = 8
    while len(todo):
        h[todo] = mix(h[todo] * np.uint64(ODD) ^ _lane(lanes, starts[todo] + k, sizes[todo] - k))
        k += 8
        todo = todo[sizes[todo] > k]
    if len(long := np.flatnonzero(sizes > LONG)):
        raw = memoryview(np.ascontiguousarray(data))
        h[long] = [xxhash.xxh3_64_intdigest(raw[a:b], seed) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return h


def same_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each word has the bytes of the word numbered other beside it."""
    sizes = ends - starts
    if not len(starts):
        return True
    if not np.array_equal(sizes, sizes[other]):
        return False
    lanes = _lanes(data)
    first = _lane(lanes, starts, sizes)
    if not np.array_equal(first, first[other]):
        return False
    todo, k = np.flatnonzero((sizes > 8) & (sizes <= LONG) & (other != np.arange(len(starts)))), 8
    while len(todo):
        left = sizes[todo] - k
        if not np.array_equal(_lane(lanes, starts[todo] + k, left), _lane(lanes, starts[other[todo]] + k, left)):
            return False
        k += 8
        todo = todo[sizes[todo] > k]
    raw = memoryview(np.ascontiguousarray(data))
    return all(raw[starts[i] : ends[i]] == raw[starts[o] : ends[o]] for i in np.flatnonzero(sizes > LONG).tolist() if (o := int(other[i])) != i)
