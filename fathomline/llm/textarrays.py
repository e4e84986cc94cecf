"""Whole batches of texts as numpy arrays.

A batch of strings is one byte array with row offsets, exactly as Arrow
holds it.  Units of text (words, lines, pre-tokens) are spans of that array;
equal spans of a slice get one number by their bytes, so that Python handles
distinct units only and no two units are ever taken for one.  Batches are
handled in slices of about ``SLICE_BYTES``; a longer text is a slice of its
own, never cut.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words made of ASCII letters, digits and every non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) per slice; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + SLICE_BYTES, "right")) - 1)
        end = min(end, len(column))
        yield row, end, buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
        row = end


def strings(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive parts of a byte array that end at ``ends``, as binary values."""
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """These parts of a byte array, which may overlap, as binary values."""
    sizes = end - start
    ends = np.cumsum(sizes)
    small = np.int32 if len(ends) and max(ends[-1], len(data)) < 1 << 31 else np.int64
    at = np.arange(ends[-1] if len(ends) else 0, dtype=small) + np.repeat((start - (ends - sizes)).astype(small), sizes)
    return strings(data[at], ends)


def numbered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The number of each span among the distinct ones, told apart by their bytes, and these."""
    coded = spans(data, start, end).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


#: Longer spans are few and hashed one by one.
_LANES = 8
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def hashed(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of each span: eight bytes after the other go through the mixer, so that no sums can cancel."""
    size = end - start
    out = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    for lane in range(_LANES):
        live = np.flatnonzero(size > 8 * lane)
        if not len(live):
            break
        left = np.minimum(size[live] - 8 * lane, 8)
        out[live] = mix(out[live] * np.uint64(0xD1342543DE82EF95) + (words[start[live] + 8 * lane] & _KEEP[left]))
    long = np.flatnonzero(size > 8 * _LANES)
    if len(long):
        raw = memoryview(np.ascontiguousarray(data))
        out[long] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of True; a row's end ends a run."""
    if len(inside) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def per_row(start: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many spans each row has, and where each row's spans begin (n + 1 of them)."""
    bounds = np.searchsorted(start, offsets, "left")
    return np.diff(bounds), bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's part; 0 for an empty part."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def windows(hashes: np.ndarray, counts: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words and their row; a row of fewer, but not none, words has one."""
    n = len(hashes)
    row = np.repeat(np.arange(len(counts)), counts)
    width = np.minimum(np.repeat(counts, counts), size)
    place = np.arange(n) - bounds[:-1][row] if n else np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        part = hashes * np.uint64(2 * (j + 1) * 0x632BE59BD9B4E019 + 1 & 0xFFFFFFFFFFFFFFFF)
        if j == 0:
            total += part
        else:
            use = width[: n - j] > j
            total[: max(n - j, 0)][use] += part[j:][use]
    keep = place + width <= np.repeat(counts, counts)
    return mix(total[keep] + width[keep].astype(np.uint64)), row[keep]


def ragged_take(values: np.ndarray, bounds: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts ``picks`` of a ragged array one after the other, and their lengths."""
    first = bounds[picks]
    lengths = bounds[picks + 1] - first
    ends = np.cumsum(lengths)
    small = np.int32 if len(ends) and max(ends[-1], len(values)) < 1 << 31 else np.int64
    at = np.arange(ends[-1] if len(ends) else 0, dtype=small) + np.repeat((first - (ends - lengths)).astype(small), lengths)
    return values[at], lengths
