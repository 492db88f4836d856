"""Texts of a record batch as one byte array: words, word hashes, windows, units.

Everything here works on whole batches with numpy; nothing loops over words.
A NULL text is an empty text. Documents never share a word or a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at a time inside a task.
PART_BYTES = 3 << 20

_K1, _K2 = np.uint64(0x7FB5D329728EA185), np.uint64(0x81DADEF4BC2DD44D)
_STEP = 0x9E3779B97F4A7C15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def byte_table(ranges: list[tuple[int, int]], inside: bool) -> np.ndarray:
    """256 flags that are ``inside`` for the given ranges and the opposite elsewhere."""
    table = np.full(256, not inside)
    for low, high in ranges:
        table[low:high + 1] = inside
    return table


#: Bytes of words that white space ends: everything but 20 and 09-0D.
SPACED = byte_table([(0x20, 0x20), (0x09, 0x0D)], False)
#: Bytes of words of letters and digits: everything but 00-2F, 3A-60 and 7B-7F.
ALNUM = byte_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)], False)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(33))


def seed_of(seed: int) -> np.uint64:
    return mix(np.array([(seed + 1) * _STEP % (1 << 64)], np.uint64))[0]


def parts(batches: Iterator[pa.RecordBatch], column: str = "text",
          size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``size`` bytes of text, never less than one row.

    At the end, Arrow's unused memory goes back to the system: workers live on for later tasks.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(
            zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            reach = (ends[at - 1] if at else 0) + size
            to = max(at + 1, int(np.searchsorted(ends, reach, side="right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text begins (one more entry than texts)."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type)
                              or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if large else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    if buffers[2] is None or offsets[0] == offsets[-1]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray,
                inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and the index of each text's first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    flag = inside[data]
    other = np.empty_like(flag)
    other[0] = False
    other[1:] = flag[:-1]
    other[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(flag & ~other)
    other[-1] = False
    other[:-1] = flag[1:]
    other[offsets[1:][offsets[1:] > 0] - 1] = False
    end = np.flatnonzero(flag & ~other) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = end - start
    out = mix(left.astype(np.uint64) * np.uint64(_STEP) ^ seed_of(seed))
    live, at = np.arange(len(start)), start.copy()
    while len(live):
        out[live] = mix(out[live] ^ (eight[at] & _MASKS[np.minimum(left, 8)]))
        go = left > 8
        live, at, left = live[go], at[go] + 8, left[go] - 8
    return out


#: Windows whose hashes are summed at a time, so that tables of powers stay small.
_BLOCK = 1 << 16


@lru_cache(maxsize=16)
def _powers(base: int, log_size: int) -> np.ndarray:
    out = np.ones(1 << log_size, np.uint64)
    done = 1
    while done < len(out):
        out[done:2 * done] = out[:done] * np.uint64(pow(base, done, 1 << 64))
        done *= 2
    return out


def windows(words: np.ndarray, first: np.ndarray, width: int,
            seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Where each window of ``width`` words of one text begins, and its hash."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    base = int(seed_of(seed + 1000)) | 1
    size = (min(n, _BLOCK) + width).bit_length()
    up, down = _powers(base, size), _powers(pow(base, -1, 1 << 64), size)
    value = np.empty(n, np.uint64)
    for a in range(0, n, _BLOCK):
        piece = words[a:min(a + _BLOCK, n) + width - 1]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * up[:len(piece)], out=total[1:])
        m = len(piece) - width + 1
        value[a:a + m] = (total[width:] - total[:m]) * down[:m]
    counts = np.maximum(np.diff(first) - width + 1, 0)
    begin = np.repeat(first[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    return begin, mix(value[begin])


def segments(counts: np.ndarray) -> np.ndarray:
    """Running positions 0, 1, ... inside each of the given group sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of ``values`` between consecutive entries of ``first``; empty groups give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]
