"""Words of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: What separates words: the bytes of [\x20\x09-\x0D]. They never occur inside a longer UTF-8 sequence.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: An odd multiplier and its inverse modulo 2**64, for hashes that are differences of prefix sums.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, ..., base**(n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = np.cumprod(grown, dtype=np.uint64)
    return _powers[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def segment_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each values[start:end], starts ascending; equal contents give equal hashes wherever they stand.
    Works through about ``piece`` values at a time, since it needs several numbers for each."""
    if len(values) <= piece:
        return hash_piece(values, starts, ends)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + piece)))
        low, high = starts[i], max(starts[i], ends[i:j].max())
        out[i:j] = hash_piece(values[low:high], starts[i:j] - low, ends[i:j] - low)
        i = j
    return out


def hash_piece(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(values)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(FACTOR, n), dtype=np.uint64, out=sums[1:])
    part = (sums[ends] - sums[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(part + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and where each begins (and the last ends); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of each text (and the number of all)."""
    n = len(data)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    stops = inside
    stops[:-1] &= SPACE[data[1:]] | edge[1:n]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about ``most`` bytes of text, so that memory stays bounded;
    a longer text is a piece of its own, whole."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        _, offsets = text_bytes(texts)
        at = 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, stop - at)
            at = stop


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The pieces data[start:start + length], end to end."""
    stops = np.cumsum(lengths)
    total = int(stops[-1]) if len(stops) else 0
    return data[np.arange(total) + np.repeat(starts - (stops - lengths), lengths)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its count, end to end."""
    stops = np.cumsum(counts)
    total = int(stops[-1]) if len(stops) else 0
    return np.arange(total) + np.repeat(starts - (stops - counts), counts)
