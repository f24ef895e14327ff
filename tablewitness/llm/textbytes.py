"""Byte arrays of text columns, for numpy work inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once: temporary arrays hold a few words for each byte.
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches into runs of rows of about ``limit`` bytes (one row may be longer), with their bytes."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of a public integer hash)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number, the first lowest; zeros follow the end."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    for k in (1, 2, 4):
        x[:-k] |= x[k:] << np.uint64(8 * k)
    return x[: len(data)]


class Rolling:
    """Hashes of any substring of ``data`` in constant time each, by prefix sums modulo 2**64.

    The terms are the eight bytes from each position on, mixed: sums of plain bytes modulo a power of two collide
    on Thue-Morse strings under every base. Substrings below eight bytes are mixed as they are. ``seed`` chooses
    the mixing; two of them make a digest of 128 bits.
    """

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data)
        self.eight = eights(data)
        self.seed = np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(self.eight + self.seed) * _powers(_BASE, n)[:n], out=self.sums[1:])
        self.back = _powers(_BACK, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end], with the length mixed in."""
        start, end = np.asarray(start), np.asarray(end)
        size = end - start
        raw = (self.sums[np.maximum(end - 7, start)] - self.sums[start]) * self.back[start]
        few = np.flatnonzero(size < 8)
        if len(few):
            at = np.minimum(start[few], max(len(self.eight) - 1, 0))
            mask = (np.uint64(1) << (size[few].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
            raw[few] = mix((self.eight[at] & mask) + self.seed) if len(self.eight) else self.seed
        return mix(raw + size.astype(np.uint64) * _MIX)


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without ``space`` bytes inside each row, and each run's row.

    ``space`` has 256 booleans.
    """
    inside = ~space[data]
    previous = np.zeros(len(data), bool)
    previous[1:] = inside[:-1]
    edges = offsets[(offsets < len(data)) & (offsets > 0)]
    previous[edges] = False
    starts = np.flatnonzero(inside & ~previous)
    following = np.zeros(len(data), bool)
    following[:-1] = inside[1:]
    following[edges - 1] = False
    ends = np.flatnonzero(inside & ~following) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def spaces(*extra: int) -> np.ndarray:
    """The byte classes of the blank and the controls 9 to 13."""
    table = np.zeros(256, bool)
    table[[32, 9, 10, 11, 12, 13, *extra]] = True
    return table


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]
