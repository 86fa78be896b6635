"""Vectorised tokenising of Arrow string batches with numpy.

A batch is cut into slices of bounded size, so that a task's memory follows the
slice (or the one longest text), not the Arrow batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
LONG = 256  # bytes; longer spans are hashed one by one
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, offsets, bytes) with about `most` bytes of UTF-8 each; null texts are empty."""
    array = batch.column(column)
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    if not len(array):
        return
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(array):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, len(array))
        yield batch.slice(at, to - at), offsets[at : to + 1] - offsets[at], data[offsets[at] : offsets[to]]
        at = to


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross a row's border: starts, ends, runs per row."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = inside[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


class Eights:
    """The bytes of an array, read eight at a time from any place; what lies behind a span's end reads as zeros."""

    def __init__(self, data: np.ndarray, padded: bool = False):
        """If padded, the last eight bytes of data only serve reading."""
        raw = np.ascontiguousarray(data).view(np.uint8)
        self.data = raw if padded else np.concatenate((raw, np.zeros(8, np.uint8)))
        self.words = np.ndarray((len(self.data) - 7,), "<u8", self.data, 0, (1,))

    def at(self, where: np.ndarray, left: np.ndarray) -> np.ndarray:
        out = self.words[where]
        short = np.flatnonzero(left < 8)
        if len(short):
            shift = ((8 - left[short]) * 8).astype(np.uint64)
            out[short] = (out[short] << shift) >> shift
        return out


def _in_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return starts * data.itemsize, (ends - starts) * data.itemsize


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes or code points.

    Eight bytes at a time are mixed into the state by a bijection; spans of
    more than LONG bytes have a cryptographic digest. Two spans collide by
    chance only (2**-64 a pair).
    """
    eights = Eights(data)
    at, size = _in_bytes(data, starts, ends)
    with np.errstate(over="ignore"):
        h = mixed(size.astype(np.uint64) * _GOLDEN)
        live = np.flatnonzero(size <= LONG)
        at_, left = at[live], size[live]
        while len(live):
            h[live] = mixed(h[live] ^ eights.at(at_, left))
            more = left > 8
            live, at_, left = live[more], at_[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG).tolist():
        span = eights.data[at[i] : at[i] + size[i]].tobytes()
        h[i] = int.from_bytes(hashlib.blake2b(span, digest_size=8).digest(), "little")
    return h


def equal_spans(one: Eights, at: np.ndarray, size: np.ndarray, other: Eights, at_: np.ndarray, size_: np.ndarray) -> np.ndarray:
    """Do the spans of two arrays, given by first bytes and sizes in bytes, hold the same bytes, one by one?"""
    same = size == size_
    live = np.flatnonzero(same)
    a, b, left = at[live], at_[live], size[live]
    while len(live):
        equal = one.at(a, left) == other.at(b, left)
        same[live[~equal]] = False
        more = equal & (left > 8)
        live, a, b, left = live[more], a[more] + 8, b[more] + 8, left[more] - 8
    return same


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive word hashes."""
    with np.errstate(over="ignore"):
        h = np.full(max(0, len(words) - n + 1), np.uint64(n), np.uint64)
        for i in range(n):
            h = h * _STEP + words[i : i + len(h)]
        return mixed(h)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct n-word shingle hashes of each row.

    Words are runs of bytes other than ASCII white space, A-Z in lower case. A
    row with fewer than n words has its whole sequence as its one shingle; one
    without words has none.
    """
    data = ASCII_LOWER[data]
    starts, ends, per_row = runs(~SPACES[data], offsets)
    words = span_hashes(data, starts, ends)
    grams, out, at = windows(words, n), [], 0
    for m in per_row.tolist():
        if m >= n:
            s = np.sort(grams[at : at + m - n + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif m:
            out.append(windows(words[at : at + m], m))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def lists(flat: np.ndarray, sizes: list[int] | np.ndarray) -> pa.Array:
    """An Arrow list array of the given row sizes."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
