"""A bounded cache of the ids that distinct spans of text turn into; it lives as long as its Python worker."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from ._text import Eights, equal_spans, span_hashes

SPANS, BYTES = 500_000, 8 << 20
GATHERED = 1 << 18


class Pool:
    """Spans are looked up by their hash and known by their bytes; each has a run of ids in one growing array."""

    def __init__(self, spans: int = SPANS, most: int = BYTES):
        self.spans, self.most = spans, most
        self._clear()

    def _clear(self) -> None:
        self.hash, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # in order of the hash
        self.ends = np.zeros(1, np.int64)  # of all slots' bytes, side by side in text
        self.flat, self.stops = np.zeros(0, np.int32), np.zeros(1, np.int64)  # the same for ids
        self.eights = Eights(np.zeros(0, np.uint8))

    @property
    def text(self) -> np.ndarray:
        return self.eights.data[: self.ends[-1]]

    def _add(self, hashes: np.ndarray, spans: list[bytes], flat: np.ndarray, sizes: np.ndarray) -> None:
        """Hashes are in order and none is known."""
        n = len(self.slot)
        self.eights = Eights(np.concatenate((self.text, np.frombuffer(b"".join([*spans, bytes(8)]), np.uint8))), padded=True)
        self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum([len(s) for s in spans])))
        self.flat = np.concatenate((self.flat, flat))
        self.stops = np.concatenate((self.stops, self.stops[-1] + np.cumsum(sizes)))
        at = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, at, hashes)
        self.slot = np.insert(self.slot, at, np.arange(n, n + len(hashes)))

    def ids(
        self,
        data: np.ndarray,
        starts: np.ndarray,
        ends: np.ndarray,
        make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]],
        kinds: np.ndarray | None = None,
    ) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order of the spans, ids per span); make(indices of unknown spans) gives their ids and sizes.

        Equal bytes have equal ids; where kinds (0 or 1) are given, equal bytes of one kind.
        """
        eights, unit = Eights(data), data.itemsize
        at, size = starts * unit, (ends - starts) * unit
        hashes = span_hashes(data, starts, ends)
        if kinds is not None:
            hashes ^= kinds.astype(np.uint64)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        alike = equal_spans(eights, at, size, eights, at[first[back]], size[first[back]])
        if kinds is not None:
            alike &= kinds == kinds[first[back]]
        if not alike.all():  # unlike spans with one hash: each is made for itself
            flat, sizes = make(np.arange(len(starts)))
            return flat, sizes
        if len(self.slot) > self.spans or len(self.text) > self.most:
            self._clear()
        where = np.full(len(unique), -1)
        if len(self.hash):
            place = np.minimum(np.searchsorted(self.hash, unique), len(self.hash) - 1)
            slot = self.slot[place]
            begin = self.ends[slot]
            known = (self.hash[place] == unique) & self._same(eights, at[first], size[first], begin, self.ends[slot + 1] - begin, first, kinds)
            where[known] = slot[known]
            if ((self.hash[place] == unique) & ~known).any():  # a known hash of other bytes
                self._clear()
                return self.ids(data, starts, ends, make, kinds)
        new = np.flatnonzero(where < 0)
        if len(new):
            raw = eights.data
            a, b = at[first[new]].tolist(), (at + size)[first[new]].tolist()
            marks = [b"" if kinds is None else b"\1" if k else b"\0" for k in (kinds[first[new]].tolist() if kinds is not None else a)]
            n = len(self.slot)
            self._add(unique[new], [raw[i:j].tobytes() + m for i, j, m in zip(a, b, marks, strict=True)], *make(first[new]))
            where[new] = np.arange(n, n + len(new))
        where = where[back]
        return gather(self.flat, self.stops[where], self.stops[where + 1] - self.stops[where])

    def _same(self, eights, at, size, begin, length, first, kinds) -> np.ndarray:
        if kinds is None:
            return equal_spans(eights, at, size, self.eights, begin, length)
        mark = self.text[begin + length - 1] == kinds[first]
        return mark & equal_spans(eights, at, size, self.eights, begin, length - 1)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, back, spans, borders): the first of each distinct span, which of these each span is, and they themselves side by side.

    Spans are in order, not empty, and known by their bytes.
    """
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, data[:0], np.zeros(1, np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
    joined = data if inside.all() else data[inside]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum((ends - starts) * data.itemsize, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(joined).view(np.uint8))]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()
    back = np.asarray(found.indices)
    seen = np.maximum.accumulate(back)  # numbers are given in order of the first occurrence
    first = np.flatnonzero(np.diff(seen, prepend=-1))
    _, borders, spans = found.dictionary.buffers()
    borders = np.frombuffer(borders, np.int64)[: len(first) + 1] // data.itemsize
    return first, back, np.frombuffer(spans, data.dtype, int(borders[-1])), borders


def gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[first : first + size] one after the other, and their sizes; places are worked out for about GATHERED items at a time."""
    stop = np.cumsum(size)
    out = np.empty(int(stop[-1]) if len(stop) else 0, flat.dtype)
    a = lo = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(stop, lo + GATHERED, "right")))
        hi = int(stop[b - 1])
        out[lo:hi] = flat[np.arange(lo, hi) + np.repeat(first[a:b] - (stop[a:b] - size[a:b]), size[a:b])]
        a, lo = b, hi
    return out, size
