"""N-gram Jaccard self-join by count vectors in R-trees, exact at every size.

Texts become sets of hashed word shingles. Equal sets collapse to one node (a
64-bit hash of the set; two different sets share one with odds of 2**-64 a
pair). Shingles are hashed into groups and a node's group counts are its point.

A hashed count vector has no low-dimensional structure for one global tree to
cut on, so the tree's top level is cut by shingle: two sets with Jaccard
similarity t or more share one of their first n - ceil(t * n) + 1 shingles in
any common order, and the tree's pages are the sets that share such a shingle.
Every page with sets that aren't connected yet holds a packed R-tree over their
points; the summed coordinate minima of a point and a box's upper corner bound
the overlap that any set in the box can have, and only pairs whose bound allows
the similarity are verified on their whole shingle sets.

Frequent shingles come last in the order, so pages stay small. The order only
steers cost: any order gives the same links.

Near copies are first hung onto pivots: each row of a page names the first set,
in an order by hash, that its bounds allow, and a set tries the pivots that it
was given most often. Pages inside one component need no further pairs. So
links are found up to connectivity, and groups never expand into all pairs of
rows. A page or a component of many sets is dealt into blocks, and a task
compares two blocks at a time.

Links never leave a component, so they are counted there on whole sets.

Whole sets are only shipped of pairs whose points allow a link, made anew from
the texts each time, so that what is shuffled follows the pairs in question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import dropped, mapped, settled, shipped, written
from ._text import lists, mixed, shingle_sets, slices
from .graph import connected_components

GROUPS = 512
COARSE = 4
HASH_BYTES = 6  # of a shingle's hash where two sets are compared
HOT_SHINGLES = 1 << 20
BLOOM_BITS = 1 << 25
LEAF = 32
FAN = 8
LARGE = 512
BLOCK = 256  # sets of a component in a block
PAGE_BLOCK = 2048  # rows of a page in a block
PIVOTS = 3  # that a set tries
SALTS = 16
BEST_ROUNDS = 2
MANY = 1000  # a set with more copies than rows / MANY is joined to its rows apart


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _identity(s: np.ndarray) -> int:
    """A set's node: a hash over the sum of its mixed shingles and its size."""
    with np.errstate(over="ignore"):
        x = np.add.reduce(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) + np.uint64(len(s))
        return int(mixed(np.array([x], np.uint64)).view(np.int64)[0])


def _scan(n: int):
    """Rows (doc, size, node, point) of the texts, and (shingle, count, null, null) of shingles repeated within a task's stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, c, d):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), c, d], ["a", "b", "node", "point"])

        def repeated():
            h, counts = np.unique(np.concatenate(held), return_counts=True)
            h, counts = h[counts > 1], counts[counts > 1]
            return out(_signed(h), counts, pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.binary()))

        held, size = [], 0
        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                sets = shingle_sets(data, offsets, n)
                nodes = pa.array([_identity(s) for s in sets], pa.int64())
                yield out(rows.column("doc_id"), [len(s) for s in sets], nodes, pa.array([count_vector(s).tobytes() for s in sets], pa.binary()))
                held += sets
                size += sum(map(len, sets))
                if size > 2_000_000:
                    yield repeated()
                    held, size = [], 0
        if held:
            yield repeated()

    return run


def _prefixes(n: int, num: int, den: int, hot):
    """(node, size, keys): the shingles of each set's prefix in order, one row for each set of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = hot.value  # in ascending frequency
        order = np.argsort(shingles)
        by_value = shingles[order]
        seen: set[int] = set()
        for batch in batches:
            for _, offsets, data in slices(batch, "text"):
                nodes, sizes, keys = [], [], []
                for s in shingle_sets(data, offsets, n):
                    if not len(s) or (node := _identity(s)) in seen:
                        continue
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    need = len(s) - -(-num * len(s) // den) + 1
                    at = np.minimum(np.searchsorted(by_value, s), max(0, len(by_value) - 1))
                    is_hot = by_value[at] == s if len(by_value) else np.zeros(len(s), bool)
                    plain = s[~is_hot][:need]
                    if len(plain) < need:
                        rank = np.sort(order[at[is_hot]])[: need - len(plain)]
                        plain = np.concatenate((plain, shingles[rank]))
                    nodes.append(node)
                    sizes.append(len(s))
                    keys.append(plain)
                if nodes:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(nodes, pa.int64()),
                            pa.array(sizes, pa.int64()),
                            lists(_signed(np.concatenate(keys)), [len(k) for k in keys]),
                        ],
                        ["node", "n", "keys"],
                    )

    return run


def _pairs_within(starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places within each stretch, side by side; for short stretches only."""
    row = np.repeat(starts, lens) + _count_up(lens)
    more = np.repeat(starts + lens, lens) - row - 1
    p = np.repeat(row, more)
    return p, p + 1 + _count_up(more)


def _count_up(lens: np.ndarray) -> np.ndarray:
    """0 up to each length, side by side."""
    return np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)


def _pages(num: int, den: int):
    """From rows (key, node, n, rest) sorted by key and node: those that another row of their page may link with, and a pivot.

    rest counts a set's shingles from the key on, in the common order. Where
    the key is the first one that two sets share, their overlap is at most the
    smaller rest; every linked pair has such a key, so rows without a partner
    that this bound allows can go. A row's pivot is the first set in order of
    mixed nodes, itself included, that the bound allows. A page of over LARGE
    rows isn't tested: all its rows stay, marked large, with one pivot for a
    stretch of them.
    """

    def told(*columns):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "node", "n", "rest", "pivot", "large"])

    def lowest(node):
        return node[np.argmin(mixed(node.view(np.uint64)))]

    def tested(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, node, n, rest = rows
        keep = np.ones(len(key), bool)
        keep[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, n, rest = (x[keep] for x in rows)
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        lens = np.diff(np.append(starts, len(key)))
        keep, pivot, large = np.zeros(len(key), bool), node.copy(), np.zeros(len(key), bool)
        by = np.argsort(mixed(node.view(np.uint64)))
        rank = np.zeros(len(key), np.int64)
        rank[by] = np.arange(len(key))
        best = rank.copy()
        few = (lens > 1) & (lens <= LEAF)
        p, q = _pairs_within(starts[few], lens[few])
        fits = (num + den) * np.minimum(rest[p], rest[q]) >= num * (n[p] + n[q])
        p, q = p[fits], q[fits]
        keep[p] = keep[q] = True
        np.minimum.at(best, p, rank[q])
        np.minimum.at(best, q, rank[p])
        pivot[keep] = node[by[best[keep]]]
        for a, m in zip(starts[lens > LEAF].tolist(), lens[lens > LEAF].tolist(), strict=True):
            page = slice(a, a + m)
            if m > LARGE:
                keep[page] = large[page] = True
                pivot[page] = lowest(node[page])
                continue
            at = a + np.argsort(rank[page])
            r, s = rest[at], n[at]
            fits = (num + den) * np.minimum(r[:, None], r) >= num * (s[:, None] + s)
            np.fill_diagonal(fits, False)
            keep[at] = fits.any(axis=1)
            np.fill_diagonal(fits, True)
            pivot[at] = node[at[fits.argmax(axis=1)]]
        if keep.any():
            yield told(*(x[keep] for x in (key, node, n, rest, pivot, large)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        hot: tuple[int, int, int] | None = None  # a page that was too large to hold: key, last node told, pivot
        for batch in batches:
            rows = [np.asarray(batch.column(i)) for i in range(4)]
            if not len(rows[0]):
                continue
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if hot is not None:
                mine = int(np.searchsorted(rows[0], hot[0], "right"))
                key, node, n, rest = (x[:mine] for x in rows)
                new = np.ones(mine, bool)
                new[1:] = node[1:] != node[:-1]
                new &= node > hot[1]
                if new.any():
                    many = int(new.sum())
                    yield told(key[new], node[new], n[new], rest[new], np.full(many, hot[2]), np.ones(many, bool))
                    hot = (hot[0], int(node[-1]), hot[2])
                rows = [x[mine:] for x in rows]
                if not len(rows[0]):
                    held = None
                    continue
                hot = None
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last:
                yield from tested([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > 100 * LARGE:  # copies of a set from many tasks don't make a page large
                new = np.concatenate(([True], held[1][1:] != held[1][:-1]))
                held = [x[new] for x in held]
            if len(held[0]) > 100 * LARGE:
                hot = (int(held[0][0]), int(held[1][-1]), int(lowest(held[1])))
                yield from tested(held)
                held = None
        if held is not None:
            yield from tested(held)

    return run


def count_vector(s: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """A set's point: how many of its shingles fall into each group, 255 at most; what is over that is bounded by the size."""
    return np.minimum(np.bincount((s % np.uint64(groups)).astype(np.int64), minlength=groups), 255).astype(np.uint8)


def _sets(n: int, bloom):
    """(doc, node, packed set) of the documents that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bloom.value
        for batch in batches:
            ids = np.asarray(batch.column("doc_id").fill_null(0)).astype(np.int64)
            h = mixed(ids.view(np.uint64)) % np.uint64(len(words) * 64)
            inside = (words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1)
            batch = batch.filter(pa.array(inside.astype(bool)))
            for rows, offsets, data in slices(batch, "text"):
                sets = shingle_sets(data, offsets, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").cast(pa.int64()),
                        pa.array([_identity(s) for s in sets], pa.int64()),
                        pa.array([_packed(s) for s in sets], pa.binary()),
                    ],
                    ["doc_id", "node", "shingles"],
                )

    return run


def _packed(s: np.ndarray) -> bytes:
    return np.unique(s >> np.uint64(64 - 8 * HASH_BYTES)).view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // HASH_BYTES, 8), np.uint8)
    out[:, :HASH_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, HASH_BYTES)
    return out.view(np.uint64).ravel()


def _bounded(num: int, den: int):
    """Of rows (a, b, points and sizes of both), the pairs whose summed coordinate minima allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, GROUPS) for k in (2, 3))
                m, n = (np.asarray(batch.column(k)).astype(np.int64) for k in (4, 5))
                over = np.minimum(m - p.sum(axis=1, dtype=np.int64), n - q.sum(axis=1, dtype=np.int64))
                most = np.minimum(p, q).sum(axis=1, dtype=np.int64) + over
                yield batch.select(["a", "b"]).filter(pa.array((num + den) * most >= num * (m + n)))

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Stretches of rows sorted by their first `keys` columns that agree in these."""
    held, current = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        starts = np.concatenate(([0], np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols], axis=0)) + 1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            mine = tuple(int(x[s]) for x in cols)
            if held and mine != current:
                yield held
                held = []
            current = mine
            held.append(batch.slice(s, e - s))
    if held:
        yield held


def _verified(num: int, den: int):
    """Of rows (a, b, set of a, set of b), those whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = _unpacked(x.as_py()), _unpacked(y.as_py())
                both = np.concatenate((p, q))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(den * common >= num * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _counted(num: int, den: int):
    """From rows (component, i, j, side, node, n_copies, shingles) sorted by component, i and j: (node, linked).

    Sets of side 0 are compared with those of side 1, or with each other where
    i = j; linked sums n_copies of the sets that a set links with there.
    """

    def compared(page):
        side, node, copies = (np.concatenate([np.asarray(x.column(k)) for x in page]) for k in (3, 4, 5))
        sets = [b for x in page for b in x.column(6).to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = page[0].column(1)[0] == page[0].column(2)[0]
        right = left if same else right
        sets = [_unpacked(x) for x in sets]
        size = np.array([len(x) for x in sets])
        right = right[np.argsort(size[right], kind="stable")]
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(size)
        at = [at[e - n : e] for e, n in zip(ends.tolist(), size.tolist(), strict=True)]
        flat = np.concatenate([at[k] for k in right.tolist()]) if len(right) else at[0][:0]
        starts = np.concatenate(([0], np.cumsum(size[right])))
        mark, linked = np.zeros(len(values), np.uint8), np.zeros(len(sets), np.int64)
        for k in left.tolist():
            n = int(size[k])
            lo, hi = np.searchsorted(size[right], -(-num * n // den)), np.searchsorted(size[right], den * n // num if num else ends[-1], "right")
            if lo >= hi:
                continue
            mark[at[k]] = 1
            common = np.add.reduceat(mark[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo], dtype=np.int64)
            mark[at[k]] = 0
            others = right[lo:hi]
            fits = den * common >= num * (n + size[others] - common)
            others = others[fits & (others != k)]
            linked[k] += copies[others].sum()
            if not same:
                linked[others] += copies[k]
        some = linked > 0
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(linked[some])], ["node", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in _groups(batches, 3):
            yield compared(page)

    return run


def _packing(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """An order in which neighbours are alike: cut in halves along the size or the coordinate that spreads most, down to LEAF points."""
    out, todo = [], [np.arange(len(sizes))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        some = points[at].astype(np.float32)
        spread = some.var(axis=0)
        widest = int(spread.argmax())
        # a size counts for as much as all coordinates together
        along = sizes[at] if sizes[at].var() > spread.sum() else some[:, widest]
        half = LEAF * max(1, round(len(at) / LEAF / 2))
        by = at[np.argsort(along, kind="stable")]
        todo += [by[half:], by[:half]]
    return np.concatenate(out)


class RTree:
    """A packed R-tree over points: leaves of LEAF neighbours, FAN boxes under a box, up to one root.

    A box keeps its upper corner (sums of COARSE neighbouring coordinates), the
    bounds of its sizes and rests and, where all its points have the same
    label, that label. A search goes down from the root by all boxes that may
    hold a partner; points are tested on the coarse, then on all coordinates.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray, rests: np.ndarray):
        self.order = _packing(points.reshape(len(points), -1, COARSE).sum(axis=2, dtype=np.uint16), sizes)
        self.points, self.sizes, self.labels, self.rests = (x[self.order] for x in (points, sizes, labels, rests))
        self.rough = self.points.reshape(len(points), -1, COARSE).sum(axis=2, dtype=np.uint16)
        self.over = self.sizes - self.points.sum(axis=1, dtype=np.int64)  # shingles that the points don't count
        self.levels: list[tuple[np.ndarray, ...]] = []
        below = (self.rough, self.over, self.sizes, self.sizes, self.rests, self.labels, self.labels)
        step = LEAF
        while len(below[0]) > 1 or not self.levels:
            at = np.arange(0, len(below[0]), step)
            upper, over, low, high, rest, one, other = below
            most, least = np.maximum.reduceat, np.minimum.reduceat
            below = (most(upper, at, axis=0), most(over, at), least(low, at), most(high, at), most(rest, at), least(one, at), most(other, at))
            self.levels.append(below)
            step = FAN

    def partners(self, size: int, label: int, rest: int, point: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Points of other labels whose bounds allow (num + den) * overlap >= num * (their size + size), and how far they do."""
        rough = point.reshape(-1, COARSE).sum(axis=1, dtype=np.uint16)
        over = size - int(point.sum(dtype=np.int64))
        at = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, most, low, high, rests, one, other = self.levels[depth]
            need = num * (size + low[at])
            fits = (den * high[at] >= num * size) & (num * low[at] <= den * size) & ~((one[at] == other[at]) & (one[at] == label))
            fits &= (num + den) * np.minimum(rests[at], rest) >= need
            at, need = at[fits], need[fits]
            bound = np.minimum(upper[at], rough).sum(axis=1, dtype=np.int64) + np.minimum(most[at], over)
            at = at[(num + den) * bound >= need]
            if not len(at):
                return at, np.zeros(0)
            step = FAN if depth else LEAF
            at = (at[:, None] * step + np.arange(step)).ravel()
            at = at[at < (len(self.levels[depth - 1][0]) if depth else len(self.sizes))]
        need = num * (size + self.sizes[at])
        fits = (self.labels[at] != label) & ((num + den) * np.minimum(self.rests[at], rest) >= need)
        fits &= (den * self.sizes[at] >= num * size) & (num * self.sizes[at] <= den * size)
        at, need = at[fits], need[fits]
        for points, mine in ((self.rough, rough), (self.points, point)):
            bound = np.minimum(points[at], mine).sum(axis=1, dtype=np.int64) + np.minimum(self.over[at], over)
            fits = (num + den) * bound >= need
            at, need, bound = at[fits], need[fits], bound[fits]
        return self.order[at], bound / need


def _candidates(num: int, den: int, best: bool = False):
    """From rows (key, i, j, side, node, n, rest, label, point) sorted by key, i and j: pairs of different labels that their bounds allow.

    Sets of side 0 are looked up among those of side 1, or among each other
    where i = j. Rows are (a, b); if best, (key, a, b, score) with only the
    likeliest partner of each row.
    """
    names = ["key", "a", "b", "score"] if best else ["a", "b"]

    def at_once(starts, lens, node, size, rest, label, point):
        """(row, row, score) of many pages of one leaf each."""
        p, q = _pairs_within(starts, lens)
        need = num * (size[p] + size[q])
        fits = (label[p] != label[q]) & ((num + den) * np.minimum(rest[p], rest[q]) >= need)
        fits &= (den * size[q] >= num * size[p]) & (num * size[q] <= den * size[p])
        p, q, need = p[fits], q[fits], need[fits]
        for k in range(0, len(p), 8192):
            a, b, least = p[k : k + 8192], q[k : k + 8192], need[k : k + 8192]
            over = np.minimum(size[a] - point[a].sum(axis=1, dtype=np.int64), size[b] - point[b].sum(axis=1, dtype=np.int64))
            bound = np.minimum(point[a], point[b]).sum(axis=1, dtype=np.int64) + over
            fits = (num + den) * bound >= least
            a, b, score = a[fits], b[fits], bound[fits] / least[fits]
            if best and len(a):
                a, b, score = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((score, score))
                order = np.lexsort((-score, a))
                a, b, score = a[order], b[order], score[order]
                first = np.concatenate(([True], a[1:] != a[:-1]))
                a, b, score = a[first], b[first], score[first]
            yield a, b, score

    def by_tree(base, same, side, node, size, rest, label, point):
        mine, theirs = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        labels, counts = np.unique(label, return_counts=True)
        if same:  # of two labels at least one isn't the page's most frequent
            theirs, mine = mine, np.flatnonzero(label != labels[counts.argmax()])
        if len(labels) < 2 or not len(mine) or not len(theirs):
            return
        tree = RTree(point[theirs], size[theirs], label[theirs], rest[theirs])
        for i in mine.tolist():
            found, score = tree.partners(int(size[i]), int(label[i]), int(rest[i]), point[i], num, den)
            if best and len(found):
                k = int(score.argmax())
                found, score = found[k : k + 1], score[k : k + 1]
            yield np.full(len(found), base + i), base + theirs[found], score

    def pairs(rows):
        key, i, j, side, node, size, rest, label, point = rows
        starts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        lens = np.diff(np.append(starts, len(key)))
        few = (lens <= LEAF) & (i[starts] == j[starts])
        yield from at_once(starts[few], lens[few], node, size, rest, label, point)
        for s, n in zip(starts[~few].tolist(), lens[~few].tolist(), strict=True):
            yield from by_tree(s, i[s] == j[s], *(x[s : s + n] for x in (side, node, size, rest, label, point)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told():
            columns = [np.concatenate(x) for x in zip(*found, strict=True)]
            if not best:
                columns = np.unique(np.stack((np.minimum(*columns), np.maximum(*columns))), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

        def whole(rows):
            nonlocal found, n
            key, node = rows[0], rows[4]
            for a, b, score in pairs(rows):
                if len(a):
                    found.append((key[a], node[a], node[b], score) if best else (node[a], node[b]))
                    n += len(a)
                if n > 100_000:
                    yield told()
                    found, n = [], 0

        found, n = [], 0
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(batch.column(k)).astype(np.int64) for k in range(8)]
            rows.append(np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
            borders = np.flatnonzero(np.any([x[1:] != x[:-1] for x in rows[:3]], axis=0))
            last = int(borders[-1]) + 1 if len(borders) else 0
            if held and (last or any(x[0][-1] != y[0] for x, y in zip(zip(*held, strict=True), rows[:3], strict=False))):
                yield from whole([np.concatenate(x) for x in zip(*held, [x[:last] for x in rows], strict=True)])
                held = []
            elif last:
                yield from whole([x[:last] for x in rows])
            held.append([x[last:] for x in rows])
        if held:
            yield from whole([np.concatenate(x) for x in zip(*held, strict=True)])
        if found:
            yield told()

    return run


def _bloom(spark: SparkSession, ids: DataFrame):
    """A bitmap of fixed size over the ids' hashes; at most BLOOM_BITS / 64 words reach the driver."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mixed(np.asarray(batch.column(0)).astype(np.int64).view(np.uint64)) % np.uint64(BLOOM_BITS)
            word, bit = (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["word", "bit"])

    found = mapped(ids, bits, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(BLOOM_BITS // 64, np.uint64)
    words[np.asarray(found["word"])] = np.asarray(found["bit"]).view(np.uint64)
    return spark.sparkContext.broadcast(words)


def _dealt(rows: DataFrame, group: str, sizes: DataFrame, block: int) -> DataFrame:
    """rows of the groups in sizes (group, c), dealt into blocks: each row goes to all pairs (i, j) of its block and another, as side 0 or 1."""
    salted = sizes.select(group, F.ceil(F.col("c") / block).alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    h = F.xxhash64("node")
    out = rows.withColumn("salt", F.pmod(h, F.lit(SALTS)).cast("int")).join(salted, [group, "salt"])
    out = out.withColumn("mine", F.pmod(F.floor(h / SALTS), F.col("blocks")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    out = out.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    return out.withColumn("side", (F.col("mine") > F.col("other")).cast("int"))


def ngram_jaccard_join(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_copies, n_links) for each row of docs (doc_id, text).

    Two rows link where den * |intersection| >= num * |union| of their distinct
    n-word shingles; component_id is the smallest doc_id reachable by links,
    n_copies how many rows have the very same set, n_links how many other rows
    a row links with (left out unless count_links). Null and blank texts have
    no shingles and link with nothing (component_id is their own doc_id,
    n_copies 1, n_links 0); rows with a null doc_id have no identity and are left out;
    repeated rows stay and link with each other. Columns other than doc_id and
    text are ignored.
    """
    spark = shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    scan = written(mapped(docs, _scan(n), "a long, b long, node long, point binary"), "shingles")
    rows = scan.where("node is not null").select(F.col("a").alias("doc_id"), F.col("b").alias("n_shingles"), "node")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_copies"))
    hot = (
        scan.where("node is null").groupBy("a").agg(F.sum("b").alias("b")).where("b >= 4")
        .orderBy(F.desc("b"), "a").limit(HOT_SHINGLES).toArrow()
    )
    hot = np.ascontiguousarray(np.asarray(hot["a"]).astype(np.int64).view(np.uint64)[::-1])
    hot = spark.sparkContext.broadcast(hot)

    keys = mapped(docs, _prefixes(n, num, den, hot), "node long, n long, keys array<long>")
    keys = keys.select("node", "n", F.posexplode("keys").alias("at", "key"))
    keys = keys.select("key", "node", F.col("n").cast("int").alias("n"), (F.col("n") - F.col("at")).cast("int").alias("rest"))
    pages = keys.repartition("key").sortWithinPartitions("key", "node")
    pages = written(mapped(pages, _pages(num, den), "key long, node long, n int, rest int, pivot long, large boolean"), "pages")
    hot.destroy()
    settled(spark)

    known = pages.select("node").distinct().join(nodes.select("node", "first"), "node")
    points = scan.where("b > 0").select(F.col("a").alias("first"), "node", F.col("b").alias("n"), "point")
    known = written(points.join(known, ["node", "first"]).dropDuplicates(["node"]), "known")

    def sets_of(some: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in some (node, first), made from their texts."""
        bloom = _bloom(spark, some.select("first"))
        sets = mapped(docs, _sets(n, bloom), "doc_id long, node long, shingles binary")
        sets = sets.join(some.select("node", F.col("first").alias("doc_id")), ["node", "doc_id"])
        sets = written(sets.dropDuplicates(["node"]).select("node", "shingles"), "sets")
        bloom.destroy()
        settled(spark)
        return sets

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that link."""
        pairs = written(pairs, "pairs")
        some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        sets = sets_of(known.select("node", "first").join(some, "node"))
        both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
        links = written(mapped(both, _verified(num, den), "a long, b long"), "links")
        dropped(pairs, sets)
        return links

    def components(links: DataFrame) -> DataFrame:
        """(node, label, component_id): nodes with links; a label is that of the component's smallest first document."""
        name = known.select("node", F.struct("first", "node").alias("name"))
        edges = links.join(name.toDF("a", "x"), "a").join(name.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        found = connected_components(edges)
        settled(spark)
        found = found.union(found.select("component", "component").distinct())
        return found.select(F.col("node.node").alias("node"), F.col("component.node").alias("label"), F.col("component.first").alias("component_id"))

    # Hang near copies together first: a set and the pivots that it shares most pages with.
    tries = pages.where("pivot <> node").repartition("node").groupBy("node", "pivot").agg(F.count("*").alias("c"))
    tries = tries.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("c", "pivot")), False).alias("best"))
    tries = tries.select(F.col("node").alias("a"), F.explode(F.slice("best", 1, PIVOTS)).alias("p")).select("a", F.col("p.pivot").alias("b"))
    mine, theirs = known.select("node", "point", "n").toDF("a", "x", "m"), known.select("node", "point", "n").toDF("b", "y", "n")
    tries = tries.join(mine, "a").join(theirs, "b").select("a", "b", "x", "y", "m", "n")
    hung = verified(mapped(tries, _bounded(num, den), "a long, b long"))
    label = written(components(hung), "labels")

    def torn(some: DataFrame, label: DataFrame) -> DataFrame:
        """The rows of pages of two components or more, dealt out for the trees."""
        rows_of = some.join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
        apart = rows_of.groupBy("key", "large").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo < hi")
        few = rows_of.where("not large").join(apart.where("not large").select("key"), "key")
        few = few.select("key", *(F.lit(0).cast("long").alias(x) for x in ("i", "j")), F.lit(0).alias("side"), "node", "n", "rest", "label")
        many = _dealt(rows_of.where("large"), "key", apart.where("large").select("key", "c"), PAGE_BLOCK)
        rows_of = few.union(many.select(*few.columns)).join(known.select("node", "point"), "node")
        return rows_of.select(*few.columns, "point").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def stars(label: DataFrame) -> DataFrame:
        return label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))

    # Then the trees: each row tries its likeliest partners of other components, and pages without any can go; last, all pairs that are left.
    for _ in range(BEST_ROUNDS):
        best = written(mapped(torn(pages, label), _candidates(num, den, True), "key long, a long, b long, score double"), "best")
        tries = best.groupBy("a", "b").agg(F.max("score").alias("s")).groupBy("a")
        tries = tries.agg(F.sort_array(F.collect_list(F.struct("s", "b")), False).alias("best"))
        links = verified(tries.select("a", F.explode(F.slice("best", 1, PIVOTS)).alias("p")).select("a", F.col("p.b").alias("b")))
        less, new = written(pages.join(best.select("key").distinct(), "key", "left_semi"), "pages"), written(components(links.union(stars(label))), "labels")
        dropped(best, links, pages, label)
        pages, label = less, new
    links = verified(mapped(torn(pages, label), _candidates(num, den), "a long, b long").distinct())
    last = written(components(links.union(stars(label))), "labels")
    dropped(label, hung, links, pages)

    nodes = nodes.join(last, "node", "left").withColumn("component_id", F.coalesce("component_id", "first"))
    if count_links:
        members = last.join(known.select("node", "first"), "node").join(nodes.select("node", "n_copies"), "node")
        sets = sets_of(members.select("node", "first"))
        sizes = last.groupBy("label").agg(F.count("*").alias("c"))
        members = _dealt(members.select("node", "label", "n_copies").join(sets, "node"), "label", sizes, BLOCK)
        members = members.select("label", "i", "j", "side", "node", "n_copies", "shingles")
        members = members.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
        linked = mapped(members, _counted(num, den), "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))
        nodes = nodes.join(written(linked, "linked"), "node", "left")
        nodes = nodes.withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("linked", F.lit(0)))
        dropped(sets)
    dropped(known)
    counts = ["n_links"] * count_links
    nodes = written(nodes.select("node", "component_id", "n_copies", *counts), "nodes")
    # fewer than MANY sets can have so many copies, so these are small enough to broadcast; the rest has no hot keys
    many = F.col("n_copies") * MANY > rows.count()
    hot = rows.join(F.broadcast(nodes.where(many)), "node", "left")
    cold = hot.where("n_copies is null").select(*rows.columns).join(nodes.where(~many), "node", "left")
    return hot.where("n_copies is not null").unionByName(cold).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("n_shingles") == 0, F.lit(1)).otherwise(F.col("n_copies")).cast("long").alias("n_copies"),
        *(F.when(F.col("n_shingles") == 0, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in counts),
    )
