"""Token ids in Re-Pair compressed shards.

Documents in ascending doc_id order are encoded and cut into shards at document
borders. In each shard frequent pairs of neighbouring ids are repeatedly
replaced by nonterminals: every round counts all pairs and replaces the
frequent ones together, the more frequent one where occurrences overlap. A shard stores
its rules, the length that each nonterminal expands to, the remaining symbols
and where each document's begin, so that one document (or one of its ids) is
decoded without its neighbours.

A shard's bytes, little-endian: magic RPG1; u32 documents, rules, symbols,
first nonterminal, bytes per symbol; i64 doc ids; u32 first symbol of each
document; u32 pairs of the rules; u32 expansion lengths; the symbols.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._pool import Pool, distinct, gather
from ._shared import mapped, shipped, written
from ._text import ASCII_LOWER, SPACES, runs, slices

MAGIC = b"RPG1"
SHARD_IDS = 1 << 20
LEAST = 8
END = 1  # the id appended to each document; texts may hold it too
_BUCKET_BITS = 20
_BORDER = np.uint32(0xFFFFFFFF)  # stands for a document's end while pairs are replaced

_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Whole-text encoding through the tokenizers library, once for each distinct unit of text.

    ASCII white space always ends a pre-token of this tokenizer and is dropped,
    so a text's ids are those of its white-space separated pieces in order. A
    piece of ASCII and Latin-1 letters, digits and punctuation is cut further
    into its pre-tokens (runs of letters, single digits, runs of other signs),
    many of which go into one call: each ends with its only id that carries the
    end-of-word mark. A piece with an apostrophe, other code points or what may
    be a special token is a unit as a whole. Where the tokenizer lower-cases,
    pre-tokens that only differ in case are one unit.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.lowers = '"Lowercase"' in json.dumps(json.loads(self.tokenizer.to_str())["normalizer"])
        self.pool = Pool()

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        ids = [e.ids for e in encode(texts, add_special_tokens=False)]
        flat = np.array(ids[0], np.int32) if len(ids) == 1 else np.fromiter((i for x in ids for i in x), np.int32)
        return flat, np.array([len(x) for x in ids], np.int64)

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for single pre-tokens."""
        flat, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(texts), 4000):
            ids, _ = self._each([" ".join(texts[k : k + 4000])])
            ends = np.flatnonzero(self.closes[ids]) + 1
            n = np.diff(ends, prepend=0)
            if len(ends) != len(texts[k : k + 4000]) or ends[-1] != len(ids):  # not one pre-token each after all
                ids, n = self._each(texts[k : k + 4000])
            flat.append(ids)
            sizes.append(n)
        return np.concatenate(flat), np.concatenate(sizes)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a slice's texts, side by side, and how many each text has."""
        starts, ends, odd, per_row = units(data, offsets)
        if self.lowers:
            data = _lowered(data, starts[odd], ends[odd])
        first, back, data, borders = distinct(data, starts, ends)
        starts, ends, odd, raw = borders[:-1], borders[1:], odd[first], data.tobytes()

        def make(which):
            which = np.asarray(which)
            texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[which].tolist(), ends[which].tolist(), strict=True)]
            whole = odd[which]
            parts = [
                (np.flatnonzero(~whole), *self._together([t for t, o in zip(texts, whole, strict=True) if not o])),
                (np.flatnonzero(whole), *self._each([t for t, o in zip(texts, whole, strict=True) if o])),
            ]
            first, size, base = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64), 0
            for at, flat, n in parts:
                size[at] = n
                first[at] = base + np.cumsum(n) - n
                base += len(flat)
            return gather(np.concatenate([x[1] for x in parts]), first, size)

        # an odd piece isn't taken for a pre-token of the same bytes
        ids, sizes = self.pool.ids(data, starts, ends, make, odd)
        ids, sizes = gather(ids, (np.cumsum(sizes) - sizes)[back], sizes[back])
        total = np.concatenate(([0], np.cumsum(sizes)))
        cuts = total[np.concatenate(([0], np.cumsum(per_row)))]
        return ids, np.diff(cuts)


def _lowered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """data with its ASCII and Latin-1 letters in lower case, but for the given spans, which alone hold other characters."""
    low = ASCII_LOWER[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    low[after[(data[after] >= 0x80) & (data[after] <= 0x9E)]] += 0x20
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        low[s:e] = data[s:e]
    return low


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and oddness of a slice's units, and units per row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(bool), np.zeros(len(offsets) - 1, np.int64)
    space = SPACES[data]
    starts, ends, _ = runs(~space, offsets)
    # odd bytes: apostrophes, "<", and all of UTF-8 but C3 80 to C3 BF without the signs C3 97 and C3 B7
    after = np.zeros(n, bool)
    after[1:] = data[:-1] == 0xC3
    odd = (data == 0x27) | (data == 0x3C) | ((data >= 0x80) & (data != 0xC3) & ~after) | (after & ((data == 0x97) | (data == 0xB7)))
    odd = np.flatnonzero(odd)
    whole = np.searchsorted(odd, ends) > np.searchsorted(odd, starts) if len(odd) else np.zeros(len(starts), bool)
    kind = _KINDS[data]
    opens = np.zeros(n, bool)
    opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    opens &= ~space
    if whole.any():
        inside = np.zeros(n + 1, np.int8)  # of an odd piece
        inside[starts[whole]] += 1
        inside[ends[whole]] -= 1
        opens &= np.cumsum(inside[:-1], dtype=np.int8) == 0
    opens[starts] = True
    first = np.flatnonzero(opens)
    begins = np.zeros(n, bool)
    begins[starts] = True
    piece = np.cumsum(begins[first]) - 1
    stop = ends[piece]
    stop[:-1] = np.minimum(stop[:-1], first[1:])
    return first, stop, whole[piece], np.diff(np.searchsorted(first, offsets))


_KINDS = np.full(256, 3, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KINDS[[*range(48, 58)]] = 2


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def compress(symbols: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules as pairs): symbols from `first` on are nonterminals. Borders take no part in pairs.

    A round counts the pairs in hashed buckets and replaces, of overlapping
    occurrences, those whose bucket is fullest. A pair counted below LEAST
    can't become frequent any more, so later rounds only look at the others
    and at pairs with new symbols. When little is left to replace, the pairs
    themselves are counted; the end is when none stands LEAST times.
    """
    symbols, rules, n_rules, exact = symbols.astype(np.uint32), [], 0, False
    inner = symbols != _BORDER
    at = np.flatnonzero(inner[:-1] & inner[1:])  # where the pairs begin that may be frequent
    while len(at):
        a, b = symbols[at], symbols[at + 1]
        if exact:
            _, bucket, counts = np.unique(a.astype(np.uint64) << np.uint64(32) | b, return_inverse=True, return_counts=True)
        else:
            bits = min(20, max(10, len(at).bit_length()))
            bucket = ((a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77 + 2 * n_rules)) >> np.uint32(32 - bits)).astype(np.int64)
            counts = np.bincount(bucket, minlength=1 << bits)
        weight = counts[bucket]
        some = weight >= LEAST
        at, a, b, bucket, weight = at[some], a[some], b[some], bucket[some], weight[some]
        if not len(at):
            break
        # of overlapping occurrences those of most weight; in a stretch of equal ones every other
        joint = at[1:] == at[:-1] + 1
        peak = np.ones(len(at), bool)
        peak[1:] &= ~joint | (weight[1:] >= weight[:-1])
        peak[:-1] &= ~joint | (weight[:-1] >= weight[1:])
        top = np.flatnonzero(peak)
        opens = np.concatenate(([True], at[top[1:]] != at[top[:-1]] + 1))
        order = np.arange(len(top))
        top = top[(order - np.maximum.accumulate(np.where(opens, order, 0))) % 2 == 0]
        # one pair of each bucket
        chosen = np.zeros(len(counts), np.int64)
        chosen[bucket[top]] = top
        pick = chosen[bucket[top]]
        top = top[(a[pick] == a[top]) & (b[pick] == b[top])]
        n = np.bincount(bucket[top], minlength=len(counts))
        used = np.flatnonzero(n >= LEAST // 2)
        if not exact and n[used].sum() <= len(symbols) // 256:
            exact = True
            continue
        number = np.zeros(len(counts), np.uint32)
        number[used] = first + n_rules + np.arange(len(used))
        rules.append(np.stack((a[chosen[used]], b[chosen[used]]), axis=1))
        n_rules += len(used)
        new = number[bucket[top]]
        where, new = at[top[new > 0]], new[new > 0]
        symbols[where] = new
        keep = np.ones(len(symbols), bool)
        keep[where + 1] = False
        live = np.zeros(len(symbols), bool)
        live[at] = True
        live[where] = True
        symbols, live = symbols[keep], live[keep]
        fresh = symbols >= first + n_rules - len(used)
        fresh &= symbols != _BORDER
        live |= fresh
        live[:-1] |= fresh[1:]
        live[:-1] &= (symbols[:-1] != _BORDER) & (symbols[1:] != _BORDER)
        live[-1] = False
        at = np.flatnonzero(live)
    return symbols, np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)


def expansions(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule only names earlier ones."""
    out = np.ones(len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        out[i] = (out[a - first] if a >= first else 1) + (out[b - first] if b >= first else 1)
    return out


def pack(doc_ids: list[int], ids: np.ndarray, sizes: np.ndarray, first: int) -> bytes:
    """One shard of whole documents; each document's ids end with the end id."""
    marked = ids.astype(np.uint32)
    marked[np.cumsum(sizes) - 1] = _BORDER
    symbols, rules = compress(marked, first)
    ends = np.flatnonzero(symbols == _BORDER)
    begins = np.concatenate(([0], ends + 1))[: len(sizes)]
    symbols[ends] = END
    width = 2 if first + len(rules) <= 1 << 16 else 4
    head = struct.pack("<4s5I", MAGIC, len(sizes), len(rules), len(symbols), first, width)
    body = (np.array(doc_ids, "<i8"), begins.astype("<u4"), rules.astype("<u4"), expansions(rules, first).astype("<u4"), symbols.astype(f"<u{width}"))
    return head + b"".join(x.tobytes() for x in body)


class Shard:
    """Random access to a packed shard."""

    def __init__(self, data: bytes):
        magic, docs, rules, symbols, self.first, width = struct.unpack_from("<4s5I", data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize("<4s5I")

        def take(kind, n):
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, begins = take("<i8", docs), take("<u4", docs)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take(f"<u{width}", symbols)
        self.borders = np.append(begins.astype(np.int64), symbols)
        size = np.where(self.symbols >= self.first, 0, 1).astype(np.int64)
        inner = self.symbols >= self.first
        size[inner] = self.lengths[self.symbols[inner].astype(np.int64) - self.first]
        self._sizes = size
        self._flat: np.ndarray | None = None

    def _expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All nonterminals' ids side by side, and where each begins."""
        if self._flat is None:
            self._begin = np.cumsum(self.lengths.astype(np.int64)) - self.lengths
            self._flat = np.zeros(int(self.lengths.sum()), np.uint32)
            for i, pair in enumerate(self.rules.tolist()):
                at = int(self._begin[i])
                for s in pair:
                    if s < self.first:
                        self._flat[at] = s
                        at += 1
                    else:
                        n, b = int(self.lengths[s - self.first]), int(self._begin[s - self.first])
                        self._flat[at : at + n] = self._flat[b : b + n]
                        at += n
        return self._flat, self._begin

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids of the documents lo up to hi (all, by default), side by side."""
        part = slice(self.borders[lo], self.borders[len(self.doc_ids) if hi is None else hi])
        flat, begin = self._expanded()
        symbols = self.symbols[part].astype(np.int64)
        pool = np.concatenate((flat, np.arange(self.first, dtype=np.uint32)))
        inner = symbols >= self.first
        start = symbols + len(flat)
        start[inner] = begin[symbols[inner] - self.first]
        return gather(pool, start, self._sizes[part])[0]

    def sizes(self) -> np.ndarray:
        """How many ids each document has, from the expansion lengths alone."""
        total = np.concatenate(([0], np.cumsum(self._sizes)))
        return np.diff(total[self.borders])

    def id_at(self, doc: int, k: int) -> int:
        """The k-th id of a document: steps over whole symbols by their lengths, then down one rule tree."""
        total = np.cumsum(self._sizes[self.borders[doc] : self.borders[doc + 1]])
        i = int(np.searchsorted(total, k, "right"))
        k -= int(total[i - 1]) if i else 0
        s = int(self.symbols[self.borders[doc] + i])
        while s >= self.first:
            a, b = self.rules[s - self.first].tolist()
            n = int(self.lengths[a - self.first]) if a >= self.first else 1
            s, k = (a, k) if k < n else (b, k - n)
        return s


def write_token_shards(docs: DataFrame, path: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """(part, shard, n_tokens, data): docs (doc_id, text) in ascending doc_id order, in shards of about shard_ids ids.

    Null texts are empty; rows with a null doc_id are left out; rows that
    repeat a doc_id stay, in order of their texts. The table is written to the
    shared folder.
    """
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, shard = encoder(path), TaskContext.get().partitionId(), 0
        doc_ids, held, sizes, total = [], [], [], 0

        def told():
            data = pack(doc_ids, np.concatenate(held), np.array(sizes, np.int64), code.size)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip((part, shard, total, data), kinds, strict=True)], ["part", "shard", "n_tokens", "data"]
            )

        for batch in batches:
            for rows, offsets, data in slices(batch, "text"):
                ids, per_row = code.rows(data, offsets)
                at = 0
                for doc, n in zip(rows.column("doc_id").to_pylist(), per_row.tolist(), strict=True):
                    doc_ids.append(doc)
                    held += [ids[at : at + n], np.array([END], np.int32)]
                    sizes.append(n + 1)
                    total += n + 1
                    at += n
                    if total >= shard_ids:
                        yield told()
                        doc_ids, held, sizes, total, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield told()

    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(mapped(docs, run, "part int, shard int, n_tokens long, data binary"), "token-shards")


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, shard, data in zip(*(batch.column(i) for i in range(3)), strict=True):
            s = Shard(data.as_py())
            sizes = s.sizes()
            flat = s.ids().astype("<u4")
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.as_py()] * n, pa.int32()),
                    pa.array([shard.as_py()] * n, pa.int32()),
                    pa.array(s.doc_ids),
                    pa.array(ends - sizes),
                    pa.array(sizes),
                    pa.array(crc, pa.int64()),
                ],
                ["part", "shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_token_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from a shard table; start counts the ids of all documents before."""
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each range of doc_id
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    starts = written(sizes.withColumn("base0", inner).join(parts, "part").select("part", "shard", (F.col("base0") + F.col("base")).alias("base")), "starts")
    rows = mapped(shards.select("part", "shard", "data"), _decoded, "part int, shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
