"""SentencePiece encoding and decoding by an Aho-Corasick automaton and a single-pass Viterbi search.

The automaton over all pieces reads a text once. At each position the chain of
output links names all pieces that end there, longest first, and each relaxes
the best score of the position; what no piece ends at is spelt in bytes. Ids
are those of the best total piece score, ties to the longer last piece.

Pieces never run over a white-space mark in their middle, nor over a code point
that no piece has, so a text is searched unit by unit, each distinct unit once,
and many units in step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._pool import Pool, distinct, gather
from ._shared import mapped, shipped
from ._text import lists, slices

MARK = 0x2581  # stands for a space
LITERAL = 0x110000  # stands for a mark that the text itself holds; it is spelt in bytes
SLICE = 1 << 19  # bytes of text encoded at a time; a worker's peak follows it
_SHIFT = np.int64(21)


@dataclass
class Automaton:
    """States are numbers, 0 the root; a transition is looked up by (state << 21 | code point) in sorted keys."""

    keys: np.ndarray
    targets: np.ndarray
    fail: np.ndarray
    output: np.ndarray  # the nearest state on the failure chain, itself included, where a piece ends; 0 for none
    link: np.ndarray  # the next such state after this one; 0 for none
    piece: np.ndarray  # the piece that ends at a state, or -1
    length: np.ndarray  # code points of that piece

    @staticmethod
    def build(pieces: dict[str, int]) -> Automaton:
        goto: list[dict[int, int]] = [{}]
        piece, depth = [-1], [0]
        for text, i in pieces.items():
            at = 0
            for c in map(ord, text):
                to = goto[at].get(c)
                if to is None:
                    to = goto[at][c] = len(goto)
                    goto.append({})
                    piece.append(-1)
                    depth.append(depth[at] + 1)
                at = to
            piece[at] = i
        n = len(goto)
        fail, output, link = [0] * n, [0] * n, [0] * n
        queue = list(goto[0].values())
        for s in queue:  # grows while it is read
            output[s] = s if piece[s] >= 0 else output[fail[s]]
            link[s] = output[fail[s]]
            for c, to in goto[s].items():
                f = fail[s]
                while f and c not in goto[f]:
                    f = fail[f]
                fail[to] = goto[f].get(c, 0)
                queue.append(to)
        pairs = sorted(((s << 21) | c, to) for s in range(n) for c, to in goto[s].items())
        keys, targets = np.array(pairs, np.int64).reshape(-1, 2).T.copy()
        return Automaton(keys, targets, *(np.array(x, np.int64) for x in (fail, output, link, piece, depth)))

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """All states' successors: failure links are followed until a transition fits or the root is reached."""
        state, out = state.copy(), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo) and len(self.keys):
            key = (state[todo] << _SHIFT) | c[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[todo[hit]] = self.targets[at[hit]]
            todo = todo[~hit & (state[todo] != 0)]
            state[todo] = self.fail[state[todo]]
        return out


@dataclass
class Model:
    automaton: Automaton
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    surfaces: list[bytes]
    alien: np.ndarray  # of each code point up to LITERAL: does no piece have it?
    joins: bool  # does a piece hold a mark after another code point?
    pool: Pool = field(default_factory=Pool, repr=False)

    @staticmethod
    def load(path: str) -> Model:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, surfaces = {}, np.zeros(len(sp)), []
        byte_ids = np.full(256, sp.unk_id(), np.int32)
        for i in range(len(sp)):
            text = sp.id_to_piece(i)
            scores[i] = sp.get_score(i)
            if sp.is_byte(i):
                byte_ids[int(text[3:5], 16)] = i
                surfaces.append(bytes([int(text[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                surfaces.append(b"")
            else:
                pieces[text] = i
                surfaces.append(text.replace("▁", " ").encode())
        normal = [scores[i] for i in pieces.values()]
        alien = np.ones(LITERAL + 1, bool)
        alien[[ord(c) for t in pieces for c in t]] = False
        joins = any("▁" in t.lstrip("▁") for t in pieces)
        return Model(Automaton.build(pieces), scores, byte_ids, min(normal, default=0.0) - 10.0, surfaces, alien, joins)

    def viterbi(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each unit points[start:end], side by side, and how many each has."""
        order = np.argsort(starts - ends, kind="stable")  # longest first, so those still running are a prefix
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
        at = 0
        while at < len(order):
            longest = int(ends[order[at]] - starts[order[at]])
            some = order[at : at + max(1, min(8_000, 400_000 // max(1, longest)))]
            at += len(some)
            for i, ids in zip(some.tolist(), self._together(points, starts[some], ends[some] - starts[some]), strict=True):
                out[i] = ids
        return np.concatenate([*out, np.zeros(0, np.int32)]), np.array([len(x) for x in out], np.int64)

    def _together(self, points: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        a, n, longest = self.automaton, len(starts), int(size.max(initial=0))
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0.0
        piece = np.full((longest + 1, n), -1, np.int32)  # the last piece of the best way to a position; -1: spelt in bytes
        state = np.zeros(n, np.int64)
        for t in range(1, longest + 1):
            live = int(np.searchsorted(-size, -t, "right"))
            c = points[starts[:live] + t - 1]
            state = a.step(state[:live], c)
            best[t, :live] = best[t - 1, :live] + self.unknown
            end, who = a.output[state], np.arange(live)
            while True:
                some = end > 0
                if not some.any():
                    break
                who, end = who[some], end[some]
                p = a.piece[end]
                score = best[t - a.length[end], who] + self.scores[p]
                better = score > best[t, who]
                w = who[better]
                best[t, w], piece[t, w] = score[better], p[better]
                end = a.link[end]
        # back along the best ways, all units in step
        where, chain, cps = size.astype(np.int64).copy(), [], []
        columns = np.arange(n)
        while (where > 0).any():
            p = np.where(where > 0, piece[where, columns], -2)
            chain.append(p)
            cps.append(points[np.minimum(starts + np.maximum(where, 1) - 1, len(points) - 1)])
            where = where - np.where(p >= 0, self._lengths()[p], np.where(p == -1, 1, 0))
        if not chain:
            return [np.zeros(0, np.int32)] * n
        chain, cps = np.array(chain[::-1]), np.array(cps[::-1])
        found = []
        for k in range(n):
            p = chain[:, k]
            if (p == -1).any():
                found.append(self._spelt(p, cps[:, k]))
            else:
                found.append(p[p >= 0].astype(np.int32))
        return found

    def _lengths(self) -> np.ndarray:
        if not hasattr(self, "_length_of"):
            self._length_of = np.zeros(len(self.scores) + 1, np.int64)
            ends = self.automaton.piece >= 0
            self._length_of[self.automaton.piece[ends]] = self.automaton.length[ends]
        return self._length_of

    def _spelt(self, p: np.ndarray, cps: np.ndarray) -> np.ndarray:
        out: list[int] = []
        for i, c in zip(p.tolist(), cps.tolist(), strict=True):
            if i >= 0:
                out.append(i)
            elif i == -1:
                out += self.byte_ids[list(chr(MARK if c == LITERAL else c).encode())].tolist()
        return np.array(out, np.int32)

    def _units(self, texts: list[str]) -> tuple[np.ndarray, ...]:
        """(which distinct unit each is, these units' code points, their borders, units before each text)."""
        texts = [f" {t}" if t else "" for t in texts]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32).copy()
        points[points == MARK] = LITERAL
        points[points == 32] = MARK
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        opens = np.zeros(len(points), bool)
        opens[offsets[:-1][offsets[:-1] < len(points)]] = True
        if not self.joins:
            mark = points == MARK
            opens[1:] |= mark[1:] & ~mark[:-1]
        alien = self.alien[points]
        opens |= alien
        opens[1:] |= alien[:-1]
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], len(points))[: len(starts)]
        _, back, units, borders = distinct(points, starts, ends)
        return back, units, borders, np.searchsorted(starts, offsets)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids side by side, and how many each text has; an empty text has none."""
        back, units, borders, before = self._units(texts)
        starts, ends = borders[:-1], borders[1:]
        ids, sizes = self.pool.ids(units, starts, ends, lambda which: self.viterbi(units, starts[which], ends[which]))
        ids, sizes = gather(ids, (np.cumsum(sizes) - sizes)[back], sizes[back])
        total = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(total[before])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Each text's bytes: surfaces joined, the space that encoding put in front taken off."""
        flat = np.frombuffer(b"".join(self.surfaces), np.uint8)
        length = np.array([len(s) for s in self.surfaces], np.int64)
        data, n = gather(flat, (np.cumsum(length) - length)[ids], length[ids])
        cuts = np.concatenate(([0], np.cumsum(n)))[np.concatenate(([0], np.cumsum(sizes)))].tolist()
        raw = data.tobytes()
        return [raw[a:b][1:] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model.load(path)
    return _MODELS[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """docs (text, ...) with ids array<int> and exact added: the ids of the whole text, and whether they decode to it.

    A null or empty text has no ids, which decode to the empty text. Columns of
    docs with these names are replaced.
    """
    shipped(docs.sparkSession)
    docs = docs.drop("ids", "exact")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for rows, offsets, data in slices(batch, "text", SLICE):
                ids, sizes = m.encode([t or "" for t in rows.column("text").to_pylist()])
                raw, cuts = data.tobytes(), offsets.tolist()
                exact = [t == raw[a:b] for t, a, b in zip(m.decode(ids, sizes), cuts[:-1], cuts[1:], strict=True)]
                yield rows.append_column("ids", lists(ids, sizes)).append_column("exact", pa.array(exact, pa.bool_()))

    schema = T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("exact", T.BooleanType())])
    return mapped(docs, run, schema)


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (ids, ...) with `decoded` added, the text that the ids spell; null for null ids."""
    shipped(encoded.sparkSession)
    encoded = encoded.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                rows = batch.slice(k, 500)
                each = [np.array(x or (), np.int64) for x in rows.column("ids").to_pylist()]
                texts = m.decode(np.concatenate([*each, np.zeros(0, np.int64)]), np.array([len(x) for x in each], np.int64))
                known = rows.column("ids").is_valid().to_pylist()
                texts = [t.decode("utf-8", "replace") if k else None for t, k in zip(texts, known, strict=True)]
                yield rows.append_column("decoded", pa.array(texts, pa.string()))

    return mapped(encoded, run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def piece_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, exact) of docs (doc_id, text): whole texts encoded and decoded again.

    ids_crc32 is over the ids as little-endian unsigned 32-bit integers, exact
    says whether decoding gave the text back (for a null text: the empty one).
    """
    shipped(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for rows, offsets, data in slices(batch, "text", SLICE):
                ids, sizes = m.encode([t or "" for t in rows.column("text").to_pylist()])
                flat, ends = ids.astype("<u4"), np.cumsum(sizes)
                texts, raw, cuts = m.decode(ids, sizes), data.tobytes(), offsets.tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id"),
                        pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(flat[e - n : e]) for e, n in zip(ends, sizes, strict=True)], pa.int64()),
                        pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                        pa.array([t == raw[a:b] for t, a, b in zip(texts, cuts[:-1], cuts[1:], strict=True)]),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "exact"],
                )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(docs, run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, exact boolean")
