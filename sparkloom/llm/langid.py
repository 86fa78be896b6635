"""Language identification, words first.

A word that the model knows counts by its log frequency in each language. An
unseen word backs off to its longest character n-grams that the model knows,
from five code points down to one, edges of the word included.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import mapped, shipped
from ._text import runs, slices, span_hashes
from .quality import held_out

LONGEST = 5
SAMPLE = 1000  # documents of each language that the model learns from, at most
SMOOTHING = 0.5
UNSEEN = 0.5  # weight of an unseen word's n-grams against a known word


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], bool)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of a slice of UTF-8, and its words (runs of letters): starts, ends, words per row."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=at[1:])
    return points, *runs(_letters()[points], at[offsets])


def _ngrams(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words copied side by side with a space at either edge: code points, where each begins, where it ends."""
    size = ends - starts + 2
    stop = np.cumsum(size)
    begin = stop - size
    out = np.full(int(stop[-1]) if len(stop) else 0, 32, np.uint32)
    within = np.arange(len(out)) - np.repeat(begin, size)
    inner = (within > 0) & (within < np.repeat(size, size) - 1)
    out[inner] = points[(np.repeat(starts, size) + within - 1)[inner]]
    return out, begin, stop


def _grams_of(flat: np.ndarray, begin: np.ndarray, stop: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams within the words, and the word of each."""
    count = np.maximum(0, stop - begin - n + 1)
    word = np.repeat(np.arange(len(begin)), count)
    first = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + begin[word]
    return span_hashes(flat, first, first + n), word


@dataclass
class Table:
    """Log frequencies of hashed terms: rows in order of hash, a column for each language."""

    key: np.ndarray
    log: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.key):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return at, self.key[at] == h


@dataclass
class Model:
    langs: list[str]
    tables: list[Table]  # words, then n-grams of 1 to LONGEST

    def totals(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Summed log frequencies: a row for each text, a column for each language."""
        points, starts, ends, per_row = _words(data, offsets)
        row = np.repeat(np.arange(len(per_row)), per_row)
        h = span_hashes(points, starts, ends)
        at, known = self.tables[0].find(h)
        out = np.zeros((len(per_row), len(self.langs)))

        def add(rows, values):
            for k in range(len(self.langs)):
                out[:, k] += np.bincount(rows, values[:, k], len(per_row))

        if known.any():
            add(row[known], self.tables[0].log[at[known]])
        rest = np.flatnonzero(~known)
        if len(rest):
            _, first, back = np.unique(h[rest], return_index=True, return_inverse=True)
            one = rest[first]
            add(row[rest], UNSEEN * self._backoff(points, starts[one], ends[one])[back])
        return out

    def _backoff(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), len(self.langs)))
        todo = np.arange(len(starts))
        for n in range(LONGEST, 0, -1):
            if not len(todo):
                break
            h, word = _grams_of(*_ngrams(points, starts[todo], ends[todo]), n)
            at, known = self.tables[n].find(h)
            if known.any():
                word, log = word[known], self.tables[n].log[at[known]]
                hits = np.bincount(word, minlength=len(todo))
                for k in range(len(self.langs)):
                    out[todo, k] += np.bincount(word, log[:, k], len(todo)) / np.maximum(1, hits)
                todo = todo[hits == 0]
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, hash, count): kind 0 for words, n for n-grams."""
    for batch in batches:
        batch = batch.set_column(0, "text", pc.utf8_lower(batch.column("text").fill_null("")))
        for rows, offsets, data in slices(batch, "text"):
            langs = rows.column("lang").to_pylist()
            points, starts, ends, per_row = _words(data, offsets)
            owner = np.repeat(np.arange(len(per_row)), per_row)
            for lang in sorted(set(langs)):
                mine = np.array([x == lang for x in langs])[owner]
                s, e = starts[mine], ends[mine]
                flat = _ngrams(points, s, e)
                for kind in range(LONGEST + 1):
                    h = _grams_of(*flat, kind)[0] if kind else span_hashes(points, s, e)
                    h, c = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(h), pa.string()), pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(c)],
                        ["lang", "kind", "hash", "n"],
                    )


def train_langid(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from text and lang of at most `sample` documents of each language: those with the lowest hash of doc_id that aren't held out.

    A language's count says which hashes are low enough to be among the first
    (twice as many ids as asked for are expected there), so no task meets all
    ids of a common language. Smoothing counts follow each language's
    total, so that a word that no sample of a language holds speaks for no
    language, however few its documents are.
    """
    ids = docs.where("doc_id is not null and lang is not null and text is not null").where(~held_out())
    ids = ids.select("doc_id", "lang").distinct()
    share = F.broadcast(ids.groupBy("lang").agg((F.lit(2.0 * sample) / F.count("*")).alias("_share")))
    ids = ids.join(share, "lang").where(F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5 <= F.col("_share")).drop("_share")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = ids.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= sample).drop("_rank")
    rows = docs.join(F.broadcast(ids), ["doc_id", "lang"]).select("text", "lang")
    found = mapped(rows, _counts, "lang string, kind int, hash long, n long").groupBy("lang", "kind", "hash")
    found = found.agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    lang = np.searchsorted(np.array(langs or [""]), np.array(found["lang"].to_pylist() or [], dtype=str)) if langs else np.zeros(0, np.int64)
    kind, h, n = (np.asarray(found[x]) for x in ("kind", "hash", "n"))
    tables = []
    for k in range(LONGEST + 1):
        mine = kind == k
        key, at = np.unique(h[mine].astype(np.int64).view(np.uint64), return_inverse=True)
        count = np.zeros((len(key), len(langs)))
        np.add.at(count, (at, lang[mine]), n[mine])
        total = count.sum(axis=0)
        count += SMOOTHING * np.maximum(total, 1) / max(1, total.max(initial=0))
        tables.append(Table(key, np.log(count / count.sum(axis=0)) if len(key) else count))
    return Model(langs, tables)


def language_id(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row of docs (doc_id, text, lang).

    lang only teaches; a prediction reads text alone. lang_pred is `und` with
    score 0 where text is null or has no letter, or where nothing was learnt.
    Ties go to the language that sorts first; repeated rows stay.
    """
    spark = shipped(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    shared = spark.sparkContext.broadcast(model or train_langid(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            batch = batch.set_column(1, "text", pc.utf8_lower(batch.column("text").fill_null("")))
            for rows, offsets, data in slices(batch, "text"):
                if m.langs:
                    total = m.totals(data, offsets)
                    best = total.argmax(axis=1)
                    share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                points, starts, _, per_row = _words(data, offsets)
                lang = [m.langs[best[i]] if m.langs and per_row[i] else "und" for i in range(rows.num_rows)]
                score = [float(share[i]) if x != "und" else 0.0 for i, x in enumerate(lang)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    out = mapped(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
