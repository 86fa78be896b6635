"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are hashed indicators: its words, and runs of one to four
word shapes with a note of which neighbours are equal. Each indicator is scaled
by the log ratio of its smoothed class counts, and a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import mapped, shipped
from ._text import ASCII_LOWER, SPACES, mixed, runs, slices, span_hashes

BITS = 18
SAMPLE = 4000  # labelled rows that the classifier is fitted on, at most
SLICE = 1 << 19  # bytes of text looked at together; a worker's peak follows it


def _shapes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A code for each word: which kinds of bytes it holds, where, and its last byte if that is ASCII punctuation."""
    upper = (data >= 65) & (data <= 90)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    digit = (data >= 48) & (data <= 57)

    def within(mask):
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=total[1:])
        return total[ends] - total[starts]

    size, letters, uppers, digits = ends - starts, within(letter), within(upper), within(digit)
    others = size - letters - digits
    last = data[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    tail = np.where(letter[ends - 1] | digit[ends - 1], np.uint64(0), last) if len(ends) else last
    code = np.where(letters == 0, 0, np.where(uppers == 0, 1, np.where(uppers == letters, 2, 3)))
    code = code * 3 + np.where(digits == 0, 0, np.where(digits == size, 2, 1))
    code = code * 5 + np.minimum(others, 4)
    code = code * 4 + np.digitize(size, (4, 12, 30))
    return code.astype(np.uint64) * np.uint64(256) + tail


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The distinct hashed indicators of each row, sorted."""
    starts, ends, per_row = runs(~SPACES[data], offsets)
    shape = _shapes(data, starts, ends)
    word = span_hashes(ASCII_LOWER[data], starts, ends)
    row = np.repeat(np.arange(len(per_row)), per_row)
    found, rows = [word ^ np.uint64(0x5851F42D4C957F2D)], [row]
    with np.errstate(over="ignore"):
        gram = shape + np.uint64(1)
        found.append(mixed(gram))
        rows.append(row)
        for n in range(2, 5):
            if len(word) < n:
                break
            m = len(word) - n + 1
            equal = (word[n - 1 :] == word[n - 2 : n - 2 + m]).astype(np.uint64)
            gram = (gram[:m] * np.uint64(0xD6E8FEB86659FD93) + shape[n - 1 :]) * np.uint64(2) + equal
            inside = row[:m] == row[n - 1 :]
            found.append(mixed(gram + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15))[inside])
            rows.append(row[:m][inside])
    index = (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64)
    both = (np.concatenate(rows) << BITS) | index
    both.sort()
    if len(both):
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
    cuts = np.searchsorted(both, np.arange(len(per_row) + 1) << BITS)
    index = both & ((1 << BITS) - 1)
    return [index[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    middle: float

    def scores(self, found: list[np.ndarray]) -> list[float]:
        out = []
        for f in found:
            margin = float(self.weight[f].sum()) / math.sqrt(len(f) + 1) + self.bias
            z = self.slope * (margin - self.middle)
            out.append(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))))
        return out


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the squared hinge loss; rows are scaled to unit order by the root of their size."""
    weight, bias = np.zeros(len(ratio)), 0.0
    values = [ratio[r] / math.sqrt(len(r) + 1) for r in rows]
    diagonal = 0.5 / cost
    square = np.array([float(v @ v) + 1.0 for v in values]) + diagonal
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (float(weight[r] @ v) + bias) - 1 + diagonal[i] * alpha[i]
            new = max(0.0, alpha[i] - gradient / square[i])
            step = (new - alpha[i]) * y[i]
            if step:
                weight[r] += step * v
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return weight * ratio, bias


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """labels are 0 or 1; a sample without both classes gives a constant model of its one class (0.5 if empty)."""
    good = labels.astype(bool)
    if not len(rows) or good.all() or not good.any():
        level = 0.5 if not len(rows) else (1.0 if good.all() else -1.0)
        return Model(np.zeros(1 << BITS), 0.0, 4.0, {0.5: 0.0, 1.0: -1.0, -1.0: 1.0}[level])
    counts = np.ones((2, 1 << BITS)) * 0.5
    for r, g in zip(rows, good, strict=True):
        counts[int(g), r] += 1
    p = counts / (np.array([[(~good).sum()], [good.sum()]]) + 1.0)
    ratio = np.log(p[1] / p[0])
    y = np.where(good, 1.0, -1.0)
    cost = np.where(good, len(good) / (2 * good.sum()), len(good) / (2 * (~good).sum()))
    part = np.arange(len(rows)) % 5 == 4  # a fifth, in the sample's order, only places the score's middle and slope
    if not (good[part].any() and (~good[part]).any() and good[~part].any() and (~good[~part]).any()):
        part[:] = False
    weight, bias = _descend([r for r, x in zip(rows, part, strict=True) if not x], y[~part], ratio, cost[~part])
    probe = part if part.any() else ~part
    margin = np.array([float(weight[r].sum()) / math.sqrt(len(r) + 1) + bias for r, x in zip(rows, probe, strict=True) if x])
    # the middle is the best cut, in the middle of its gap; 0.7 on the score's scale
    order = np.argsort(margin)
    m, g = margin[order], good[probe][order]
    share = len(g) / 2
    right = np.concatenate(([0], np.cumsum(~g))) / max(1, (~g).sum()) * share + (g.sum() - np.concatenate(([0], np.cumsum(g)))) / max(1, g.sum()) * share
    best = np.flatnonzero(right >= right.max() - 1e-9)
    k = int(best[len(best) // 2])
    low = m[k - 1] if k else m[0] - 1
    high = m[k] if k < len(m) else m[-1] + 1
    spread = max(1e-3, float(margin.std()))
    slope = 4 / spread
    return Model(weight, bias, slope, float((low + high) / 2) - math.log(0.7 / 0.3) / slope)


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, offsets, data in slices(batch, "text", SLICE):
            packed = [f.astype(np.int32).tobytes() for f in features(data, offsets)]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("quality"), pa.array(packed, pa.binary())], ["doc_id", "quality", "found"]
            )


def held_out() -> F.Column:
    """Is a document kept from learning? Its crc32 of doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` labelled documents, those with the lowest hash of doc_id among the rows not held out.

    Rows without doc_id or quality teach nothing; of repeated labels of one
    document the highest counts.
    """
    picked = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    picked = picked.agg(F.max("quality").cast("int").alias("quality")).where(~held_out())
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null")
    picked = picked.join(known, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    found = mapped(rows, _indicators, "doc_id long, quality int, found binary").toArrow()
    found = found.sort_by("doc_id")
    ids = np.asarray(found["doc_id"])
    once = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
    order = np.argsort(mixed(ids[once].astype(np.int64).view(np.uint64)), kind="stable")
    packed = found["found"].to_pylist()
    features_of = [np.frombuffer(packed[once[i]], np.int32).astype(np.int64) for i in order]
    return fit(features_of, np.asarray(found["quality"])[once][order])


def quality_scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.7) added; a null or empty text is scored by the bias alone."""
    spark = shipped(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, offsets, data in slices(batch, "text", SLICE):
                score = shared.value.scores(features(data, offsets))
                rows = rows.append_column("score", pa.array(score, pa.float64()))
                yield rows.append_column("predicted", pa.array([int(s >= 0.7) for s in score], pa.int32()))

    plain = docs.drop("score", "predicted")
    schema = T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return mapped(plain, run, schema)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs (doc_id, text), learnt from labels (doc_id, quality).

    Only doc_id and text of docs are read, and only text is scored. Rows stay
    as they are repeated; without usable labels every score is 0.5.
    """
    shipped(docs.sparkSession)
    model = train_quality(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = quality_scores(rows, model).drop("text")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")
