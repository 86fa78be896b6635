"""Exact top-k inner products over integer vectors by MaxScore, in shards.

A vector's components are terms and their values impacts. In each shard a term
has an upper bound for a query (its weight times the shard's largest or
smallest value, whichever is more). The terms with the lowest bounds, as long
as these sum to no more than the k-th best score so far, are non-essential: a
vector can't win by them alone. Essential postings are summed for all rows of a
block; the others are only probed where the partial sum and the rest's bound
still reach the k-th best. The shards' best k are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import shipped

SHARD_ROWS = 16384
QUERY_ROWS = 1024
BLOCK_ROWS = 4096


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: in floating point where every sum is below 2**53."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < 2**53 else a @ b.T


def maxscore(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of each query's k best rows of a shard, ties to the smaller id."""
    n = len(queries)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * n
    floor = np.full(n, np.iinfo(np.int64).min)

    def offer(q: int, score: np.ndarray, at: np.ndarray) -> None:
        at = at[ids[at] != query_ids[q]] if len(at) else at
        s, i = np.concatenate((best[q][0], score[: len(at)])), np.concatenate((best[q][1], ids[at]))
        order = np.lexsort((i, -s))[:k]
        best[q] = (s[order], i[order])
        if len(order) == k:
            floor[q] = s[order[-1]]

    # the largest contribution of each term to each query
    bound = np.maximum(queries * rows.max(axis=0), queries * rows.min(axis=0))
    order = np.argsort(bound, axis=1, kind="stable")
    rising = np.cumsum(np.take_along_axis(bound, order, axis=1), axis=1)
    for start in range(0, len(rows), BLOCK_ROWS):
        block = rows[start : start + BLOCK_ROWS]
        essential = np.ones(queries.shape, bool)
        # a prefix of the rising bounds whose sums stay at or below the floor, and no later sum matters
        free = np.logical_and.accumulate(rising < floor[:, None], axis=1)
        np.put_along_axis(essential, order, ~free, axis=1)
        rest = np.where(essential, 0, bound).sum(axis=1)
        partial = _dot(np.where(essential, queries, 0), block)
        alive = partial + rest[:, None] >= floor[:, None]
        alive &= ids[None, start : start + len(block)] != query_ids[:, None]
        for q in range(n):
            at = np.flatnonzero(alive[q])
            if not len(at):
                continue
            score = partial[q, at]
            if rest[q] or not essential[q].all():
                score = score + block[at][:, ~essential[q]] @ queries[q, ~essential[q]]
            offer(q, score, at + start)
    return [(int(query_ids[q]), int(i), int(s)) for q in range(n) for s, i in zip(*best[q], strict=True)]


def top_k_search(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows of vectors (vec_id, embedding).

    Components become floor(scale * x). Queries are the rows whose vec_id is
    divisible by `every`; a row with the query's vec_id is never its result.
    Vectors that are null or hold a null or non-finite component, or have no
    vec_id, take no part; missing components of shorter vectors count as 0.
    Repeated rows are candidates each; of repeated queries the smallest vector
    asks. Scores must fit into 64 bits.
    """
    spark = shipped(vectors.sparkSession)
    x = F.col("embedding")
    fine = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    whole = vectors.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale)).alias("v")
    )
    asked = whole.where(F.col("vec_id") % every == 0)
    n, width = whole.agg(F.count("*"), F.max(F.size("v"))).first()
    shards = max(1, -(-n // SHARD_ROWS))
    blocks = max(1, -(-n // every // QUERY_ROWS))
    h = F.xxhash64("vec_id")
    rows = whole.withColumn("shard", F.pmod(h, F.lit(shards)).cast("int"))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("block", F.pmod(h, F.lit(blocks)).cast("int"))
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    width = width or 0

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            found = maxscore(
                _matrix(left["v"], width), np.asarray(left["vec_id"]), _matrix(right["v"], width), np.asarray(right["vec_id"]), k
            )
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["shard", "block"]
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
