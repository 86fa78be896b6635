"""Rank, select and runs over a sequence (pos, symbol) with dense positions.

Plans have two levels: counts for blocks of positions, then work inside the
blocks that a query touches. What meets in one task grows with the number of
blocks, not of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096

OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda x, s: x == s,
    "neq": lambda x, s: x != s,
    "lt": lambda x, s: x < s,
    "le": lambda x, s: x <= s,
    "gt": lambda x, s: x > s,
    "ge": lambda x, s: x >= s,
}


def _block(pos: Column, block: int) -> Column:
    return F.floor(pos / block)


def _before(seq: DataFrame, symbols: DataFrame, op: str, block: int) -> DataFrame:
    """(s, b, n, before): matches of each asked symbol in every block, and in all blocks before; one block past the end too."""
    counts = seq.groupBy(_block(F.col("pos"), block).alias("b"), "symbol").agg(F.count("*").alias("n"))
    matched = counts.join(F.broadcast(symbols), OPS[op](F.col("symbol"), F.col("s"))).groupBy("s", "b").agg(F.sum("n").alias("n"))
    spread = counts.select(F.explode(F.array("b", F.col("b") + 1)).alias("b")).distinct()
    grid = spread.withColumn("one", F.lit(1)).join(F.broadcast(symbols.withColumn("one", F.lit(1))), "one").drop("one")
    grid = grid.join(matched, ["s", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return grid.withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("b")) - F.col("n"))


def _symbols(queries: DataFrame) -> DataFrame:
    """The asked symbols: at most the alphabet, which is small by contract."""
    return queries.select(F.col("symbol").alias("s")).distinct()


def rank(seq: DataFrame, queries: DataFrame, op: str = "eq", block: int = BLOCK) -> DataFrame:
    """queries (pos, symbol) with rank: how many positions before pos hold a symbol that compares so."""
    table = _before(seq, _symbols(queries), op, block)
    last = seq.agg((F.max(_block(F.col("pos"), block)) + 1).alias("last"))
    asked = queries.distinct().crossJoin(F.broadcast(last))  # one row
    asked = asked.withColumn("b", F.least(_block(F.col("pos"), block), F.col("last"))).drop("last").withColumnRenamed("symbol", "s")
    asked = asked.join(table.select("s", "b", "before"), ["s", "b"], "left")
    # in a block: its rows and questions in one order, a running count of the matches before each
    rows = seq.select(_block(F.col("pos"), block).alias("b"), "pos", "symbol").crossJoin(F.broadcast(_symbols(queries)))
    rows = rows.select("b", "s", "pos", OPS[op](F.col("symbol"), F.col("s")).cast("int").alias("hit"), F.lit(None).cast("long").alias("before"), F.lit(False).alias("ask"))
    both = rows.unionByName(asked.select("b", "s", "pos", F.lit(0).alias("hit"), "before", F.lit(True).alias("ask")))
    # at one position the question comes first
    upto = Window.partitionBy("s", "b").orderBy("pos", F.desc("ask")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("inner", F.sum("hit").over(upto)).where("ask")
    total = F.coalesce("before", F.lit(0)) + F.coalesce("inner", F.lit(0))
    return out.select("pos", F.col("s").alias("symbol"), total.cast("long").alias("rank"))


def rank_between(seq: DataFrame, start: int, end: int, symbol, op: str = "eq") -> DataFrame:
    inside = (F.col("pos") >= start) & (F.col("pos") < end)
    return seq.where(inside).agg(F.count_if(OPS[op](F.col("symbol"), F.lit(symbol))).alias("rank"))


def ranks(seq: DataFrame, pos: int) -> DataFrame:
    """(symbol, rank) at one position, for all symbols before it."""
    return seq.where(F.col("pos") < pos).groupBy("symbol").agg(F.count("*").alias("rank"))


def select(seq: DataFrame, queries: DataFrame, op: str = "eq", backward: bool = False, block: int = BLOCK) -> DataFrame:
    """queries (symbol, r) with pos: where the r-th match from the front (or back) is, from 0; the sequence's size if there is none."""
    table = _before(seq, _symbols(queries), op, block)
    asked = queries.distinct().withColumnRenamed("symbol", "s")
    if backward:
        totals = table.groupBy("s").agg(F.sum("n").alias("all"))
        asked = asked.join(F.broadcast(totals), "s", "left").withColumn("k", F.col("all") - 1 - F.col("r")).drop("all")
    else:
        asked = asked.withColumn("k", F.col("r"))
    hit = asked.join(table, "s").where("before <= k and k < before + n")
    needed = hit.select("s", "b").distinct()
    rows = seq.select(_block(F.col("pos"), block).alias("b"), "pos", "symbol").join(needed, "b").where(OPS[op](F.col("symbol"), F.col("s")))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("s", "b").orderBy("pos")) - 1).select("s", "b", "i", "pos")
    found = hit.withColumn("i", F.col("k") - F.col("before")).join(rows, ["s", "b", "i"]).select("s", "r", "pos")
    size = seq.agg(F.count("*").alias("size"))
    out = asked.join(found, ["s", "r"], "left").crossJoin(F.broadcast(size))  # one row
    return out.select(F.col("s").alias("symbol"), "r", F.coalesce("pos", "size").cast("long").alias("pos"))


def select_eq_nlt(seq: DataFrame, queries: DataFrame) -> DataFrame:
    """The r-th equal symbol, unless the r-th smaller one comes first."""
    a = select(seq, queries, "eq").withColumnRenamed("pos", "x")
    b = select(seq, queries, "lt").withColumnRenamed("pos", "y")
    return a.join(b, ["symbol", "r"]).select("symbol", "r", F.least("x", "y").alias("pos"))


def runs(seq: DataFrame, block: int = BLOCK) -> DataFrame:
    """(start, len, symbol) of maximal runs: runs inside blocks, joined where they meet at a border."""
    inside = Window.partitionBy("b").orderBy("pos")
    rows = seq.withColumn("b", _block(F.col("pos"), block))
    opens = F.coalesce(F.lag("symbol").over(inside) != F.col("symbol"), F.lit(True)).cast("int")
    rows = rows.withColumn("opens", opens).withColumn("g", F.sum("opens").over(inside))
    local = rows.groupBy("b", "g").agg(F.min("pos").alias("start"), F.count("*").alias("len"), F.first("symbol").alias("symbol"))
    lasts = local.groupBy((F.col("b") + 1).alias("b")).agg(F.max_by("symbol", "start").alias("last"))
    local = local.join(lasts, "b", "left")
    goes_on = (F.col("g") == 1) & F.coalesce(F.col("symbol") == F.col("last"), F.lit(False))
    local = local.withColumn("new", F.when(goes_on, 0).otherwise(1))
    totals = local.groupBy("b").agg(F.sum("new").alias("n"))
    offsets = totals.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))
    numbered = local.join(offsets, "b").withColumn("run", F.col("base") + F.sum("new").over(Window.partitionBy("b").orderBy("g")))
    return numbered.groupBy("run").agg(F.min("start").alias("start"), F.sum("len").alias("len"), F.first("symbol").alias("symbol")).drop("run")


def unpacked(encoded: DataFrame) -> DataFrame:
    """The sequence that runs stand for."""
    at = F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)
    return encoded.select(F.explode(at).alias("pos"), "symbol")


def run_lengths(seq: DataFrame, queries: DataFrame, block: int = BLOCK) -> DataFrame:
    """queries (pos) with symbol, forward and backward: how long the run at pos goes on from there, itself included."""
    spans = runs(seq, block).withColumn("stop", F.col("start") + F.col("len"))
    spans = spans.withColumn("b", F.explode(F.sequence(_block(F.col("start"), block), _block(F.col("stop") - 1, block))))
    asked = queries.select("pos").distinct().withColumn("b", _block(F.col("pos"), block))
    hit = asked.join(spans, "b").where("start <= pos and pos < stop")
    return hit.select("pos", "symbol", (F.col("stop") - F.col("pos")).alias("forward"), (F.col("pos") - F.col("start") + 1).alias("backward"))


def insert(seq: DataFrame, at: int, other: DataFrame, length: int) -> DataFrame:
    mine = seq.withColumn("pos", F.when(F.col("pos") >= at, F.col("pos") + length).otherwise(F.col("pos")))
    return mine.unionByName(other.withColumn("pos", F.col("pos") + at))


def remove(seq: DataFrame, start: int, end: int) -> DataFrame:
    rest = seq.where((F.col("pos") < start) | (F.col("pos") >= end))
    return rest.withColumn("pos", F.when(F.col("pos") >= end, F.col("pos") - (end - start)).otherwise(F.col("pos")))


def popcount(x: Column) -> Column:
    return F.bit_count(x)


def free_runs(bits: DataFrame) -> DataFrame:
    """Of an allocation map (pos, allocated): its free stretches."""
    return runs(bits.select("pos", F.col("allocated").alias("symbol"))).where("not symbol").select("start", "len")


def allocation_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Positions whose state differs, or that only one map has."""
    both = a.withColumnRenamed("allocated", "left").join(b.withColumnRenamed("allocated", "right"), "pos", "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))
