"""Dense positions over an ordered DataFrame without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.workers import scratch


def settled(df: DataFrame) -> DataFrame:
    """df computed once, so that two branches see the same rows in the same partitions: checkpointed in the shared folder."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(scratch(spark))  # of a local session only
    return df.checkpoint()


def with_positions(df: DataFrame, *keys: str | Column, name: str = "pos", parts: int | None = None) -> DataFrame:
    """df with its row numbers from 0 in order of keys: ranges are counted apart, then shifted by the counts before them.

    Only one row for each range meets in one task and is broadcast; ties are
    in no particular order.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    out = ranged.withColumn("_local", local).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_base") + F.col("_local") - 1).drop("_part", "_local", "_base")


def running_total(df: DataFrame, pos: str, value: str, name: str = "total", block: int = 4096) -> DataFrame:
    """df (dense pos, value) with the sum of value up to and with each row: totals of blocks of positions, then sums inside."""
    b = F.floor(F.col(pos) / block)
    blocks = df.groupBy(b.alias("_block")).agg(F.sum(value).alias("_n"))
    before = blocks.select("_block", (F.sum("_n").over(Window.orderBy("_block")) - F.col("_n")).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy("_block").orderBy(pos))
    out = df.withColumn("_block", b).withColumn("_inner", inner).join(before, "_block")
    return out.withColumn(name, F.col("_base") + F.col("_inner")).drop("_block", "_inner", "_base")


def find_sum(df: DataFrame, pos: str, value: str, target: float, strict: bool = True) -> DataFrame:
    """The first row whose running total is over target (or reaches it, if not strict)."""
    total = F.col("total")
    return running_total(df, pos, value).where(total > target if strict else total >= target).orderBy(pos).limit(1)
