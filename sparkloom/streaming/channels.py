"""Channels of rows on Structured Streaming.

A channel is a folder: pushing writes files, popping reads them as a stream,
max_files bounds what one step takes. Results go to named in-memory tables (for
tests and small states) or to Parquet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def push(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def pop(spark: SparkSession, path: str, schema, max_files: int | None = None, only: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if only:
        reader = reader.option("pathGlobFilter", only)
    return reader.parquet(path)


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Run the stream over all there is and return the result table."""
    name = f"channel_{uuid.uuid4().hex}"
    run = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return stream.sparkSession.table(name)


def running_sum(stream: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, n, total) so far."""
    total = F.round(F.sum(value), 2).alias("total")
    return stream.groupBy(*keys).agg(F.count("*").alias("n"), total)


def windowed(stream: DataFrame, time: str, width: str, late: str, *keys: str, value: str) -> DataFrame:
    """(keys, start, n, total) of tumbling windows, closed once the watermark has passed them."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *keys)
    out = grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 2).alias("total"))
    return out.select(*keys, F.col("w.start").alias("start"), "n", "total")


def call(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Answer each step of a request channel through handler into another channel, exactly once by step."""

    def step(df: DataFrame, number: int) -> None:
        handler(df).write.mode("overwrite").parquet(f"{path}/step={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def as_message(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
