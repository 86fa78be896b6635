"""Sources: the Parquet tables of a folder, and compile_commands.json as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a data folder.
NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = NAMES) -> None:
    """Temporary views of a folder's tables."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def compile_commands(spark: SparkSession, path: str) -> DataFrame:
    """(directory, command, file) of a compile_commands.json array; a missing key is an empty string."""
    rows = spark.read.option("multiLine", True).schema("directory string, command string, file string").json(path)
    return rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in rows.columns))
