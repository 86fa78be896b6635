"""Tables written to the cluster's shared folder, to cut lineage between passes."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..sources.workers import scratch, shipped

__all__ = ["dropped", "mapped", "settled", "shared_dir", "shipped", "trimmed", "written"]

def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, a folder that all machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return scratch(spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it again with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files behind tables made by written(), once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema); at a task's end its Python worker, which Spark uses again, gives freed memory back."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trimmed()

    return df.mapInArrow(task, schema)


def settled(spark: SparkSession) -> None:
    """Between jobs: the driver gives freed memory back, and Spark's cleaner frees shuffles and broadcasts that nothing refers to."""
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    commands = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer().invoke(commands, "systemTrimNativeHeap", None, None)
    except Py4JError:  # a JVM without that command
        pass
    trimmed()


def trimmed() -> None:
    """Give memory that this process has freed back to the system, where its C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
