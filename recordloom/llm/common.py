"""Shared folder handling and small Arrow helpers for the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space as the contracts name it: space and \t \n \v \f \r.
WHITE = b" \t\n\x0b\x0c\r"
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="recordloom-"))
    return _own_dir[0]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it again: lineage ends there, so a lost
    executor costs a re-read and not a re-computation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recordloom/{name}-{uuid.uuid4().hex}"
    # Nothing runs df again, so its shuffle files may go as soon as the table is there.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)
    tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage once a third of its heap is in use: else finished plans and broadcasts
    stay, and the heap grows to its limit, beside all that the driver needs outside of it."""
    runtime = spark._jvm.Runtime.getRuntime()
    if 3 * (runtime.totalMemory() - runtime.freeMemory()) > runtime.maxMemory():
        spark._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads, and let Spark drop shuffle files nobody refers to."""
    for table in tables:
        spark = table.sparkSession
        for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        spark._jvm.System.gc()


def byte_texts(column: pa.Array) -> list:
    """The UTF-8 bytes of a string column, None for null."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def slices(batches, rows: int = 2000):
    """Cut Arrow batches so that the Python objects made from one stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def settle(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps now, not when the driver happens to collect garbage."""
    import gc

    gc.collect()
    spark._jvm.System.gc()
