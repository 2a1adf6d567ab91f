"""Derived tables, built once for each version of their sources and read by every later query.

A derived table lies in the shared folder under its name and its version; a new version of a source is a new folder, and
an old one is never written again. A build writes beside its final place and moves there when it is complete, so a
reader sees a whole table or none, and two builders of one version do no harm.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; on a local master, where it is unset, a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="recordloom-"))
    return _own_dir[0]


def version_of(*sources: DataFrame) -> str:
    """Names the state of the files that the sources read: their paths, sizes and times. Tables that keep versions of
    their own pass those instead."""
    digest = hashlib.sha256()
    for source in sources:
        spark = source.sparkSession
        conf = spark._jsc.hadoopConfiguration()
        for folder in sorted({f.rsplit("/", 1)[0] for f in source.inputFiles()}):
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            for s in path.getFileSystem(conf).listStatus(path):
                digest.update(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()};".encode())
    return digest.hexdigest()[:24]


def derived(spark: SparkSession, name: str, version: str, build: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """The derived table `name` of this version, built if it is not there; `by` names columns for folders."""
    path = f"{shared_dir(spark)}/recordloom-derived/{name}/{version}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop(path)):
        made = f"{path}.{uuid.uuid4().hex}"
        # A task writes its folders beside each other: nothing is sorted for the sake of the folders alone. A worker gets
        # rows by bytes: long rows by the thousand would need more memory the larger the table is.
        wanted = {"spark.sql.maxConcurrentOutputFileWriters": "64", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}
        before = {key: spark.conf.get(key) for key in wanted}
        try:
            for key, value in wanted.items():
                spark.conf.set(key, value)
            build().write.partitionBy(*by).option("compression", "zstd").parquet(made)
        finally:
            for key, value in before.items():
                spark.conf.set(key, value)
        if not fs.rename(hadoop(made), hadoop(path)) or fs.exists(hadoop(f"{path}/{made.rsplit('/', 1)[1]}")):
            fs.delete(hadoop(made), True)  # another builder was first
            fs.delete(hadoop(f"{path}/{made.rsplit('/', 1)[1]}"), True)
    return spark.read.parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a table in the shared folder: lineage ends there, and a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/recordloom-staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, name: str, keep: str | None = None) -> None:
    """Delete a derived table's versions, but for the one to keep."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(f"{shared_dir(spark)}/recordloom-derived/{name}")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder) if fs.exists(folder) else []:
        if s.getPath().getName() != keep:
            fs.delete(s.getPath(), True)


def spread(rows: DataFrame) -> DataFrame:
    """The same rows, dealt out over all cores where less than half of those would have any (one file's text would
    otherwise be read and cut in one task). Dealing out shuffles whole texts, so more than that is read where it lies."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if 2 * len(rows.inputFiles()) >= cores:
        return rows
    return rows.repartition(2 * cores) if 2 * rows.select(F.spark_partition_id().alias("part")).distinct().count() < cores else rows
