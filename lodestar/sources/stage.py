"""Intermediate tables in the shared folder, where plans are cut that would read their input again and again."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or the context's; where neither is set, a temporary one in local mode, else a ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended before the interpreter
        pass


def remove_at_exit(spark: SparkSession, path: str) -> None:
    atexit.register(_remove, spark, path)


def staged(df: DataFrame, *by: str) -> DataFrame:
    """The rows, written once (partitioned by the columns named) and read from there on; the files go when the interpreter ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/lodestar-stage-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of so many rows at most for what is planned within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a staged table consists of."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def fingerprint(df: DataFrame) -> tuple:
    """Path, time and length of each file that a table consists of: another tuple means other contents."""
    spark = df.sparkSession
    found = []
    for file in sorted(df.inputFiles()):
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        status = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
        found.append((file, status.getModificationTime(), status.getLen()))
    return tuple(found)


def chunked(df: DataFrame, *keys: str) -> DataFrame:
    """The rows, staged, with ``chunk``: ranges of the order by the keys, cut so that no task holds more than a range.

    Chunks are numbered in that order; a hot first key is cut too where a later one tells its rows apart.
    """
    return staged(df.repartitionByRange(*keys).withColumn("chunk", F.spark_partition_id()))
