"""Helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words wherever a contract says ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module) -> None:
    """Send a module's functions to the workers by value, so that they need not be installed there."""
    cloudpickle.register_pickle_by_value(module)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, a temporary one in local mode (tests), else a ValueError."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        found = context.getCheckpointDir()
        if not found:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestar-"))
            found = context.getCheckpointDir()
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter
        pass


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the interpreter ends."""
    path = f"{shared_dir(spark)}/lodestar-{uuid.uuid4().hex}/{name}"
    atexit.register(remove, spark, path.rpartition("/")[0])
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files that a stored table consists of."""
    spark = df.sparkSession
    total = 0
    for file in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def small(df: DataFrame, limit: int) -> DataFrame:
    """Marks a stored table for broadcast if its files hold no more than ``limit`` bytes; else Spark shuffles."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Arrow batches of that many rows for the session, unless it has a setting other than Spark's: 10,000 whole texts take some 18 MB each in the JVM's buffers and in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)
