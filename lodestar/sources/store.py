"""Small texts and sets of tables in any folder that Spark can reach, replaced as a whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode())


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Replaces the file in one step: readers see the old content or the new one."""
    fs, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(content))
    stream.close()
    jvm = spark._jvm
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, where, options)


def write_json(spark: SparkSession, path: str, value) -> None:
    write_text(spark, path, json.dumps(value, indent=2, default=str, sort_keys=True))


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def write_tables(spark: SparkSession, path: str, tables: dict[str, DataFrame], partitions: dict[str, str] | None = None, **facts) -> None:
    """All tables as one new version, which a line in ``CURRENT`` then makes the one that is read; facts go along."""
    version = f"v-{uuid.uuid4().hex}"
    for name, table in tables.items():
        writer = table.write
        if by := (partitions or {}).get(name):
            writer = writer.partitionBy(by)
        writer.parquet(f"{path}/{version}/{name}")
    write_json(spark, f"{path}/CURRENT", {"version": version, "tables": {n: t.schema.json() for n, t in tables.items()}, **facts})


def read_tables(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables of the newest version, and its facts."""
    from pyspark.sql.types import StructType

    now = read_json(spark, f"{path}/CURRENT")
    read = lambda name, schema: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{path}/{now['version']}/{name}")
    return {n: read(n, s) for n, s in now["tables"].items()}, {k: v for k, v in now.items() if k not in ("version", "tables")}
