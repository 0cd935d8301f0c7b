"""Size-tiered compaction of immutable shards under a versioned manifest, with DataFrame reads and writes only."""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import scratch, table

#: Bytes that merged files aim at, rows of an arriving shard at most, files of a tier that make it due for merging.
TARGET_BYTES, SHARD_ROWS, FANOUT = 128 << 20, 2_000, 4


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """Rows in immutable Parquet files, listed by the manifest of each version.

    The manifest holds a line for each file and the number of rows, no data; its newest version is the store. A commit
    renames a finished manifest to the next version's name, which fails if that name is taken, so that of two writers one
    wins and readers see all of a version or none. Lost executors cost their tasks alone: files of failed attempts are in
    no manifest. Rows may repeat and hold nulls in any column; columns may have any names.
    """

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target, fanout
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def version(self) -> int:
        """The newest version, 0 for an empty store."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")], default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "schema": None, "rows": 0, "files": []}
        stream = self._fs.open(self._path(f"{self.root}/manifests/v{version:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, schema: str, files: list[dict], rows: int = 0) -> int:
        """Makes ``files`` version base + 1; Conflict if that version exists."""
        new = base + 1
        draft = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": new, "schema": schema, "rows": rows, "files": files}).encode()))
        stream.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        try:
            context.rename(draft, self._path(f"{self.root}/manifests/v{new:08d}.json"), options)
        except Exception as e:
            self._fs.delete(draft, False)
            raise Conflict(f"version {new} exists") from e
        return new

    def _write(self, df: DataFrame, rows: int = 0) -> list[dict]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows).parquet(folder)
        found = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().endswith(".parquet")]
        return [{"path": s.getPath().toString(), "bytes": s.getLen(), "tier": self.tier(s.getLen())} for s in found]

    def _read(self, session: SparkSession, schema: str, files: list[dict]) -> DataFrame:
        return session.read.schema(StructType.fromJson(json.loads(schema))).parquet(*[f["path"] for f in files])

    def tier(self, size: int) -> int:
        """0 for files over half of the target, no two of which fit one file; each tier above is a fan-out smaller."""
        return 0 if 2 * size > self.target else 1 + math.floor(math.log(self.target / (2 * max(size, 1)), self.fanout))

    def append(self, df: DataFrame) -> int:
        """Adds an arrival as small shards of SHARD_ROWS rows at most, without a shuffle; an empty one is one empty shard.

        ValueError if its columns are not those of the store, by name, type and order.
        """
        now = self.manifest()
        columns = lambda schema: [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if now["schema"] and (held := columns(StructType.fromJson(json.loads(now["schema"])))) != columns(df.schema):
            raise ValueError(f"the store's columns are {held}, the arrival's {columns(df.schema)}")
        schema = now["schema"] or df.schema.json()
        new = self._write(df, SHARD_ROWS)
        # Files' footers hold their numbers of rows, so counting reads no data.
        return self.commit(now["version"], schema, now["files"] + new, now["rows"] + self._read(self.spark, schema, new).count())

    def due(self, files: list[dict]) -> list[dict]:
        """Files of one merge: those of the tier of the smallest files that has ``fanout`` files or more; none is due in tier 0."""
        tiers: dict[int, list[dict]] = {}
        for f in files:
            tiers.setdefault(f["tier"], []).append(f)
        return next((tiers[t] for t in sorted(tiers, reverse=True) if t > 0 and len(tiers[t]) >= self.fanout), [])

    def compact(self) -> int:
        """Merges one due tier after another, each in one scan and write without a shuffle, until none is due; the newest version.

        Spark's own packing of splits forms the merged files: each task takes files up to the target's size. That is set
        in a session of its own, so that no other query's scans change.
        """
        packing = self.spark.newSession()
        for key, value in {"maxPartitionBytes": str(self.target), "openCostInBytes": "0", "minPartitionNum": "1"}.items():
            packing.conf.set(f"spark.sql.files.{key}", value)
        while True:
            now = self.manifest()
            due = self.due(now["files"])
            if not due:
                return now["version"]
            gone = {d["path"] for d in due}
            merged = self._write(self._read(packing, now["schema"], due))
            if self._read(self.spark, now["schema"], merged).count() != self._read(self.spark, now["schema"], due).count():
                raise RuntimeError("a merge does not hold the rows of its files")
            if len(merged) >= len(due):  # packing can't make these fewer: they count as of full size
                merged = [m | {"tier": 0} for m in merged]
            self.commit(now["version"], now["schema"], [f for f in now["files"] if f["path"] not in gone] + merged, now["rows"])

    def vacuum(self, grace: float = 86_400.0) -> None:
        """Deletes shards that the newest version doesn't list; readers of older versions must be done.

        Shards of no version, left by writers that lost their race or died, go once they are ``grace`` seconds old.
        """
        live = {f["path"] for f in self.manifest()["files"]}
        old = set()
        for version in range(1, self.version()):
            if self._fs.exists(self._path(f"{self.root}/manifests/v{version:08d}.json")):
                old |= {f["path"] for f in self.manifest(version)["files"]} - live
        stray = []
        listed = self._fs.listFiles(self._path(f"{self.root}/shards"), True)
        while listed.hasNext():
            status = listed.next()
            path = status.getPath().toString()
            if path.endswith(".parquet") and path not in live and path not in old and status.getModificationTime() / 1000 <= time.time() - grace:
                stray.append(path)
        for path in [*old, *stray]:
            self._fs.delete(self._path(path), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, each once for each time that it was appended."""
        found = self.manifest(version)
        if not found["files"]:
            raise ValueError("the store is empty")
        return self._read(self.spark, found["schema"], found["files"])


#: Arrivals that the query cuts the table into at most; each takes whole files of it.
ARRIVALS = 4


def op2(spark, sf_dir: str) -> DataFrame:
    """All documents arrive, a few files at a time, as small shards, are compacted, and are read back under the last manifest.

    ``store_rows`` is the number of rows that the manifest states.
    """
    docs = table(spark, sf_dir, "documents")
    files = sorted(docs.inputFiles())
    store = ShardStore(spark, scratch(spark, "store"))
    step = max(1, -(-len(files) // ARRIVALS))
    for at in range(0, len(files), step):
        store.append(spark.read.schema(docs.schema).parquet(*files[at : at + step]))
    store.compact()
    store.vacuum()
    rows = store.manifest()["rows"]
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"), F.lit(rows).cast("long").alias("store_rows"))


OP2_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, CAST(count(*) OVER () AS BIGINT) AS store_rows FROM documents"
