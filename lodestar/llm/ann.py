"""Approximate nearest neighbours by collision counting over query-centred windows of sorted projections."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ann_worker
from .common import ship, table

ship(ann_worker)

#: Vectors of a shard, which one task indexes at a time (8,192 x 64 doubles are 4 MB, their 80 projections 10 MB), and
#: bytes of the queries that are broadcast together.
SHARD, BLOCK_BYTES = 8_192, 32 << 20


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null or non-finite component, not all zero."""
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(sound, F.lit(False)) & F.exists(v, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 80, threshold: float = 0.6, extra: float = 0.3, seed: int = 7) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k vectors of largest cosine found for each query, nearest first.

    Both tables have ``vec_id`` (long) and ``embedding`` (array of floats or doubles); other columns are ignored. Rows
    without a usable vector or id take no part, vectors are compared with those of their own length only, a query never
    finds rows of its own id, and equal rows of queries are answered once. Repeated rows of vectors each take a rank;
    equal scores go by the smaller id. Vectors are indexed where they are read, in shards of SHARD rows, and never move:
    a shard is m sorted arrays, one a projection. Queries, a stated set, are broadcast in blocks of BLOCK_BYTES, with one
    pass over the vectors a block. Each shard gives its own k nearest of a query, which alone are shuffled, and the best k
    of all are kept. So a task's memory is the same at every size, and repeated rows make no hot key. Nothing is fitted.
    """
    def sound(df: DataFrame) -> DataFrame:
        v = F.col("embedding").cast("array<double>")
        return df.where(F.col("vec_id").isNotNull() & usable(v)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))

    spark = vectors.sparkSession
    schema = "query_row long, query_id long, vec_id long, score double"
    rows, found = sound(vectors), spark.createDataFrame([], schema)
    for block in _blocks(sound(queries).dropDuplicates().toLocalIterator()):
        sent = spark.sparkContext.broadcast(block)
        found = found.unionByName(rows.mapInArrow(ann_worker.search_batches(sent, SHARD, k, m, threshold, extra, seed), schema))
    order = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(asked):
    """Queries by length of vector, {length: (numbers, ids, vectors)}, of BLOCK_BYTES together; the driver holds one block at a time."""
    held: dict[int, list] = {}
    size = 0

    def block():
        return {dim: (np.array([r[0] for r in some]), np.array([r[1] for r in some]), np.array([r[2] for r in some])) for dim, some in held.items()}

    for number, r in enumerate(asked):
        held.setdefault(len(r["v"]), []).append((number, r["vec_id"], r["v"]))
        size += 8 * len(r["v"])
        if size >= BLOCK_BYTES:
            yield block()
            held, size = {}, 0
    if held:
        yield block()


def op1(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"))
