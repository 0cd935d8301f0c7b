"""Vector functions as native column expressions, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stage import chunked


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero; an error if their lengths differ."""
    sized = F.assert_true(F.size(a) == F.size(b), "vectors differ in length")
    scale = norm(a) * norm(b)
    return F.when(sized.isNotNull(), F.lit(None)).when(scale == 0, 0.0).otherwise(dot(a, b) / scale)


def normalised(v: Column) -> Column:
    size = norm(v)
    return F.transform(doubles(v), lambda x: F.when(size > 0, x / size).otherwise(x))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def with_following(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` with ``following``: the value of the next row by ``key``, of the row itself after the last.

    The order is cut into ranges; the end of each meets the start of the next by a table of one row a range, so no task
    holds the whole order, and gaps between keys don't matter.
    """
    cut = chunked(rows, key)
    heads = cut.groupBy("chunk").agg(F.min_by(F.struct(value), key).alias("head"))
    heads = heads.select("chunk", F.lead("head").over(Window.orderBy("chunk")).alias("next_head"))  # a row a range
    after = F.lead(F.struct(value)).over(Window.partitionBy("chunk").orderBy(key))
    found = cut.withColumn("own_next", after).join(heads, "chunk")
    return found.withColumn("following", F.coalesce("own_next", "next_head", F.struct(value))[value]).drop("chunk", "own_next", "next_head")
