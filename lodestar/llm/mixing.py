"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small, stored

#: Buckets of the seeded order in each source; only the bucket that a target falls into is ordered row by row.
BUCKETS_HEX = 3
#: Compressed bytes of the buckets' table up to which it is broadcast; beyond it, Spark shuffles both.
BROADCAST_BYTES = 16 << 20


def word_count(text: Column) -> Column:
    """Words of a text, 0 if it is null."""
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))), F.lit(0)).cast("long")


def cycle_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Adds ``weight`` to a table with one row a source: the given ones in turn, by code point, null last."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))


def water_fill(sources: DataFrame, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Targets of the rows ``source, source_size, weight`` (one a source, so a table of a few columns and few rows).

    Filling by weight stops at ``max_epochs`` times a source's size, and what is over goes to the others by weight.
    Sorted by cap / weight, the capped sources come first, so one running sum finds all of them: a source is capped if
    the level that fills it, with all before it full, is within reach. Sizes stay whole numbers up to the one division.
    """
    if share > max_epochs:
        raise ValueError("share must not exceed max_epochs: no mix could reach it")
    by_level = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    full = F.col("before2") + 2 * F.col("cap") * F.col("open") / F.col("weight") <= F.col("total2")
    rows = (
        sources.withColumn("cap", max_epochs * F.col("source_size"))
        .withColumn("total2", F.sum("source_size").over(everything) * F.lit(int(2 * share)) if float(2 * share).is_integer() else F.sum("source_size").over(everything) * F.lit(2 * share))
        .withColumn("before2", F.coalesce(2 * F.sum("cap").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", full)
        .withColumn("rest2", F.col("total2") - F.coalesce(2 * F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0)))
        .withColumn("rest_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything))
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("rest2") / (2 * F.col("rest_weight")))
    return rows.select("source", "source_size", "weight", target.cast("double").alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2, carry: str | None = None) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, copies, taken`` (and ``carry``) for the rows ``doc_id, source, size`` given.

    Each source repeats floor(target / source_size) times whole. The fraction left takes whole documents in a seeded
    order (MD5 of seed and doc_id, then size) up to the one with whose middle the target is passed, so a source's words
    differ from its target by half a document at most. A source's rows never meet in one task: the order is cut into
    4,096 hash buckets, whose sizes are summed before the shuffle, and only the bucket with the cut is ordered.
    Null doc_ids count as the empty string; sizes of 0 are taken no further than whole repetitions; equal rows may
    stand for one another. No rows give no rows.
    """
    more = [carry] if carry else []
    rows = docs.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *more)
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.substring("place", 1, BUCKETS_HEX))
    # Few and narrow rows, one a source and bucket, which three places below read.
    buckets = stored(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "buckets")
    sources = water_fill(cycle_weights(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights), share, max_epochs)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    sources = sources.withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    first = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        buckets.withColumn("before", F.coalesce(F.sum("bucket_size").over(first), F.lit(0)))
        .withColumnRenamed("source", "s")
        .join(sources, F.col("s").eqNullSafe(F.col("source")))
        .withColumn("state", F.when(F.col("before") + F.col("bucket_size") <= F.col("extra"), 1).when(F.col("before") >= F.col("extra"), 0).otherwise(-1))
        .select(F.col("s").alias("s"), F.col("bucket").alias("b"), "before", "state", "source_size", "target", "whole", "extra")
    )
    # One row a source and bucket: 4,096 times the sources at most, whatever the documents are.
    joined = rows.join(small(stored(cut, "cut"), BROADCAST_BYTES), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    inside = Window.partitionBy("source", "bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = joined.where("state = -1").withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    edge = edge.withColumn("more", (F.col("at") + F.col("size") / 2 <= F.col("extra")).cast("long")).drop("at")
    both = edge.unionByName(joined.where("state <> -1").withColumn("more", F.col("state").cast("long")))
    return both.withColumn("copies", F.col("whole") + F.col("more")).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (doc_id, source, text and others), each as often as the mix takes it."""
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.struct("*").alias("row"))
    found = mix(rows, seed, carry="row").where("copies > 0")
    return found.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op8(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, 2 * source_size AS cap,
        [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1] AS weight FROM s),
l AS (SELECT *, CAST(3 * sum(source_size) OVER () AS BIGINT) AS total2,
        CAST(coalesce(2 * sum(cap) OVER before, 0) AS BIGINT) AS before2,
        CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS BIGINT) AS open FROM w
      WINDOW before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, before2 + 2 * cap * open / weight <= total2 AS is_full FROM l),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
        weight * (total2 - coalesce(sum(2 * cap) FILTER (WHERE is_full) OVER (), 0)) / (2 * sum(weight) FILTER (WHERE NOT is_full) OVER ()) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT d.*, e.source_size, CAST(e.target AS DOUBLE) AS target, e.whole, e.target - e.whole * e.source_size AS extra,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at",
        sum(d.size) OVER (PARTITION BY d.source, substr(place, 1, 3)) AS bucket_size,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(place, 1, 3) RANGE UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, whole + CASE WHEN upto <= extra THEN 1 WHEN upto - bucket_size >= extra THEN 0
        WHEN "at" + size / 2 <= extra THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, CAST(copies AS BIGINT) AS copies FROM c
"""
