"""Training pairs and triplets from chunks (chunk_id, doc_id, position, text, title, heading)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import store
from .lexical import bm25


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""))


def title_pairs(chunks: DataFrame, least: int = 5) -> DataFrame:
    """Headings, or titles, with bodies of ``least`` words or more."""
    head = F.trim(F.coalesce(F.nullif("heading", F.lit("")), "title"))
    return chunks.where((F.coalesce(head, F.lit("")) != "") & (words(F.col("text")) >= least)).select(head.alias("anchor"), F.trim("text").alias("positive"), "doc_id")


def adjacent_pairs(chunks: DataFrame, least: int = 5) -> DataFrame:
    """Each chunk with the next of its document, both of ``least`` words or more."""
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("position"))
    rows = chunks.select("doc_id", "position", F.trim("text").alias("anchor"), F.trim(after).alias("positive"))
    return rows.where((words(F.col("anchor")) >= least) & (F.coalesce(words(F.col("positive")), F.lit(0)) >= least))


def hard_negatives(pairs: DataFrame, chunks: DataFrame, k: int = 10) -> DataFrame:
    """``pair_id, negative_id``: for each pair (pair_id, anchor, doc_id) the first BM25 hit from another document."""
    corpus = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
    hits = bm25(corpus, pairs.select(F.col("pair_id").alias("query_id"), F.col("anchor").alias("query")), k)
    owner = chunks.select(F.col("chunk_id").alias("c"), F.col("doc_id").alias("owner"))
    rows = hits.join(owner, F.col("doc_id") == F.col("c")).select("query_id", "c", "owner", "rank")
    rows = rows.join(pairs.select(F.col("pair_id").alias("query_id"), F.col("doc_id").alias("own")), "query_id").where("owner <> own")
    return rows.groupBy(F.col("query_id").alias("pair_id")).agg(F.min_by("c", "rank").alias("negative_id"))


def triplets(pairs: DataFrame, chunks: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """``anchor, positive, negative`` in an order by seeded hash; pairs without a hard negative get a hashed one from another document.

    The fallback joins each pair with one chunk by its place in the hash order, so no pair meets all chunks.
    """
    hard = hard_negatives(pairs, chunks, k)
    texts = chunks.select(F.col("chunk_id").alias("negative_id"), F.col("text").alias("negative"))
    rows = pairs.join(hard, "pair_id", "left")
    n = max(1, min(4_096, chunks.count()))
    slot = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(n))
    spare = chunks.withColumn("slot", slot("chunk_id")).groupBy("slot").agg(F.min(F.struct("chunk_id", "doc_id", "text")).alias("a"), F.max(F.struct("doc_id", "chunk_id", "text")).alias("b"))
    rows = rows.withColumn("slot", slot("pair_id")).join(spare, "slot", "left").join(texts, "negative_id", "left")
    other = F.when(F.col("a.doc_id") != F.col("doc_id"), F.col("a.text")).when(F.col("b.doc_id") != F.col("doc_id"), F.col("b.text"))
    rows = rows.withColumn("negative", F.coalesce("negative", other)).where("negative is not null")
    return rows.select("anchor", "positive", "negative").orderBy(F.xxhash64(F.lit(seed), "anchor", "positive"))


@dataclass(frozen=True)
class TrainingConfig:
    """What a trainer of embedding models is told; training itself is for a library of that kind."""

    epochs: int = 3
    batch: int = 16
    learning_rate: float = 2e-5
    warmup: float = 0.1
    max_tokens: int = 256
    seed: int = 42


def export(rows: DataFrame, path: str, config: TrainingConfig = TrainingConfig()) -> None:
    """Triplets or pairs as one version of a stored data set, with the settings they are meant for."""
    store.write_tables(rows.sparkSession, path, {"examples": rows}, config=asdict(config), columns=rows.columns)


def train(path: str, spark: SparkSession, trainer: Callable[[DataFrame, TrainingConfig], dict]) -> dict:
    """What a plug-in trainer returns for an exported data set."""
    tables, facts = store.read_tables(spark, path)
    return trainer(tables["examples"], TrainingConfig(**facts["config"]))
