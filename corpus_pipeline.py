"""Training corpus in five stages; each reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import bpe, langid, line_dedup, mixing, simhash
from lodestar.llm.common import small_batches, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the model can tell, learned from the labelled ones of the usual folds."""
    small_batches(spark)
    learned = docs.where(langid.fold(F.col("doc_id")) != 2).select("doc_id", "text", "lang")
    return langid.keep_known(docs, langid.fit(learned, bpe.vocabulary("piece_bpe_32k.model")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source, exact copies counted once; n_chars follows the text."""
    found = line_dedup.drop_boilerplate(docs, distinct=True)
    columns = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    small_batches(spark)
    return simhash.near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out so that the sources' words come to their targets."""
    return mixing.mixed(docs)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the SHA-256 of what they decode to."""
    small_batches(spark)
    return bpe.tokens(docs, bpe.vocabulary())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]

#: SQL expresses neither the language model nor the near copies; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
