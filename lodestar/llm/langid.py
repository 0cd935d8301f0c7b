"""Language identification by unigram models whose segmentations are all summed."""

from __future__ import annotations

from collections import Counter

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import langid_worker
from .bpe import vocabulary
from .common import ship, small, stored, table

ship(langid_worker)

#: Bounds of the sample that the model is fitted on: about so many documents of all, so many of each language at least
#: (all of them where it has fewer), and so many distinct words of each language.
SAMPLE_DOCS, LANG_DOCS, SAMPLE_WORDS = 3_000, 200, 40_000
#: Compressed bytes up to which the languages' bounds are broadcast; beyond it, Spark shuffles.
BROADCAST_BYTES = 32 << 20


def pieces(path: str, longest: int = 8) -> list[str]:
    """The vocabulary's pieces of letters, lower-cased, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)}
    return sorted(p for p in found if len(p) <= longest + 1 and (p == langid_worker.MARK or p.removeprefix(langid_worker.MARK).isalpha()))


def fit(labelled: DataFrame, path: str) -> langid_worker.Model | None:
    """A model from the rows ``doc_id, text, lang`` given, or None without any.

    Rows with a null text or lang are left out. Only the sample of bounded size that is named above is read for fitting:
    rows whose hash of doc_id falls under the share wanted, and the LANG_DOCS of each language with the least hashes, so
    that a rare language is learned too. Of a long text the first DOC_WORDS words are counted.
    """
    rows = labelled.where("text is not null and lang is not null")
    n = rows.select("lang").count()
    if not n:
        return None
    share = min(1.0, SAMPLE_DOCS / n)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    # The text counts too: ids may be null or repeat, and a language's rows must not share one hash.
    hashed = rows.select("lang", "text", F.xxhash64(name).alias("id_hash"), F.xxhash64(name, "text").alias("hash"))
    least = Window.partitionBy("lang").orderBy("hash")
    first = hashed.select("lang", "hash").withColumn("at", F.row_number().over(least)).where(F.col("at") <= LANG_DOCS)
    edges = small(stored(first.groupBy("lang").agg(F.max("hash").alias("edge")), "edges"), BROADCAST_BYTES)
    under = F.pmod("id_hash", F.lit(1 << 20)) <= int(share * (1 << 20))
    picked = hashed.join(edges, "lang").where(under | (F.col("hash") <= F.col("edge"))).select("lang", "text")
    counted = picked.mapInArrow(langid_worker.count_batches, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    counts: dict[str, Counter] = {}
    for r in counted.withColumn("at", F.row_number().over(top)).where(F.col("at") <= SAMPLE_WORDS).collect():
        counts.setdefault(r["lang"], Counter())[r["word"]] = r["n"]
    if not counts:
        return None
    return langid_worker.Model(pieces(path), sorted(counts)).fit(counts)


def predict(docs: DataFrame, model: langid_worker.Model | None, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, held_out, lang_pred, score``, one a row of ``docs``; other columns are not read.

    The score is the chance of the language under equal priors. Null texts, texts without a letter, and all texts if
    there is no model are ``und`` with a score of 0. Equal scores go to the first language by name.
    """
    flag = F.lit(False) if held_out is None else held_out
    rows = docs.select(F.col(id_col).alias("doc_id"), flag.alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    return rows.mapInArrow(langid_worker.predict_batches(sent), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: langid_worker.Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, whole, whose ``text`` has a language; those without a letter or below the score go."""
    sent = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))
    return docs.mapInArrow(langid_worker.keep_batches(sent, least), docs.schema)


def fold(doc_id: Column) -> Column:
    """CRC-32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id")) == 2
    model = fit(docs.where(~held).select("doc_id", "text", "lang"), vocabulary("piece_bpe_32k.model"))
    return predict(docs, model, held)
