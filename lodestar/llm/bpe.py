"""BPE encoding and decoding with a public vocabulary, whose path is a parameter."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_worker
from .common import ship, table

ship(bpe_worker)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary's place on the driver, without importing its package."""
    found = importlib.util.find_spec("public_tokenizers")
    if found is None or not found.origin:
        raise FileNotFoundError("the package public_tokenizers is not installed: give the path of a vocabulary")
    return os.path.join(os.path.dirname(found.origin), name)


def _sent(docs: DataFrame, path: str):
    """The vocabulary, broadcast (a few MB): workers need no file of their own."""
    return docs.sparkSession.sparkContext.broadcast(bpe_worker.compact(path))


def _rows(docs: DataFrame, id_col: str, value: str, name: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(value).alias(name))
    return rows, rows.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, ids``, one a row of ``docs``: no special tokens are added, those in the text keep their ids.

    Null texts count as empty; ids of documents may be null or repeat; other columns are left behind.
    """
    rows, kind = _rows(docs, id_col, text_col, "text")
    return rows.mapInArrow(bpe_worker.encode_batches(_sent(rows, path)), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows ``doc_id, text``: the tokens' texts, joined by spaces as the vocabulary names no decoder; unknown ids are skipped."""
    rows, kind = _rows(rows, id_col, ids_col, "ids")
    return rows.mapInArrow(bpe_worker.decode_batches(_sent(rows, path)), f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass over each whole text."""
    rows, kind = _rows(docs, id_col, text_col, "text")
    return rows.mapInArrow(bpe_worker.digest_batches(_sent(rows, path)), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str) -> DataFrame:
    """Rows ``doc_id, lang, source, n_tokens, ids, decoded_sha256``, one a row of ``docs``; the digest is of the decoded ids."""
    rows = docs.select("doc_id", "lang", "source", "text")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:3])
    return rows.mapInArrow(bpe_worker.token_batches(_sent(rows, path)), f"{kinds}, n_tokens long, ids array<int>, decoded_sha256 string")


def op9(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
