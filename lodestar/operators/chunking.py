"""Documents to chunks: paragraphs, sentences, packed sentences, three scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EMPTY = "array<string>"


def _none() -> Column:
    return F.array().cast(EMPTY)


def packed(text: Column, max_chars: int = 900) -> Column:
    """A text cut into runs of sentences of about ``max_chars``, in one fold.

    A run's first sentence counts without the blank that others count, as in the rule this follows.
    """
    start = F.struct(_none().alias("done"), F.lit("").alias("now"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        full = (s["size"] > 0) & (s["size"] + F.length(x) + 1 > max_chars)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.trim(s["now"])))).otherwise(s["done"]).alias("done"),
            F.when(full | (s["size"] == 0), x).otherwise(F.concat(s["now"], F.lit(" "), x)).alias("now"),
            F.when(full, F.length(x)).otherwise(s["size"] + F.length(x) + 1).alias("size"),
        )

    def finish(s: Column) -> Column:
        return F.filter(F.concat(s["done"], F.array(F.trim(s["now"]))), lambda c: c != "")

    cut = F.aggregate(F.split(text, r"(?<=[!?.])\s+"), start, step, finish)
    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(cut)


def paragraphs(docs: DataFrame, max_chars: int = 900, overlap_chars: int = 0) -> DataFrame:
    """``doc_id, position, text``: paragraphs between blank lines, long ones packed from sentences.

    With an overlap, each chunk starts with the end of the chunk before, its own overlap included.
    """
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n+"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b"))), lambda p: p != "")
    cut = F.flatten(F.transform(parts, lambda p: packed(p, max_chars)))
    if overlap_chars > 0:
        glue = lambda done, c: F.concat(done, F.array(F.concat(F.coalesce(F.right(F.try_element_at(done, F.lit(-1)), F.lit(overlap_chars)), F.lit("")), c)))
        cut = F.aggregate(cut, _none(), glue)
    return docs.select("doc_id", F.posexplode(cut).alias("position", "text"))


def sentence_chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.careful_sentences(F.col("text"))).alias("position", "text"))


def semantic_chunks(docs: DataFrame, target: int = 512, overlap: int = 1) -> DataFrame:
    """``doc_id, position, text, heading``: sentences packed to ``target`` characters; a heading starts anew, else the last ones repeat."""
    kind = "array<array<string>>"
    start = F.struct(F.array().cast(kind).alias("done"), _none().alias("now"), F.lit(0).alias("size"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x) + 1)

    def step(s: Column, x: Column) -> Column:
        head, some = T.is_heading(x), F.size(s["now"]) > 0
        full = some & ~head & (s["size"] + F.length(x) + 1 > target)
        flush = full | (some & head)
        kept = F.when(full, F.slice(s["now"], F.greatest(F.size(s["now"]) - overlap + 1, F.lit(1)), overlap) if overlap else _none()).when(flush, _none()).otherwise(s["now"])
        size = F.when(full, total(kept)).when(flush, 0).otherwise(s["size"])
        return F.struct(
            F.when(flush, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"]).alias("done"),
            F.concat(kept, F.array(x)).alias("now"),
            (size + F.length(x) + F.when(F.size(kept) > 0, 1).otherwise(0)).cast("int").alias("size"),
        )

    finish = lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
    cut = F.aggregate(T.careful_sentences(F.col("text")), start, step, finish)
    rows = docs.select("doc_id", F.posexplode(cut).alias("position", "parts"))
    return rows.select("doc_id", "position", F.array_join("parts", " ").alias("text"), F.when(T.is_heading(F.col("parts")[0]), F.col("parts")[0]).otherwise("").alias("heading"))


def scales(docs: DataFrame, least: int = 30, group: int = 3) -> DataFrame:
    """``doc_id, level, position, text``: sentences (0), paragraphs (1) and the document (2).

    Sentences shorter than ``least`` join the one before; a document of one paragraph and four sentences or more gets
    paragraphs of ``group`` sentences.
    """
    raw = F.filter(F.transform(F.split("text", r"(?<=[!?.])\s+(?=[A-Z])"), lambda s: F.btrim(s, F.lit(" \t\n\r\f\x0b"))), lambda s: s != "")

    def merge(done: Column, x: Column) -> Column:
        glued = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit(" "), x)))
        return F.when((F.size(done) > 0) & (F.length(x) < least), glued).otherwise(F.concat(done, F.array(x)))

    rows = docs.select("doc_id", "text", F.aggregate(raw, _none(), merge).alias("s"))
    given = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\r\f\x0b"))), lambda p: p != "")
    rows = rows.withColumn("p", F.when(F.size(given) > 0, given).otherwise(F.array("text")))
    grouped = F.transform(F.sequence(F.lit(1), F.greatest(F.size("s"), F.lit(1)), F.lit(group)), lambda i: F.array_join(F.slice("s", i, group), " "))
    rows = rows.withColumn("p", F.when((F.size("p") == 1) & (F.size("s") >= 4), grouped).otherwise(F.col("p")))
    level = lambda n, parts: F.transform(parts, lambda x, i: F.struct(F.lit(n).alias("level"), i.alias("position"), x.alias("text")))
    return rows.select("doc_id", F.explode(F.concat(level(0, F.col("s")), level(1, F.col("p")), level(2, F.array("text")))).alias("c")).select("doc_id", "c.*")


STRATEGIES = {"paragraph": paragraphs, "sentence": sentence_chunks, "semantic": semantic_chunks}


def chunk(docs: DataFrame, strategy: str = "paragraph", **options) -> DataFrame:
    """Chunks of non-blank text by a named strategy, with their complexity and its label."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; there are {sorted(STRATEGIES)}")
    rows = STRATEGIES[strategy](docs, **options).where(F.trim("text") != "")
    score = T.complexity(T.complexity_parts(F.col("text")))
    return rows.withColumn("complexity", T.complexity_label(score)).withColumn("complexity_score", F.bround(score, 4))
