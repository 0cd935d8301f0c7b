"""Prompts and template answers from ranked evidence (query_id, rank, doc_id, title, text, ...), one row a query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CONTRACTS = dict(soft="[SOFT CONTEXT]", medium="[MEDIUM CONSTRAINT]", hard="[HARD CONSTRAINT]")


def citations(evidence: DataFrame, chars: int = 240) -> DataFrame:
    return evidence.select("query_id", "doc_id", "source", F.substring("text", 1, chars).alias("excerpt"), "score")


def template_answers(evidence: DataFrame, queries: DataFrame, first: int = 3, chars: int = 180) -> DataFrame:
    """``query_id, answer``: how much was found, and the start of the first documents."""
    order = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    rows = evidence.withColumn("at", order).groupBy("query_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("at") <= first, F.struct("at", F.concat(F.lit("- "), "title", F.lit(": "), F.substring("text", 1, chars)).alias("line"))))).alias("l")
    )
    shown = F.when(F.length("query") > 200, F.concat(F.substring("query", 1, 200), F.lit("..."))).otherwise(F.col("query"))
    found = queries.join(rows, "query_id", "left")
    lines = F.transform("l", lambda x: x["line"])
    head = F.concat(F.lit("Retrieved "), F.col("n"), F.lit(" cited evidence item(s) for: "), shown)
    return found.select("query_id", F.when(F.col("n").isNull(), F.concat(F.lit("No cited evidence found for: "), shown)).otherwise(F.array_join(F.concat(F.array(head), lines), "\n")).alias("answer"))


def prompts(evidence: DataFrame, queries: DataFrame, items: int = 10, chars: int = 12_000, contracts: bool = False) -> DataFrame:
    """``query_id, prompt``: numbered evidence within a number of characters, then the question."""
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = evidence.withColumn("at", F.row_number().over(order)).where(F.col("at") <= items)
    before = F.coalesce(F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(chars) - before).where("left > 0")
    body = F.when(F.length("text") > F.col("left"), F.concat(F.substring(F.col("text"), F.lit(1), F.col("left").cast("int")), F.lit("..."))).otherwise(F.col("text"))
    label = F.lit("")
    if contracts:
        for tier, mark in CONTRACTS.items():
            label = F.when(F.col("contract") == tier, mark + " ").otherwise(label)
    line = F.concat(label, F.lit("["), F.col("at").cast("string"), F.lit("] Source: "), "title", F.lit("\n"), body)
    listed = rows.select("query_id", "at", line.alias("line")).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n\n").alias("block"))
    found = queries.join(listed, "query_id", "left")
    ask = "\n\nAnswer from the evidence above, and cite its numbers in brackets."
    return found.select("query_id", F.concat(F.lit("Evidence:\n"), F.coalesce("block", F.lit("(none)")), F.lit("\n\nQuestion: "), "query", F.lit(ask)).alias("prompt"))


JUDGE = "You judge how well passages answer a question. Reply with one JSON object from passage numbers to marks between 0 and 10, and with nothing else."


def judge_prompts(pairs: DataFrame, chars: int = 1_000) -> DataFrame:
    """``query_id, doc_ids, system, prompt``: the passages of each query (query_id, doc_id, query, text), numbered by doc_id, to be marked by a model."""
    listed = pairs.groupBy("query_id").agg(F.first("query").alias("query"), F.array_sort(F.collect_list(F.struct("doc_id", F.substring("text", 1, chars).alias("text")))).alias("p"))
    block = F.array_join(F.transform("p", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(x["text"], F.lit("")))), "\n\n")
    prompt = F.concat(F.lit("Question: "), "query", F.lit("\n\n"), block, F.lit("\n\nMark each passage from 0 to 10, as JSON."))
    return listed.select("query_id", F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.lit(JUDGE).alias("system"), prompt.alias("prompt"))


def judged_scores(replies):
    """Relevance from 0 to 1 by passage number, from a model's reply: fenced or bare JSON, or the first object in the text.

    Scores are out of 10; null if the reply has none. Missing passages count as 0.5 where this is used.
    """
    body = F.regexp_extract(replies, r"(?s)(\{.*?\})", 1)
    parsed = F.from_json(body, "map<string,double>")
    return F.transform_values(parsed, lambda _, v: F.least(F.greatest(v / 10, F.lit(0.0)), F.lit(1.0)))


def judged(replies: DataFrame) -> DataFrame:
    """``query_id, doc_id, reranked`` from replies (query_id, doc_ids, reply): 0.5 for passages without a mark, and for all of a reply that can't be read."""
    marked = replies.withColumn("marks", judged_scores(F.col("reply"))).select("query_id", "marks", F.posexplode("doc_ids").alias("at", "doc_id"))
    return marked.select("query_id", "doc_id", F.coalesce(F.try_element_at("marks", (F.col("at") + 1).cast("string")), F.lit(0.5)).alias("reranked"))


def generated(prompts: DataFrame, load: Callable[[], Callable[[str, str], str]], column: str = "answer") -> DataFrame:
    """``prompts`` (prompt, and system or none) with what a plug-in model makes of each, null where it fails; each worker loads it once."""

    @F.pandas_udf("string")
    def write(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()

        def one(system, prompt):
            try:
                return model(system or "", prompt)
            except Exception:
                return None

        for systems, asked in batches:
            yield pd.Series([one(s, p) if p is not None else None for s, p in zip(systems, asked)], dtype=object)

    return prompts.withColumn(column, write(F.col("system") if "system" in prompts.columns else F.lit(""), "prompt"))


def judge_reranker(load: Callable[[], Callable[[str, str], str]]) -> Callable[[DataFrame], DataFrame]:
    """A reranker of pairs (query_id, doc_id, query, text) by a model that marks all passages of a question in one reply."""
    return lambda pairs: judged(generated(judge_prompts(pairs), load, "reply"))


def pair_reranker(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]]) -> Callable[[DataFrame], DataFrame]:
    """A reranker by a model of (query, passage) pairs, such as a cross-encoder, which each worker loads once and calls once a batch."""

    def rerank(pairs: DataFrame) -> DataFrame:
        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            model = load()
            for queries, passages in batches:
                yield pd.Series([float(s) for s in model(list(zip(queries, passages.fillna(""))))], dtype=float)

        return pairs.withColumn("reranked", score("query", "text"))

    return rerank
