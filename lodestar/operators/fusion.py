"""Fusion of ranked lists and the steps that rescore and re-rank what was fused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import Docs, corpus_size, frequencies, near, of_documents, postings, query_terms, top_k


def rrf(lists: dict[str, DataFrame], rrf_k: float = 60.0, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of hit tables by name: ``query_id, doc_id, score, source_ranks, source_scores, rank``.

    A list without a weight weighs 1; a document's first hit in a list counts; a missing or zero rank is its place in
    the list. Weights may also be a column ``weight`` of a list, for weights that differ by query.
    """
    if not rrf_k > 0:
        raise ValueError(f"a constant over 0 is needed, not {rrf_k}")
    parts = []
    for name, hits in lists.items():
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id"))
        rank = F.when(F.coalesce("rank", F.lit(0)) > 0, F.col("rank")).otherwise(place)
        weight = F.col("weight") if "weight" in hits.columns else F.lit(float((weights or {}).get(name, 1.0)))
        rows = hits.select("query_id", "doc_id", "score", rank.cast("int").alias("rank"), weight.alias("weight"))
        rows = rows.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"), F.min_by("score", "rank").alias("score"), F.min_by("weight", "rank").alias("weight"))
        parts.append(rows.withColumn("source", F.lit(name)))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    entry = lambda value: F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", value))))
    fused = every.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("weight") / (F.lit(float(rrf_k)) + F.col("rank"))), 6).alias("score"), entry("rank").alias("source_ranks"), entry("score").alias("source_scores")
    )
    return top_k(fused, k or 2**31 - 1)


def idf_weights(docs: Docs, queries: DataFrame, base_sparse: float = 0.4, steepness: float = 1.5, midpoint: float = 3.0) -> DataFrame:
    """``query_id, dense_weight, sparse_weight``: rare terms, with repeats, move weight to the sparse list."""
    asked = query_terms(queries)
    n = F.broadcast(corpus_size(docs))
    rows = asked.join(near(frequencies(postings(docs, terms=asked))), "term", "left").crossJoin(n)
    mean = F.sum(F.col("qf") * F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))) / F.sum("qf")
    found = queries.select("query_id").join(rows.groupBy("query_id").agg(mean.alias("m")), "query_id", "left")
    moved = F.lit(base_sparse) + F.lit(0.3) * (1 / (1 + F.exp(-F.lit(steepness) * (F.col("m") - F.lit(midpoint)))) - F.lit(0.5))
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.1)), F.lit(0.9))
    found = found.withColumn("s", clamp(F.coalesce(moved, F.lit(base_sparse)))).withColumn("d", clamp(1 - F.coalesce(moved, F.lit(base_sparse))))
    return found.select("query_id", F.round(F.col("d") / (F.col("d") + F.col("s")), 6).alias("dense_weight"), F.round(F.col("s") / (F.col("d") + F.col("s")), 6).alias("sparse_weight"))


def rerank(evidence: DataFrame, score: Column) -> DataFrame:
    """Evidence with a new score and 0-based ranks by it; ties keep the order they had."""
    moved = evidence.withColumn("_new", F.round(score, 6))
    order = Window.partitionBy("query_id").orderBy(F.col("_new").desc(), "rank")
    moved = moved.withColumn("rank", F.row_number().over(order) - 1)
    return moved.withColumn("score", F.col("_new")).drop("_new")


def title_boost(evidence: DataFrame, queries: DataFrame, titles: DataFrame) -> DataFrame:
    """Scores times 1 + half the share of the query's distinct terms that the title has."""
    rows = near(evidence.join(queries, "query_id"))
    held = titles.join(rows.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "title")
    rows = rows.join(near(held), "doc_id", "left")
    asked = F.array_distinct(T.plain_tokens(F.col("query")))
    share = F.size(F.array_intersect(asked, T.plain_tokens(F.coalesce("title", F.lit(""))))) / F.size(asked)
    return rerank(rows, F.col("score") * F.when(F.size(asked) > 0, 1 + F.lit(0.5) * share).otherwise(1.0)).drop("query", "title")


def intersection_boost(evidence: DataFrame, factor: float = 1.2) -> DataFrame:
    """Scores times ``factor`` where the sparse list and a dense or plug-in list both have the document."""
    names = F.map_keys("source_ranks")
    both = F.array_contains(names, "sparse") & F.exists(names, lambda n: n.startswith("dense") | n.startswith("plugin_"))
    return rerank(evidence, F.col("score") * F.when(both, F.lit(factor)).otherwise(1.0))


def coherence_boost(evidence: DataFrame, vectors: DataFrame, factor: float = 0.2, first: int = 20) -> DataFrame:
    """Scores times 1 + ``factor`` x the mean cosine with the query's other first documents, where it is positive.

    Queries of fewer than three documents stay as they are. The pairs are those of the first 20 documents of a query,
    190 at most. The mean of cosines with others is (unit vector . sum of unit vectors - 1) / (n - 1), so that no pair
    is formed: the sum is one aggregate by query and component.
    """
    from ..functions.vectors import normalised

    rows = of_documents(evidence.where(F.col("rank") < first).select("query_id", "doc_id"), vectors, "vec").select("query_id", "doc_id", normalised(F.col("vec")).alias("u"))
    parts = rows.select("query_id", "doc_id", F.posexplode("u").alias("i", "x"))
    sums = parts.groupBy("query_id", "i").agg(F.sum("x").alias("total"))
    size = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    dots = parts.join(sums, ["query_id", "i"]).groupBy("query_id", "doc_id").agg(F.sum(F.col("x") * (F.col("total") - F.col("x"))).alias("dot"))
    mean = dots.join(size, "query_id").where("n >= 3").select("query_id", "doc_id", F.greatest(F.col("dot") / (F.col("n") - 1), F.lit(0.0)).alias("coherence"))
    joined = evidence.join(mean, ["query_id", "doc_id"], "left")
    return rerank(joined, F.col("score") * (1 + F.lit(factor) * F.coalesce("coherence", F.lit(0.0)))).drop("coherence")


def score_normalize(evidence: DataFrame) -> DataFrame:
    """Min-max scores by query with a small bonus for the former rank; equal scores fall with rank; one document stays."""
    whole = Window.partitionBy("query_id")
    n, low, high = F.count("*").over(whole), F.min("score").over(whole), F.max("score").over(whole)
    spread = (F.col("score") - F.col("low")) / (F.col("high") - F.col("low")) + F.lit(0.001) * (F.col("n") - F.col("rank")) / F.col("n")
    rows = evidence.withColumn("n", n).withColumn("low", low).withColumn("high", high)
    new = F.when(F.col("n") < 2, F.col("score")).when(F.col("high") <= F.col("low"), 1 - F.col("rank") / F.col("n")).otherwise(spread)
    return rerank(rows, new).drop("n", "low", "high")


def selective_filter(evidence: DataFrame, threshold: float = 0.55) -> DataFrame:
    """Scores multiplied by how far ``store_score`` is from the threshold; ``accuracy`` and ``reproducibility`` may override."""
    s, t = F.coalesce("store_score", F.lit(0.0)), F.lit(threshold)
    below = F.lit(0.5) + s / t * F.lit(0.5) if threshold > 0 else F.lit(1.0)
    factor = (
        F.when((F.coalesce("accuracy", F.lit(0.0)) >= 0.82) & (F.coalesce("reproducibility", F.lit(0.0)) < 0.70), 1.5).when(s >= t, F.least(1 + (s - t), F.lit(1.5))).otherwise(below)
    )
    return rerank(evidence.withColumn("pre_filter_score", F.col("score")), F.col("score") * factor)


def blended(evidence: DataFrame, reranked: Column, weight: float = 1.0) -> DataFrame:
    """Scores mixed with a reranker's; documents routed ``fast`` keep theirs."""
    mixed = (1 - F.lit(weight)) * F.col("score") + F.lit(weight) * reranked
    return rerank(evidence, F.when(F.col("routing") == "fast", F.col("score")).otherwise(mixed) if "routing" in evidence.columns else mixed)
