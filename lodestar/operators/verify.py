"""Confidence, grounding, tension of answers with their evidence, and evaluation against golden questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

STOPWORDS = "with will would were was to this the that should shall or on of not might may it is in have has had from for do does did could can by but being been be at are and an a".split()
GENERIC = (
    "all things considered|as a general rule|as a matter of fact|as such|as we all know|at the end of the day|broadly speaking|by and large|for all intents and purposes|generally speaking|"
    "in general|in most cases|in the grand scheme|it goes without saying|it is commonly accepted|it is well known|it should be noted|more or less|needless to say|typically speaking"
)
NO_EVIDENCE = "can't answer|cannot answer|do not know|don't know|insufficient evidence|no cited evidence|no evidence|no supporting|not enough evidence|not found"


def confidence(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, confidence, evidence_count``: from ranked evidence (query_id, score, rank, source_ranks, source_scores, matched_terms).

    The first document counts by score, lead over the second, lists that agree and terms met; queries without evidence have 0.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = evidence.withColumn("at", F.row_number().over(order)).groupBy("query_id").agg(
        F.min_by(F.struct("score", F.map_keys("source_ranks").alias("ranks"), F.map_keys("source_scores").alias("scores"), F.size("matched_terms").alias("met")), "at").alias("x"),
        F.max(F.when(F.col("at") == 2, F.col("score"))).alias("second"),
        F.count("*").alias("n"),
    )
    first = F.greatest(F.col("x.score"), F.lit(0.0))
    lead = F.greatest(first - F.greatest(F.coalesce("second", F.lit(0.0)), F.lit(0.0)), F.lit(0.0))
    lists = F.coalesce(F.size("x.ranks"), F.lit(0))
    agree = F.when(lists >= 2, 1.0).when(lists == 1, 0.5).otherwise(0.0)
    one = F.lit(1.0)
    met = F.least(F.greatest(F.col("x.met"), F.lit(0)) / F.when(F.array_contains("x.scores", "sparse"), 4).otherwise(5), one)
    total = F.least(first * 80, one) * F.lit(0.25) + F.least(lead * 120, one) * F.lit(0.10) + agree * F.lit(0.25) + met * F.lit(0.30) + F.least(F.col("n") / F.lit(3.0), one) * F.lit(0.10)
    scored = rows.select("query_id", F.round(F.least(F.greatest(total, F.lit(0.0)), one), 6).alias("confidence"), "n")
    return queries.select("query_id").join(scored, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("n", F.lit(0)).cast("long").alias("evidence_count"))


def grounded(citations: DataFrame, evidence: DataFrame, queries: DataFrame, required: bool = True) -> DataFrame:
    """``query_id, grounded, n_missing``: whether all citations (query_id, doc_id, source) are among the evidence; none given: not required."""
    held = evidence.select("query_id", "doc_id", "source").distinct().withColumn("held", F.lit(1))
    rows = citations.join(held, ["query_id", "doc_id", "source"], "left").groupBy("query_id").agg(F.count_if(F.col("held").isNull()).alias("missing"))
    found = queries.select("query_id").join(rows, "query_id", "left")
    return found.select("query_id", F.coalesce(F.col("missing") == 0, F.lit(not required)).alias("grounded"), F.coalesce("missing", F.lit(0)).cast("long").alias("n_missing"))


def content_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(T.plain_tokens(text), lambda t: ~t.isin(*STOPWORDS)))


def generic_count(answer: Column) -> Column:
    low = F.lower(answer)
    return sum((low.contains(p).cast("int") for p in GENERIC.split("|")), F.lit(0))


def tension(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """``query_id, sovereignty, skeptic, overall``: share of an answer's terms in its evidence, and its lack of stock phrases.

    Evidence terms are joined one by one, so that a query with much evidence needs no long array.
    """
    terms = answers.select("query_id", F.explode_outer(content_terms(F.col("answer"))).alias("term"))
    held = evidence.select("query_id", F.explode(content_terms(F.col("text"))).alias("term")).distinct().withColumn("held", F.lit(1))
    share = terms.join(held, ["query_id", "term"], "left").groupBy("query_id").agg((F.count("held") / F.greatest(F.count("term"), F.lit(1))).alias("share"))
    rows = answers.join(share, "query_id").withColumn("skeptic", F.greatest(1 - F.lit(0.15) * generic_count(F.col("answer")), F.lit(0.0)))
    return rows.select("query_id", F.round("share", 6).alias("sovereignty"), F.round("skeptic", 6).alias("skeptic"), F.round(F.lit(0.6) * F.col("share") + F.lit(0.4) * F.col("skeptic"), 6).alias("overall"))


def _names(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: v != ""))


def recall(expected: Column, retrieved: Column, k: int = 5) -> Column:
    """Share of the expected sources among the first k retrieved ones; 1 if none is expected."""
    want = _names(expected)
    return F.when(F.size(want) == 0, 1.0).otherwise(F.round(F.size(F.array_intersect(want, _names(F.slice(retrieved, 1, max(k, 0))))) / F.size(want), 6) if k > 0 else F.lit(0.0))


def citation_accuracy(expected: Column, cited: Column) -> Column:
    """Share of citations, repeats counted, whose source is expected."""
    want = _names(expected)
    have = F.filter(F.transform(cited, lambda v: F.lower(F.trim(v))), lambda v: v != "")
    share = F.round(F.size(F.filter(have, lambda v: F.array_contains(want, v))) / F.size(have), 6)
    return F.when(F.size(have) == 0, F.when(F.size(want) == 0, 1.0).otherwise(0.0)).when(F.size(want) == 0, 0.0).otherwise(share)


def term_match(answer: Column, terms: Column) -> Column:
    real = F.filter(terms, lambda t: F.trim(t) != "")
    met = F.filter(real, lambda t: F.contains(T.squeezed(answer), T.squeezed(t)))
    return F.when(F.size(real) == 0, 1.0).otherwise(F.round(F.size(met) / F.size(real), 6))


def no_evidence(expected: Column, answer: Column, n_evidence: Column) -> Column:
    """1 where nothing was expected to be found and the answer says so, or where it wasn't asked for."""
    says = (T.squeezed(answer) == "") | T.squeezed(answer).rlike("|".join(NO_EVIDENCE.split("|")))
    return F.when(~F.coalesce(expected, F.lit(False)), 1.0).when(n_evidence > 0, 0.0).when(says, 1.0).otherwise(0.0)


def evaluate(golden: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Four metrics and their mean for each golden question (id, expected_sources, expected_terms, no_evidence).

    ``results`` is ``id, answer, retrieved, cited``, the last two arrays of sources.
    """
    rows = golden.join(results, "id", "left")
    metrics = {
        "recall_at_k": recall(F.col("expected_sources"), F.coalesce("retrieved", F.array().cast("array<string>")), k),
        "citation_source_accuracy": citation_accuracy(F.col("expected_sources"), F.coalesce("cited", F.array().cast("array<string>"))),
        "expected_term_match": term_match(F.coalesce("answer", F.lit("")), F.col("expected_terms")),
        "no_evidence_behavior": no_evidence(F.col("no_evidence"), F.coalesce("answer", F.lit("")), F.coalesce(F.size("retrieved"), F.lit(0)) + F.coalesce(F.size("cited"), F.lit(0))),
    }
    rows = rows.select("id", "no_evidence", *(m.alias(n) for n, m in metrics.items()))
    return rows.withColumn("overall", F.round(sum((F.col(n) for n in metrics), F.lit(0.0)) / F.lit(4.0), 6))


def summary(evaluated: DataFrame) -> DataFrame:
    """Means over questions; the no-evidence mean over flagged ones only."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("recall_at_k", "citation_source_accuracy", "expected_term_match", "overall")]
    return evaluated.agg(F.count("*").alias("questions"), *means, F.round(F.avg(F.when(F.col("no_evidence"), F.col("no_evidence_behavior"))), 6).alias("no_evidence_behavior"))


def ranking_metrics(hits: DataFrame, relevant: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, ndcg, mrr`` at k of ranked hits against relevant pairs (query_id, doc_id); 0 without any."""
    met = hits.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    gains = met.groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.min("rank").alias("first"))
    wanted = relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    rows = queries.select("query_id").join(wanted, "query_id", "left").join(gains, "query_id", "left")
    return rows.select("query_id", F.round(F.coalesce(F.col("dcg") / ideal, F.lit(0.0)), 6).alias("ndcg"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"))
