"""Corpus statistics, embedding quality, calibration, regression checks, bandits, fitness and lifecycle."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine, normalised
from ..sources import store
from ..sources.stage import chunked, staged
from .fusion import rrf
from .lexical import Docs, Index, Tokens, bm25, corpus_size, frequencies, postings, texts


def corpus_signals(docs: Docs, tokens: Tokens = T.plain_tokens) -> DataFrame:
    """One row: mean and sample deviation of lengths, size, share of common terms, vocabulary per token, share of short texts."""
    index = docs if isinstance(docs, Index) else Index(docs)
    sizes = index.rows(tokens).select(F.col("dl").alias("n"))
    whole = sizes.agg(F.count("*").alias("corpus_size"), F.avg("n").alias("m"), F.stddev_samp("n").alias("sd"), F.sum("n").alias("total"), F.avg((F.col("n") < 200).cast("double")).alias("short"))
    seen = index.frequencies(tokens).crossJoin(F.broadcast(corpus_size(index).withColumnRenamed("n", "size")))
    terms = seen.agg(F.count("*").alias("vocabulary"), F.avg((F.col("df") > F.col("size") * 0.1).cast("double")).alias("common"))
    both = whole.crossJoin(terms)
    lone = F.col("corpus_size") == 1
    return both.select(
        F.round(F.coalesce("m", F.lit(0.0)), 6).alias("avg_length"), F.round(F.coalesce(F.when(lone, 0.0).otherwise(F.col("sd")), F.lit(0.0)), 6).alias("length_deviation"), "corpus_size",
        F.round(F.when(lone, 1.0).otherwise(F.coalesce("common", F.lit(0.0))), 6).alias("common_share"),
        F.round(F.coalesce(F.col("vocabulary") / F.nullif("total", F.lit(0)), F.lit(0.0)), 6).alias("richness"), F.round(F.coalesce("short", F.lit(0.0)), 6).alias("short_share"),
    )


def quality_tier(dim: Column, dispersion: Column, separation: Column) -> Column:
    """Vote of dimension, dispersion and separation: two strong or two weak decide, else moderate."""
    votes = [(dim >= 2048, dim < 512), (dispersion > 0.3, dispersion < 0.15), (separation > 0.4, separation < 0.2)]
    count = lambda i: sum((v[i].cast("int") for v in votes), F.lit(0))
    return F.when(count(0) >= 2, "strong").when(count(1) >= 2, "weak").otherwise("moderate")


def embedding_quality(vectors: DataFrame, sample: int = 100, clusters: int = 5, seed: int = 42) -> DataFrame:
    """One row: tier, dim, dispersion and separation from a sample of stated size, picked by hash of the id.

    Dispersion is the variance of cosines of neighbours in hash order; separation the silhouette of a k-means.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    rows = vectors.where("vec is not null").select("doc_id", F.col("vec").cast("array<double>").alias("vec"), F.xxhash64(F.lit(seed), "doc_id").alias("h")).orderBy("h").limit(sample)
    pairs = rows.withColumn("other", F.lead("vec").over(Window.orderBy("h"))).where("other is not null")
    spread = pairs.agg(F.coalesce(F.var_pop(cosine(F.col("vec"), F.col("other"))), F.lit(0.0)).alias("dispersion"), F.max(F.size("vec")).alias("dim"))
    points = rows.select(array_to_vector("vec").alias("features"))
    separation = 0.0
    if points.limit(clusters + 1).count() > clusters:
        assigned = KMeans(k=clusters, maxIter=20, seed=seed).fit(points).transform(points)
        if assigned.select("prediction").distinct().count() > 1:
            separation = ClusteringEvaluator(distanceMeasure="squaredEuclidean").evaluate(assigned)
    both = spread.withColumn("separation", F.lit(float(separation)))
    return both.withColumn("tier", quality_tier(F.col("dim"), F.col("dispersion"), F.col("separation")))


def domain_gap(fragmented: Column, pieces: Column, technical: Column, similarity: Column, unknown: Column) -> Column:
    """Weighted gap from 0 to 1 of a corpus to the tokenizer's own domain."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    parts = ((fragmented, 0.25), (pieces, 0.25), (technical, 0.15), (similarity, 0.20), (unknown, 0.15))
    return F.round(clamp(sum((clamp(c) * F.lit(w) for c, w in parts), F.lit(0.0))), 6)


def gap_advice(gap: Column) -> Column:
    return F.when(gap < 0.3, "none").when(gap < 0.6, "optional").otherwise("recommended")


def pseudo_queries(docs: Docs, held_out: Column, tokens: Tokens = T.plain_tokens, most: int = 20, terms: int = 5) -> DataFrame:
    """``query_id, query, doc_id``: the ``terms`` best TF-IDF terms of up to ``most`` held-out documents (a report's limit).

    ``held_out`` is a condition on ``doc_id``.
    """
    every = postings(docs if isinstance(docs, Index) else Index(docs), tokens)
    n = F.broadcast(texts(docs).where(~held_out).agg(F.count("*").alias("n")))
    posted = every.where(held_out).join(frequencies(every.where(~held_out)), "term", "left").crossJoin(n)
    scored = posted.withColumn("s", F.round(F.col("tf") / F.col("dl") * F.log(F.col("n") / (1 + F.coalesce("df", F.lit(0)))), 6))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("s").desc(), "term"))
    best = scored.withColumn("at", at).where(F.col("at") <= terms).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "term"))).alias("t"))
    picked = best.orderBy("doc_id").limit(most)
    return picked.select(F.col("doc_id").alias("query_id"), F.array_join(F.transform("t", lambda x: x["term"]), " ").alias("query"), "doc_id")


def calibration_grid(lists: dict[str, DataFrame], expected: DataFrame, weights=tuple(i / 10 for i in range(3, 9)), depths=(50, 100, 150), ks=(30.0, 60.0, 90.0)) -> DataFrame:
    """``point, dense_weight, depth, rrf_k, mrr``: mean reciprocal rank of expected documents at each grid point, all in one job."""
    grid = [(i, *p) for i, p in enumerate((w, d, k) for w in weights for d in depths for k in ks)]
    spark = expected.sparkSession
    points = F.broadcast(spark.createDataFrame(grid, "point int, dense_weight double, depth int, rrf_k double"))
    every = None
    for name, hits in lists.items():
        part = hits.select("query_id", "doc_id", "rank", F.lit(name).alias("source"))
        every = part if every is None else every.unionByName(part)
    rows = every.join(points, F.col("rank") <= F.col("depth"))
    weight = F.when(F.col("source") == "dense", F.col("dense_weight")).otherwise(1 - F.col("dense_weight"))
    fused = rows.groupBy("point", "query_id", "doc_id").agg(F.round(F.sum(weight / (F.col("rrf_k") + F.col("rank"))), 6).alias("score"))
    ranked = fused.withColumn("r", F.row_number().over(Window.partitionBy("point", "query_id").orderBy(F.col("score").desc(), "doc_id")))
    met = ranked.join(expected.select("query_id", "doc_id"), ["query_id", "doc_id"]).groupBy("point").agg(F.sum(1 / F.col("r")).alias("s"))
    n = F.broadcast(expected.agg(F.count("*").alias("n")))
    found = points.join(met, "point", "left").crossJoin(n)
    return found.select("point", "dense_weight", "depth", "rrf_k", F.round(F.coalesce(F.col("s") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("mrr"))


def best_point(grid: DataFrame) -> DataFrame:
    """The first grid point of the largest mean reciprocal rank."""
    return grid.agg(F.max_by(F.struct("point", "dense_weight", "depth", "rrf_k", "mrr"), F.struct("mrr", -F.col("point"))).alias("b")).select("b.*")


def calibrate(docs: DataFrame, dense: DataFrame | None = None, held_out: Column | None = None, index_all: bool = False) -> DataFrame:
    """Best fusion parameters by pseudo-queries of held-out documents; the defaults for fewer than 50 documents.

    As the rule that this follows searches training documents alone, what it expects is never found and the first grid
    point wins; ``index_all`` searches all documents, which tells the points apart. ``dense`` holds hits by query_id.
    """
    spark = docs.sparkSession
    if docs.limit(50).count() < 50:
        return spark.createDataFrame([(0, 0.6, 100, 60.0, 0.0)], "point int, dense_weight double, depth int, rrf_k double, mrr double")
    held = F.pmod(F.xxhash64(F.lit(42), "doc_id"), F.lit(5)) == 0 if held_out is None else held_out
    asked = pseudo_queries(docs, held)
    lists = {"sparse": bm25(docs if index_all else docs.where(~held), asked, 150, tokens=T.plain_tokens)}
    if dense is not None:
        lists["dense"] = dense
    return best_point(calibration_grid(lists, asked))


def calibrated(docs: DataFrame, path: str, **options) -> DataFrame:
    """As `calibrate`, kept in a table at ``path`` by the number of documents and the first ten ids."""
    spark = docs.sparkSession
    first = [str(r["doc_id"]) for r in docs.select("doc_id").orderBy("doc_id").limit(10).collect()]
    at = f"{path}/{docs.count()}-{hashlib.sha256('_'.join(first).encode()).hexdigest()[:16]}"
    if not store.exists(spark, f"{at}/_SUCCESS"):
        calibrate(docs, **options).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def search_weights(dense: float | None = None, sparse: float | None = None, calibration: float | None = None, strategy: tuple[float, float] = (0.6, 0.4)) -> tuple[float, float]:
    """Dense and sparse weights: what the caller sets comes first, then a calibrated dense weight, then the strategy's."""
    d = dense if dense is not None else calibration if calibration is not None else strategy[0]
    s = sparse if sparse is not None else 1 - calibration if calibration is not None else strategy[1]
    return d, s


def mean_cosine(vectors: DataFrame, sample: int = 50, seed: int = 42) -> DataFrame:
    """One row ``mean_cosine``: over all pairs of a stated sample (a profile's bound), from the sum of its unit vectors; no pair is formed."""
    rows = vectors.where("vec is not null").orderBy(F.xxhash64(F.lit(seed), "doc_id")).limit(sample).select(normalised(F.col("vec")).alias("u"))
    sums = rows.select(F.posexplode("u").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    pairs = F.max("n") * (F.max("n") - 1)
    return sums.agg(F.round(F.coalesce((F.sum(F.col("s") * F.col("s")) - F.sum("own")) / F.nullif(pairs, F.lit(0)), F.lit(0.0)), 6).alias("mean_cosine"))


def regression_check(baselines: DataFrame, current: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """``task, config, metric, baseline, value, delta, status`` of what both tables have."""
    rows = baselines.select("task", "config", "metric", F.col("value").alias("baseline")).join(current, ["task", "config", "metric"])
    delta = F.round(F.col("value") - F.col("baseline"), 6)
    return rows.withColumn("delta", delta).withColumn("status", F.when(delta < -tolerance, "regression").when(delta > tolerance, "improvement").otherwise("unchanged"))


def update_baselines(baselines: DataFrame, current: DataFrame) -> DataFrame:
    """Baselines raised to better values, and new ones."""
    both = baselines.select("task", "config", "metric", "value").unionByName(current.select("task", "config", "metric", "value"))
    return both.groupBy("task", "config", "metric").agg(F.max("value").alias("value"))


def reward(confidence: Column, grounded: Column, n_evidence: Column, target: int = 3) -> Column:
    ratio = F.least(n_evidence / F.lit(float(target)), F.lit(1.0)) if target > 0 else F.when(n_evidence > 0, 1.0).otherwise(0.0)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    return F.round(clamp(clamp(confidence) * F.lit(0.5) + grounded.cast("double") * F.lit(0.3) + ratio * F.lit(0.2)), 6)


def arm_stats(rewards: DataFrame, arms: DataFrame | None = None) -> DataFrame:
    """``arm, pulls, total, mean``; arms given but never pulled have zeros."""
    stats = rewards.groupBy("arm").agg(F.count("*").alias("pulls"), F.round(F.sum("reward"), 6).alias("total"))
    if arms is not None:
        stats = arms.join(stats, "arm", "left").withColumn("pulls", F.coalesce("pulls", F.lit(0)).cast("long")).withColumn("total", F.coalesce("total", F.lit(0.0)))
    return stats.withColumn("mean", F.when(F.col("pulls") > 0, F.round(F.col("total") / F.col("pulls"), 6)).otherwise(0.0))


def ucb_scores(stats: DataFrame, exploration: float = 2.0) -> DataFrame:
    """Upper confidence bounds; an arm never pulled has none and comes first."""
    whole = Window.partitionBy()
    bound = F.col("mean") + F.lit(exploration) * F.sqrt(F.log(F.sum("pulls").over(whole)) / F.col("pulls"))
    return stats.withColumn("ucb", F.when(F.col("pulls") > 0, F.round(bound, 6)))


def ucb_select(stats: DataFrame, exploration: float = 2.0) -> DataFrame:
    """The arm to pull next: the first never pulled by ``ordinal``, else that of the largest bound."""
    order = F.struct(F.col("ucb").isNull(), F.coalesce("ucb", F.lit(0.0)), -F.col("ordinal"))
    return ucb_scores(stats, exploration).agg(F.max_by(F.struct("arm", "ucb"), order).alias("b")).select("b.*")


def ab_test(rewards: DataFrame, a: str, b: str) -> DataFrame:
    """Means of two arms, the better one and its relative lift."""
    mean = lambda arm: F.round(F.avg(F.when(F.col("arm") == arm, F.col("reward"))), 6)
    row = rewards.agg(mean(a).alias("mean_a"), mean(b).alias("mean_b"))
    low, high = F.least("mean_a", "mean_b"), F.greatest("mean_a", "mean_b")
    return row.withColumn("winner", F.when(F.col("mean_a") >= F.col("mean_b"), a).otherwise(b)).withColumn("lift", F.round(F.when(low > 0, (high - low) / low).otherwise(0.0), 6))


FITNESS = dict(retrieval_quality=0.30, type_affinity=0.20, confidence_lift=0.15, diversity=0.15, latency_efficiency=0.10, recency=0.10)


def fitness(scores: dict[str, Column]) -> Column:
    """Weighted sum of six dimensions, in the order of FITNESS."""
    return F.round(sum((scores[k] * F.lit(w) for k, w in FITNESS.items()), F.lit(0.0)), 6)


def _parts(observations: DataFrame, alpha: float) -> tuple[DataFrame, DataFrame]:
    """Observations cut into ranges of each technique's order, and of each range ``technique, chunk, n, sum, first``.

    An exponential mean after a range is the one before it times (1 - alpha)^n, plus the range's ``sum``; so a technique
    of a long history is no single task's work.
    """
    rows = chunked(observations.select("technique", "seq", "value"), "technique", "seq")
    back = F.row_number().over(Window.partitionBy("technique", "chunk").orderBy(F.col("seq").desc())) - 1
    part = F.lit(alpha) * F.col("value") * F.pow(F.lit(1 - alpha), back)
    found = rows.withColumn("part", part).groupBy("technique", "chunk").agg(F.count("*").alias("n"), F.sum("part").alias("sum"), F.min_by("value", "seq").alias("first"))
    return rows, staged(found)


def ema(observations: DataFrame, alpha: float = 0.3) -> DataFrame:
    """``technique, fitness, observations``: exponential mean in the order of ``seq``, seeded by the first value."""
    _, parts = _parts(observations, alpha)
    # One row a technique and range from here on. The first value weighs 1 where others weigh alpha.
    after = F.coalesce(F.sum("n").over(Window.partitionBy("technique").orderBy(F.col("chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    decay = lambda n: F.pow(F.lit(1 - alpha), n)
    whole = parts.withColumn("part", F.col("sum") * decay(after)).groupBy("technique").agg(F.sum("part").alias("sum"), F.sum("n").alias("n"), F.min_by("first", "chunk").alias("first"))
    return whole.select("technique", F.round(F.col("sum") + F.col("first") * decay(F.col("n")), 6).alias("fitness"), F.col("n").alias("observations"))


def lifecycle_step(state: Column, value: Column, alpha: float = 0.3, trial: int = 10, preferred: float = 0.7, declining: float = 0.4, disabled: float = 0.2, streak: int = 5) -> Column:
    """State struct ``state, fitness, n, low`` after one more observation; one transition at most."""
    fit = F.when(state["n"] == 0, value).otherwise(F.lit(alpha) * value + F.lit(1 - alpha) * state["fitness"])
    n = state["n"] + 1
    low = F.when((state["state"] == "declining") & (fit < disabled), state["low"] + 1).when(state["state"] == "declining", 0).otherwise(state["low"])
    new = (
        F.when((state["state"] == "embryonic") & (n >= trial), "active")
        .when((state["state"] == "active") & (fit > preferred), "preferred")
        .when((state["state"] == "preferred") & (fit < declining), "declining")
        .when((state["state"] == "declining") & (fit < disabled) & (low >= streak), "disabled")
        .otherwise(state["state"])
    )
    return F.struct(new.alias("state"), fit.alias("fitness"), n.alias("n"), low.alias("low"))


def lifecycle(observations: DataFrame, alpha: float = 0.3, trial: int = 10, preferred: float = 0.7, declining: float = 0.4, disabled: float = 0.2, streak: int = 5) -> DataFrame:
    """``technique, state, fitness, observations`` after all observations in the order of ``seq``.

    There are few states, so each range of a technique's order, whose first fitness is known from the ranges before it,
    becomes a table of where every state would end up; the tables are then followed from range to range. No task holds
    more than a range; `lifecycle_step` gives the same rules one observation at a time.
    """
    rows, parts = _parts(observations, alpha)
    listed = parts.groupBy("technique").agg(F.array_sort(F.collect_list(F.struct("chunk", "n", "sum", "first"))).alias("parts"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("fitness"), F.array().cast("array<struct<chunk:int,n:long,fitness:double>>").alias("done"))

    def follow(s, x):
        first = F.when(s["n"] == 0, x["first"] * F.pow(F.lit(1 - alpha), x["n"])).otherwise(s["fitness"] * F.pow(F.lit(1 - alpha), x["n"]))
        here = F.struct(x["chunk"].alias("chunk"), s["n"].alias("n"), s["fitness"].alias("fitness"))
        return F.struct((s["n"] + x["n"]).alias("n"), (first + x["sum"]).alias("fitness"), F.array_append(s["done"], here).alias("done"))

    # Ranges are as many as shuffle partitions at most, whatever a technique's history is.
    ends = staged(listed.select("technique", F.aggregate("parts", start, follow).alias("e")))
    starts = ends.select("technique", F.explode("e.done").alias("c")).select("technique", "c.chunk", F.col("c.n").alias("before"), F.col("c.fitness").alias("start"))
    names = ["embryonic", "active", "preferred", *["declining"] * streak, "disabled"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", kind="stable")
        n, fit = int(pdf["before"].iloc[0]), float(pdf["start"].iloc[0])
        at = list(range(len(names)))
        for value in pdf["value"]:
            fit = float(value) if n == 0 else alpha * value + (1 - alpha) * fit
            n += 1
            moved = {}
            for s in set(at):
                if s == 0 and n >= trial:
                    moved[s] = 1
                elif s == 1 and fit > preferred:
                    moved[s] = 2
                elif s == 2 and fit < declining:
                    moved[s] = 3
                elif 3 <= s < 3 + streak:
                    moved[s] = s + 1 if fit < disabled else 3
            at = [moved.get(s, s) for s in at]
        return pd.DataFrame({"technique": [pdf["technique"].iloc[0]], "chunk": [int(pdf["chunk"].iloc[0])], "table": [at]})

    kind = observations.schema["technique"].dataType.simpleString()
    tables = rows.join(starts, ["technique", "chunk"]).groupBy("technique", "chunk").applyInPandas(run, f"technique {kind}, chunk int, table array<int>")
    steps = tables.groupBy("technique").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "table"))), lambda x: x["table"]).alias("tables"))
    last = steps.select("technique", F.aggregate("tables", F.lit(0), lambda s, t: t[s]).alias("at"))
    state = F.array(*map(F.lit, names))[F.col("at")]
    return ends.join(last, "technique").select("technique", state.alias("state"), F.round("e.fitness", 6).alias("fitness"), F.col("e.n").alias("observations"))


def fused_weights(lists: dict[str, DataFrame], weights: dict[str, float], rrf_k: float) -> DataFrame:
    """The fused list that a calibrated point stands for."""
    return rrf(lists, rrf_k, weights)


def piece_profile(docs: DataFrame, pieces) -> DataFrame:
    """One row: share of words of three pieces or more, mean pieces, share of technical and of split words.

    ``pieces(list of words) -> list of counts`` is a plug-in tokenizer; it sees each distinct word once.
    """

    @F.pandas_udf("int")
    def counted(words: pd.Series) -> pd.Series:
        return pd.Series(pieces(words.tolist()))

    words = docs.select(F.explode(T.found(F.col("text"), r"\w+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    rows = words.withColumn("p", counted("word"))
    share = lambda met: F.round(F.sum(F.when(met, F.col("n")).otherwise(0)) / F.sum("n"), 6)
    technical = F.col("word").rlike("^" + T.TECHNICAL + "$") | (F.length("word") > 12)
    return rows.agg(share(F.col("p") >= 3).alias("fragmented"), F.round(F.sum(F.col("p") * F.col("n")) / F.sum("n"), 6).alias("mean_pieces"), share(technical).alias("technical"), share(F.col("p") > 1).alias("unknown"))


def run_observation(n_evidence: Column, limit: int, seconds: Column) -> Column:
    """Fitness of a technique's run: evidence found, and time left of five seconds; the other dimensions count half."""
    half = F.lit(0.5)
    found = F.least(n_evidence / F.lit(float(max(limit, 1))), F.lit(1.0))
    return fitness({"retrieval_quality": found, "type_affinity": half, "confidence_lift": half, "diversity": half, "latency_efficiency": F.greatest(1 - seconds / 5, F.lit(0.0)), "recency": half})
