"""Retrieval over a bipartite graph of methods and families: lexical rows, families, one hop to neighbours.

Tables: ``methods(method_id, problem, solution, notes, language, tags, source)``,
``families(family_id, name, barcode, status, category, language, sources, origins)``,
``memberships(family_id, method_id, confidence, review_status)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.stage import staged
from .lexical import top_k


def search_methods(methods: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """``query_id, method_id, score, rank``: share of the query's tokens that a method's text has."""
    asked = queries.select("query_id", T.graph_tokens(F.col("query")).alias("q")).select("query_id", F.size("q").alias("n"), F.explode("q").alias("term"))
    text = F.concat_ws(" ", "problem", "solution", "notes", "language", F.array_join("tags", " "), "source")
    posted = methods.select("method_id", F.explode(T.graph_tokens(text)).alias("term"))
    scored = asked.join(posted, "term").groupBy("query_id", "method_id").agg(F.round(F.count("*") / F.first("n"), 6).alias("score"))
    return top_k(scored, k, "method_id")


def search_families(methods: DataFrame, families: DataFrame, memberships: DataFrame, queries: DataFrame, k: int = 5, approved_only: bool = True, expand: bool = True, rows: int = 3) -> DataFrame:
    """``query_id, family_id, method_id, score, source, reasons, rank``: families of the best methods, orphans, neighbours."""
    hits = search_methods(methods, queries, k * max(1, rows))
    links = memberships.join(families.select("family_id", "status"), "family_id")
    if approved_only:
        links = links.where("status = 'approved' and review_status = 'approved'")
    joined = hits.join(links.select("family_id", "method_id", "confidence"), "method_id", "left")
    score = F.round(F.col("score") + F.when(F.col("family_id").isNotNull(), F.least(F.greatest("confidence", F.lit(0.0)), F.lit(1.0)) * F.lit(0.05)).otherwise(0.0), 6)
    joined = joined.withColumn("score", score).withColumn("key", F.coalesce(F.concat(F.lit("family:"), "family_id"), F.concat(F.lit("methodology:"), "method_id")))
    best = F.max_by(F.struct("method_id", "family_id"), F.struct("score", -F.col("rank")))
    found = joined.groupBy("query_id", "key").agg(best.alias("b"), F.max("score").alias("score"))
    found = found.select("query_id", "key", "b.family_id", "b.method_id", "score", F.lit("direct").alias("source"), F.array().cast("array<string>").alias("reasons"))
    if expand:
        found = staged(found)
        found = _with_neighbours(methods, families, memberships, found, k, approved_only)
    return top_k(found, k, "key")


def family_edges(methods: DataFrame, families: DataFrame, memberships: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """``a, b, weight, reasons, only_category`` both ways, for pairs of weight 0.30 or more; ``a`` of the ``seeds`` (a table of family_id) alone, if given.

    A pair comes from an origin, source, category or token that both have; a language, which all families may share,
    weighs too little to make an edge, and is looked up for these pairs afterwards. For a stated set of seeds that is
    at most a row for each seed and family, however common a key is.
    """
    own = memberships.join(methods, "method_id")
    tagged = own.select("family_id", F.explode("tags").alias("tag"))
    of = lambda prefix: tagged.where(F.col("tag").startswith(prefix + ":")).select("family_id", F.substring_index("tag", ":", -1).alias("v"))
    kinds = {
        "origin": families.select("family_id", F.explode("origins").alias("v")),
        "source": families.select("family_id", F.explode("sources").alias("v")).unionByName(own.select("family_id", F.col("source").alias("v"))).unionByName(of("source")),
        "category": families.select("family_id", F.col("category").alias("v")).unionByName(of("category")),
        "language": families.select("family_id", F.col("language").alias("v")).unionByName(own.select("family_id", F.col("language").alias("v"))).unionByName(of("brain")),
    }
    keys = None
    for kind, rows in kinds.items():
        value = F.col("v") if kind == "origin" else F.lower("v")
        rows = rows.where("v is not null and v <> ''").select("family_id", F.lit(kind).alias("kind"), value.alias("v")).distinct()
        keys = rows if keys is None else keys.unionByName(rows)
    member = F.concat_ws(" ", "problem", "notes", own["language"], F.array_join("tags", " "), "source")
    named = F.concat_ws(" ", "name", F.translate("barcode", ":-", "  "), "category", "language", F.array_join("sources", " "))
    tokens = families.select("family_id", F.explode(T.graph_tokens(named)).alias("v")).unionByName(own.select("family_id", F.explode(T.graph_tokens(member)).alias("v"))).distinct()
    sizes = tokens.groupBy("family_id").agg(F.count("*").alias("n"))
    keys = keys.unionByName(tokens.select("family_id", F.lit("token").alias("kind"), "v"))
    keys = staged(keys)
    drawn = keys.where("kind <> 'language'")
    left = drawn if seeds is None else drawn.join(seeds.select("family_id").distinct(), "family_id", "left_semi")
    pairs = left.select(F.col("family_id").alias("a"), "kind", "v").join(drawn.select(F.col("family_id").alias("b"), "kind", "v"), ["kind", "v"]).where("a <> b")
    has = lambda kind: F.max((F.col("kind") == kind).cast("int"))
    words = F.array_sort(F.collect_set(F.when(F.col("kind") == "token", F.col("v"))))
    edges = pairs.groupBy("a", "b").agg(*[has(kind).alias(kind) for kind in kinds if kind != "language"], words.alias("words"))
    spoken = keys.where("kind = 'language'").groupBy("family_id").agg(F.collect_set("v").alias("spoken"))
    for side in "ab":
        edges = edges.join(spoken.select(F.col("family_id").alias(side), F.col("spoken").alias(f"l{side}")), side, "left")
    edges = edges.withColumn("language", F.coalesce(F.arrays_overlap("la", "lb"), F.lit(False)).cast("int")).drop("la", "lb")
    edges = edges.join(sizes.select(F.col("family_id").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("family_id").alias("b"), F.col("n").alias("nb")), "b", "left")
    shared = F.size("words")
    lexical = F.when(shared > 0, F.least(F.lit(0.65), F.lit(0.22) + shared / F.greatest(F.least("na", "nb"), F.lit(1)) * F.lit(1.4))).otherwise(0.0)
    weight = F.round(F.least(F.col("origin") * F.lit(0.95) + F.col("source") * F.lit(0.55) + F.col("category") * F.lit(0.58) + F.col("language") * F.lit(0.05) + lexical, F.lit(1.0)), 6)
    names = {"origin": "same_split_origin", "source": "shared_source", "category": "shared_category", "language": "shared_language"}
    listed = [F.when(F.col(k) == 1, F.lit(n)) for k, n in names.items()] + [F.when(shared > 0, F.concat(F.lit("lexical_overlap:"), F.array_join(F.slice("words", 1, 5), ",")))]
    alone = (F.col("category") == 1) & (F.col("origin") == 0) & (F.col("source") == 0) & (shared == 0)
    return edges.select("a", "b", weight.alias("weight"), F.array_compact(F.array(*listed)).alias("reasons"), alone.alias("only_category")).where("weight >= 0.30")


def _with_neighbours(methods, families, memberships, found: DataFrame, k: int, approved_only: bool) -> DataFrame:
    seeds = found.where("family_id is not null")
    edges = family_edges(methods, families, memberships, seeds)
    if approved_only:
        edges = edges.join(families.where("status = 'approved'").select(F.col("family_id").alias("b")), "b", "left_semi")
    seeds = seeds.select("query_id", F.col("family_id").alias("a"), F.col("score").alias("seed"))
    reach = seeds.join(edges, "a")
    # One edge by category alone counts for each seed: the first by family.
    nth = F.row_number().over(Window.partitionBy("query_id", "a", "only_category").orderBy("b"))
    reach = reach.withColumn("nth", nth).where("not only_category or nth = 1")
    score = F.round(F.greatest(F.col("seed") - (F.lit(0.09) - F.least("weight", F.lit(1.0)) * F.lit(0.06)), F.lit(0.0)), 6)
    reach = reach.select("query_id", F.col("b").alias("family_id"), score.alias("graph"), "seed", "a", F.concat(F.array(F.concat(F.lit("from:"), "a")), "reasons").alias("why"))
    # Equal scores go to the better seed, then to the first by name.
    best = reach.groupBy("query_id", "family_id").agg(F.max("graph").alias("graph"), F.min_by("why", F.struct(-F.col("graph"), -F.col("seed"), "a")).alias("why"))
    first = memberships.groupBy("family_id").agg(F.min("method_id").alias("first_method"))
    both = found.join(best, ["query_id", "family_id"], "full").join(first, "family_id", "left")
    old, better = F.col("score").isNotNull(), F.col("graph") > F.col("score")
    both = both.where(F.col("score").isNotNull() | F.col("first_method").isNotNull())
    both = both.select(
        "query_id", F.coalesce("key", F.concat(F.lit("family:"), "family_id")).alias("key"), "family_id", F.coalesce("method_id", "first_method").alias("method_id"),
        F.greatest("score", "graph").alias("score"),
        F.when(old & F.coalesce(better, F.lit(False)), "direct+graph").when(old, "direct").otherwise("graph").alias("source"),
        F.when(old & ~F.coalesce(better, F.lit(False)), F.col("reasons")).otherwise(F.col("why")).alias("reasons"),
    )
    new = top_k(both.where("source = 'graph'"), k, "key").drop("rank")
    return both.where("source <> 'graph'").unionByName(new)


CATEGORIES = (("testing", "test|spec"), ("cli_ux", "cli|command"), ("api", "api|route|server"), ("persistence", "db|schema|store"), ("retrieval", "rag|retriev|search"), ("configuration", "config|settings"))


def path_category(path):
    """Category of a source file by the first group of words that its lower-cased path has."""
    out = None
    for name, words in CATEGORIES:
        met = F.lower(path).rlike(words)
        out = F.when(met, name) if out is None else out.when(met, name)
    return out.otherwise("implementation")
