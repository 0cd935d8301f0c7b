"""Stored tables: the graph, the index of three levels, golden questions, baselines, routing rules, bandit rewards."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

GRAPH = {
    "methods": "method_id string, problem string, solution string, notes string, language string, tags array<string>, source string",
    "families": "family_id string, name string, barcode string, status string, category string, language string, sources array<string>, origins array<string>",
    "memberships": "family_id string, method_id string, confidence double, review_status string",
}


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in GRAPH.items()}


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    for name in GRAPH:
        tables[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_graph_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """One JSON document with the lists ``methods``, ``families`` and ``memberships``."""
    fields = ", ".join(f"{name} array<struct<{schema.replace(' string', ':string').replace(' double', ':double').replace(' array', ':array')}>>" for name, schema in GRAPH.items())
    raw = spark.read.schema(fields).json(path, multiLine=True)
    return {name: raw.select(F.inline(name)) for name in GRAPH}


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


INDEX = ("documents", "profiles", "entries", "derivatives", "adapters", "doc_metadata", "doc_titles")


def write_index(entries: DataFrame, derived: DataFrame, path: str, dim: int, **more: DataFrame) -> None:
    """An index of three levels and what goes with it (names of INDEX), as one version that replaces the one before.

    Entries are partitioned by level, so that a search of one level reads that level alone; the dimension goes along.
    """
    if unknown := set(more) - set(INDEX):
        raise ValueError(f"an index has no tables {sorted(unknown)}")
    store.write_tables(entries.sparkSession, path, {"entries": entries, "derivatives": derived, **more}, {"entries": "level"}, dim=dim)


def read_index_tables(spark: SparkSession, path: str, dim: int | None = None) -> dict[str, DataFrame]:
    """All tables of the stored index; ValueError if its vectors have another dimension than ``dim``."""
    found, facts = store.read_tables(spark, path)
    if dim is not None and facts["dim"] != dim:
        raise ValueError(f"the index has vectors of {facts['dim']} dimensions, not {dim}")
    return found


def read_index(spark: SparkSession, path: str, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and derivatives of the stored index."""
    found = read_index_tables(spark, path, dim)
    return found["entries"], found["derivatives"]


def write_graph_store(tables: dict[str, DataFrame], path: str) -> None:
    """The graph's three tables as one version that replaces the one before."""
    store.write_tables(next(iter(tables.values())).sparkSession, path, {name: tables[name] for name in GRAPH})


def read_graph_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return store.read_tables(spark, path)[0]


def seed_graph(spark: SparkSession) -> dict[str, DataFrame]:
    """Three methods, three families and three memberships to try the graph with."""
    methods = [
        ("m-retry", "calls to a remote service fail now and then", "retry with growing pauses", "stop after five", "python", ["category:resilience"], "seed"),
        ("m-cache", "the same lookup is paid for again and again", "keep results by key until they expire", "", "python", ["category:performance"], "seed"),
        ("m-shard", "one table outgrows a machine", "split rows by a hash of the key", "", "sql", ["category:scale"], "seed"),
    ]
    families = [(f"f-{name}", name.title(), f"{name}:{i}", "approved", name, language, ["seed"], [f"o{i}"]) for i, (name, language) in enumerate((("resilience", "python"), ("performance", "python"), ("scale", "sql")))]
    links = [(f[0], m[0], 0.9 - i / 10, "approved") for i, (f, m) in enumerate(zip(families, methods))]
    return {n: spark.createDataFrame(rows, GRAPH[n]) for n, rows in zip(GRAPH, (methods, families, links))}


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions from JSON lines: ``id, question, expected_sources, expected_terms, no_evidence``.

    Missing ids are ``q`` and the line's number among the file's lines, which takes one pass in the file's order.
    """
    fields = "id string, question string, expected_sources array<string>, expected_terms array<string>, must_include array<string>, no_evidence boolean, should_answer boolean"
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("at", F.monotonically_increasing_id())
    lines = lines.withColumn("n", F.row_number().over(Window.orderBy("at")))
    rows = lines.select("n", F.from_json("value", fields).alias("r")).select("n", "r.*")
    none = F.array().cast("array<string>")
    return rows.select(
        F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("q"), "n")).alias("id"), "question", F.coalesce("expected_sources", none).alias("expected_sources"),
        F.coalesce("expected_terms", "must_include", none).alias("expected_terms"), F.coalesce("no_evidence", ~F.col("should_answer"), F.lit(False)).alias("no_evidence"),
    )


def write_golden(golden: DataFrame, path: str) -> None:
    """Golden questions as JSON lines, which `read_golden` reads again."""
    golden.select(F.to_json(F.struct("id", "question", "expected_sources", "expected_terms", "no_evidence")).alias("value")).write.mode("overwrite").text(path)


BASELINES = "task string, config string, metric string, value double, timestamp string"


def read_baselines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BASELINES).json(path, multiLine=True)


def write_baselines(baselines: DataFrame, path: str) -> None:
    """A JSON array in the order of task and config: a report of a few rows, replaced in one step."""
    store.write_json(baselines.sparkSession, path, [r.asDict() for r in baselines.orderBy("task", "config").toLocalIterator()])


def write_summary(summary: DataFrame, path: str, **facts) -> None:
    """A report of a few rows, and facts about it, as one JSON document."""
    store.write_json(summary.sparkSession, path, {**facts, "rows": [r.asDict(recursive=True) for r in summary.toLocalIterator()]})


def read_rules(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Aliases (term, target) and routing rules (ordinal, domain, keyword, boost, reason) from YAML or JSON."""
    raw = store.read_text(spark, path)
    try:
        spec = json.loads(raw)
    except ValueError:
        import yaml

        spec = yaml.safe_load(raw)
    aliases = [(a, t) for a, targets in (spec.get("aliases") or {}).items() for t in targets]
    rules = [
        (i, r.get("domain", ""), k, float(r.get("boost", 1.5)), r.get("reason", "routing rule applied")) for i, r in enumerate(spec.get("routing") or []) for k in r.get("keywords", [])
    ]
    return spark.createDataFrame(aliases, "term string, target string"), spark.createDataFrame(rules, "ordinal int, domain string, keyword string, boost double, reason string")


ARMS = "arm string, techniques array<string>, pulls long, total double"
#: Arms that a bandit starts with, as sets of steps.
FIRST_ARMS = {
    "search": "sparse_bm25 dense_vector rrf_fusion",
    "search_rerank": "sparse_bm25 dense_vector rrf_fusion cross_encoder_rerank",
    "search_expand": "sparse_bm25 dense_vector rrf_fusion query_expansion",
    "search_score": "sparse_bm25 dense_vector rrf_fusion moe_importance_scoring selective_filter",
}


def first_arms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, t.split(), 0, 0.0) for a, t in FIRST_ARMS.items()], ARMS)


def with_arm(arms: DataFrame, name: str, techniques: list[str]) -> DataFrame:
    """Arms and one more, which starts anew if its name is taken."""
    return upsert(arms, arms.sparkSession.createDataFrame([(name, techniques, 0, 0.0)], ARMS), "arm")


def rewarded(arms: DataFrame, rewards: DataFrame) -> DataFrame:
    """Arms after rewards ``arm, reward``; rewards of unknown arms are left out."""
    more = rewards.groupBy("arm").agg(F.count("*").alias("n"), F.sum("reward").alias("s"))
    rows = arms.join(more, "arm", "left")
    return rows.select("arm", "techniques", (F.col("pulls") + F.coalesce("n", F.lit(0))).alias("pulls"), (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("total"))


def write_arms(arms: DataFrame, path: str) -> None:
    store.write_json(arms.sparkSession, path, [r.asDict() for r in arms.orderBy("arm").toLocalIterator()])


def read_arms(spark: SparkSession, path: str) -> DataFrame:
    """Arms as they were saved; the first ones where nothing is saved yet."""
    if not store.exists(spark, path):
        return first_arms(spark)
    return spark.createDataFrame([tuple(r[k] for k in ("arm", "techniques", "pulls", "total")) for r in store.read_json(spark, path)], ARMS)
