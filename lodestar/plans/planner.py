"""Choice and composition of techniques: registry, strategies, router, and the engine that answers tables of questions."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import questions as Q
from ..functions import text as T
from ..operators import answers, fusion, lexical, verify
from ..sources.stage import staged


@dataclass(frozen=True)
class Technique:
    """A step's name, what it depends on, and when it is of use."""

    name: str
    needs: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    least_corpus: int = 0


class Registry:
    """Techniques by name; a name that is taken, or a dependency that is unknown, is a ValueError."""

    def __init__(self):
        self._known: dict[str, Technique] = {}

    def register(self, technique: Technique) -> None:
        if technique.name in self._known:
            raise ValueError(f"{technique.name} is registered already")
        if missing := [n for n in technique.needs if n not in self._known]:
            raise ValueError(f"{technique.name} needs {missing}, which are not registered")
        self._known[technique.name] = technique

    def names(self) -> list[str]:
        return sorted(self._known)

    def compose(self, kind: str, corpus_size: int = 10, enabled: set[str] | None = None) -> list[str]:
        """Names of the steps that apply, each after what it needs; steps whose needs don't apply are left out."""
        fits = {n for n, t in self._known.items() if (enabled is None or n in enabled) and (not t.kinds or kind in t.kinds) and corpus_size >= t.least_corpus}
        order: list[str] = []
        for name, technique in self._known.items():  # registration order has dependencies first
            if name in fits and all(n in order for n in technique.needs):
                order.append(name)
        return order


@dataclass(frozen=True)
class Strategy:
    """Weights, depth, steps and the share of a reranker's score."""

    name: str
    dense_weight: float
    sparse_weight: float
    depth: int
    steps: tuple[str, ...]
    blend: float = 1.0


_SCORING = "moe_importance_scoring accuracy_contracts selective_filter complexity_routing"
_DENSE = tuple(f"hyde_expansion dense_vector dense_to_evidence {_SCORING} cross_encoder_rerank score_normalize".split())
_FULL = tuple(
    f"""sparse_bm25 bm25_antiflood hyde_expansion dense_vector adaptive_fusion_weights rrf_fusion intersection_boost title_boost {_SCORING}
    query_expansion query_decompose cross_encoder_rerank reciprocal_neighbor_rerank multi_hop_retrieval score_normalize""".split()
)
#: Steps after which the evidence, a few rows a question, is written: later steps read it several times each.
_STAGED = {"rrf_fusion", "dense_to_evidence", "complexity_routing", "query_expansion", "query_decompose", "multi_hop_retrieval"}
#: Steps that need no evidence yet.
_SEARCH = tuple("sparse_bm25 bm25_antiflood hyde_expansion dense_vector adaptive_fusion_weights rrf_fusion dense_to_evidence".split())
STRATEGIES: dict[str, Strategy] = {
    s.name: s
    for s in (
        Strategy("dense_only", 1.0, 0.0, 100, ("dense_vector", "dense_to_evidence", "score_normalize")),
        Strategy("dense_dominant", 1.0, 0.0, 100, _DENSE),
        Strategy("hybrid", 0.6, 0.4, 100, _FULL),
        Strategy("strong_hybrid", 0.7, 0.3, 100, _FULL),
        Strategy("sparse_boost", 0.3, 0.7, 150, _FULL),
        Strategy("blended_rerank", 1.0, 0.0, 100, _DENSE, 0.2),
    )
}
TIERS = dict(weak="sparse_boost", moderate="hybrid", strong="dense_dominant")


def register_strategy(strategy: Strategy) -> None:
    STRATEGIES[strategy.name] = strategy


def choose(tier: str, wanted: str = "auto", corpus_size: int | None = None) -> Strategy:
    """The strategy wanted by name (KeyError if unknown), or that of a tier of embeddings, adjusted to the corpus."""
    if wanted != "auto":
        if wanted not in STRATEGIES:
            raise KeyError(f"no strategy {wanted!r}; there are {sorted(STRATEGIES)}")
        return STRATEGIES[wanted]
    name = TIERS.get(tier, "hybrid")
    if corpus_size is not None:
        if tier == "strong":
            name = "blended_rerank"
        elif name == "sparse_boost" and corpus_size < 1_000:
            name = "hybrid"
    return STRATEGIES[name]


@dataclass(frozen=True)
class Context:
    """What steps read and make, as tables; no step changes what another has made."""

    docs: DataFrame
    queries: DataFrame
    limit: int = 10
    strategy: Strategy = STRATEGIES["hybrid"]
    searches: Mapping[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = field(default_factory=dict)
    reranker: Callable[[DataFrame], DataFrame] | None = None
    rewriter: Callable[[DataFrame], DataFrame] | None = None
    generator: Callable[[DataFrame], DataFrame] | None = None
    ensemble: Mapping[str, float] = field(default_factory=dict)
    vectors: DataFrame | None = None
    expanded: DataFrame | None = None
    lists: Mapping[str, DataFrame] = field(default_factory=dict)
    weights: DataFrame | None = None
    evidence: DataFrame | None = None
    index: lexical.Index | None = None

    @property
    def corpus(self) -> lexical.Docs:
        """The documents' stored index, which a run makes; outside of one, the documents."""
        return self.docs if self.index is None else self.index

    @property
    def asked(self) -> DataFrame:
        return self.queries if self.expanded is None else self.expanded


Step = Callable[[Context], Context]
STEPS: dict[str, Step] = {}


def step(name: str):
    """Registers a step under a name; own steps are added the same way."""

    def add(f: Step) -> Step:
        STEPS[name] = f
        return f

    return add


def _scored(c: Context) -> DataFrame:
    rows = lexical.of_documents(c.evidence, c.docs, "text")
    score = T.complexity(T.complexity_parts(F.col("text")))
    votes = T.panel_votes(F.col("text"))
    rows = rows.withColumn("complexity_score", F.bround(score, 4)).withColumn("votes", F.struct(*(v.alias(k) for k, v in votes.items()))).drop("text")
    own = {k: F.col(f"votes.{k}") for k in T.PANEL}
    return rows.withColumn("panel_score", T.panel_mean(own)).withColumn("store_score", T.panel_storage(own, F.col("complexity_score")))


def _votes() -> dict:
    return {k: F.col(f"votes.{k}") for k in T.PANEL}


@step("sparse_bm25")
def _sparse(c):
    return replace(c, lists={**c.lists, "sparse": lexical.bm25(c.corpus, c.asked, max(c.limit, c.strategy.depth), tokens=T.plain_tokens)})


@step("bm25_antiflood")
def _antiflood(c):
    return replace(c, lists={**c.lists, "sparse": lexical.antiflood(c.corpus, c.asked, c.lists["sparse"])}) if "sparse" in c.lists else c


@step("hyde_expansion")
def _hyde(c):
    return replace(c, expanded=c.rewriter(c.queries)) if c.rewriter else c


@step("dense_vector")
def _dense(c):
    """Plug-in searches by name; names that start with plugin_ weigh 0.1 each, others are dense lists."""
    return replace(c, lists={**c.lists, **{n: f(c.docs, c.asked, max(c.limit, c.strategy.depth)) for n, f in c.searches.items()}})


@step("adaptive_fusion_weights")
def _weights(c):
    return replace(c, weights=fusion.idf_weights(c.corpus, c.asked, c.strategy.sparse_weight))


@step("rrf_fusion")
def _fuse(c):
    dense_names = [n for n in c.lists if n != "sparse" and not n.startswith("plugin_")]
    lists = {}
    for name, hits in c.lists.items():
        side = "sparse_weight" if name == "sparse" else "dense_weight"
        share = 1 if name == "sparse" else max(1, len(dense_names))
        if name.startswith("plugin_"):
            lists[name] = hits.withColumn("weight", F.lit(0.1))
        elif name in c.ensemble:
            lists[name] = hits.withColumn("weight", F.lit(float(c.ensemble[name])))
        elif c.weights is not None:
            lists[name] = hits.join(c.weights.select("query_id", (F.col(side) / share).alias("weight")), "query_id")
        else:
            lists[name] = hits.withColumn("weight", F.lit(getattr(c.strategy, side) / share))
    fused = fusion.rrf(lists, k=c.limit)
    return replace(c, evidence=lexical.matched_terms(c.corpus, c.asked, fused))


@step("dense_to_evidence")
def _direct(c):
    names = [n for n in c.lists if n != "sparse"]
    if not names:
        return c
    hits = c.lists[names[0]].where(F.col("rank") <= c.limit)
    of = lambda column: F.create_map(F.lit(names[0]), column)
    rows = hits.withColumn("source_ranks", of("rank")).withColumn("source_scores", of("score")).withColumn("rank", F.col("rank") - 1)
    return replace(c, evidence=lexical.matched_terms(c.corpus, c.asked, rows))


@step("intersection_boost")
def _both(c):
    return replace(c, evidence=fusion.intersection_boost(c.evidence))


@step("title_boost")
def _titles(c):
    return replace(c, evidence=fusion.title_boost(c.evidence, c.queries, c.docs)) if "title" in c.docs.columns else c


@step("moe_importance_scoring")
def _panel(c):
    return replace(c, evidence=_scored(c)) if "votes" not in c.evidence.columns else c


@step("accuracy_contracts")
def _contracts(c):
    rows = c.evidence.withColumn("contract", T.contract_tier(_votes())).withColumn("concept", T.concept_type(_votes()))
    return replace(c, evidence=rows.withColumn("role", T.emergence_role(_votes())))


@step("selective_filter")
def _select(c):
    rows = c.evidence.withColumn("accuracy", F.col("votes.accuracy_criticality")).withColumn("reproducibility", F.col("votes.reproducibility"))
    return replace(c, evidence=fusion.selective_filter(rows).drop("accuracy", "reproducibility"))


@step("complexity_routing")
def _route(c):
    return replace(c, evidence=c.evidence.withColumn("routing", T.routing_tag(F.col("complexity_score"), F.col("panel_score"))))


@step("query_expansion")
def _expand(c):
    """Searches again with frequent terms of the first hits; earlier boosts and plug-in lists start anew."""
    terms = lexical.expansion_terms(c.corpus, c.asked, c.evidence.withColumn("rank", F.col("rank") + 1), tokens=T.plain_tokens)
    again = replace(c, expanded=lexical.expanded_queries(c.asked, terms), lists={})
    for name in "sparse_bm25 dense_vector rrf_fusion".split():
        again = STEPS[name](again)
    kept = [n for n in ("moe_importance_scoring", "accuracy_contracts", "complexity_routing") if "votes" in c.evidence.columns]
    for name in kept:
        again = STEPS[name](again)
    return again


@step("query_decompose")
def _decompose(c):
    found = lexical.decompose_merge(c.corpus, c.queries, c.evidence).drop("part")
    return replace(c, evidence=found.join(c.evidence.drop("score", "rank"), ["query_id", "doc_id"], "left"))


@step("cross_encoder_rerank")
def _rerank(c):
    """``reranker`` takes query_id, doc_id, query, text and adds ``reranked``; documents routed fast are not sent."""
    if c.reranker is None:
        return c
    rows = c.evidence
    pairs = rows.where(F.coalesce("routing", F.lit("standard")) != "fast") if "routing" in rows.columns else rows
    sent = lexical.of_documents(pairs.select("query_id", "doc_id").join(c.queries, "query_id"), c.docs, "text")
    rows = rows.join(c.reranker(sent).select("query_id", "doc_id", "reranked"), ["query_id", "doc_id"], "left")
    return replace(c, evidence=fusion.blended(rows, F.coalesce("reranked", "score"), c.strategy.blend).drop("reranked"))


@step("reciprocal_neighbor_rerank")
def _coherent(c):
    return replace(c, evidence=fusion.coherence_boost(c.evidence, c.vectors)) if c.vectors is not None else c


@step("multi_hop_retrieval")
def _hops(c):
    found = lexical.multi_hop(c.corpus, c.queries, c.evidence, limit=c.limit)
    return replace(c, evidence=found.drop("hop").join(c.evidence.drop("score", "rank"), ["query_id", "doc_id"], "left"))


@step("score_normalize")
def _normalise(c):
    return replace(c, evidence=fusion.score_normalize(c.evidence))


@step("confidence_scoring")
def _confidence(c):
    scored = verify.confidence(c.evidence, c.queries).select("query_id", "confidence")
    return replace(c, queries=c.queries.drop("confidence").join(scored, "query_id"))


@step("citation_grounding")
def _grounding(c):
    rows = lexical.of_documents(c.evidence, c.docs, "source")
    found = verify.grounded(rows, rows, c.queries, required=False).select("query_id", "grounded")
    return replace(c, queries=c.queries.drop("grounded").join(found, "query_id"))


@step("generation")
def _generate(c):
    """Answers by ``generator``, which takes query_id, prompt and adds ``answer``; template answers where it has none, or isn't given."""
    rows = lexical.of_documents(c.evidence, c.docs, "title", "text")
    if c.generator is not None:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
        said = c.generator(answers.prompts(rows, c.queries.select("query_id", "query"), contracts="contract" in rows.columns)).select("query_id", F.col("answer").alias("said"))
        plain = answers.template_answers(rows, c.queries.select("query_id", "query")).join(said, "query_id", "left")
        return replace(c, queries=c.queries.drop("answer").join(plain.select("query_id", F.coalesce("said", "answer").alias("answer")), "query_id"))
    return replace(c, queries=c.queries.drop("answer").join(answers.template_answers(rows, c.queries.select("query_id", "query")), "query_id"))


@step("etf_verification")
def _tension(c):
    rows = lexical.of_documents(c.evidence, c.docs, "text")
    return replace(c, queries=c.queries.join(verify.tension(c.queries.select("query_id", "answer"), rows), "query_id"))


def run(context: Context, steps: list[str] | tuple[str, ...] | None = None) -> Context:
    """The context after its strategy's steps, or those given; an unknown name is a KeyError."""
    context = replace(context, index=context.index or lexical.Index(context.docs))
    for name in steps or context.strategy.steps:
        if name not in STEPS:
            raise KeyError(f"no step {name!r}")
        if context.evidence is None and name not in _SEARCH:
            continue
        context = STEPS[name](context)
        if name in _STAGED and context.evidence is not None:
            context = replace(context, evidence=staged(context.evidence))
    return context


def answer(docs: DataFrame, queries: DataFrame, limit: int = 5, strategy: str = "hybrid", **parts) -> DataFrame:
    """``query_id, answer, confidence, grounded, kind, citations`` for a table of questions over ``docs``.

    ``docs`` is doc_id, text, source, title. The static path: search, fuse, score, cite, answer.
    """
    asked = queries.select("query_id", F.trim("query").alias("query")).where(F.length("query").between(1, Q.MOST_CHARS))
    c = run(Context(docs, asked, limit, STRATEGIES[strategy], **parts), tuple("sparse_bm25 dense_vector rrf_fusion confidence_scoring citation_grounding generation".split()))
    cited = answers.citations(lexical.of_documents(c.evidence, docs, "source", "text"))
    listed = cited.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("score", "doc_id", "source", "excerpt")), False).alias("citations"))
    return c.queries.join(listed, "query_id", "left").select("query_id", "answer", "confidence", "grounded", Q.simple_type(F.col("query")).alias("kind"), "citations")


def evaluate_folder(spark: SparkSession, folder: str, golden: str, limit: int = 5, k: int = 5, **parts) -> tuple[DataFrame, DataFrame]:
    """Metrics of each golden question of a JSON-lines file over a folder's documents, and their summary."""
    from ..sources.files import read_folder
    from ..sources.tables import read_golden

    docs = staged(read_folder(spark, folder).select("doc_id", "text", "source", "title"))
    asked = read_golden(spark, golden)
    found = answer(docs, asked.select(F.col("id").alias("query_id"), F.col("question").alias("query")), limit, **parts)
    sources = F.transform("citations", lambda c: c["source"])
    said = F.concat_ws(" ", "answer", F.array_join(F.transform("citations", lambda c: c["excerpt"]), " "))
    results = staged(found.select(F.col("query_id").alias("id"), said.alias("answer"), sources.alias("retrieved"), sources.alias("cited")))
    each = verify.evaluate(asked, results, k)
    return each, verify.summary(each)
