"""Retrieval over an index of three levels: sentences (0), paragraphs (1), documents (2).

Entries are ``entry_id, level, parent, vec`` (parent null for documents), derivatives ``entry_id, d1, d2``; queries are
``query_id, vec`` and, where a kind matters, ``kind``.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import questions as Q
from ..functions.vectors import dot
from .dense import matrix, over_blocks
from .forward import CELLS, first_of_rows, places
from .lexical import top_k

DERIVATIVE = 0.12


def gaussian_embeddings(rows: DataFrame, dim: int = 64) -> DataFrame:
    """``rows`` (with ``text``) and ``vec``: a unit vector drawn from a generator seeded by the text's MD5; no meaning, but stable."""

    @F.pandas_udf("array<float>")
    def draw(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            seed = int(hashlib.md5((text or "").encode()).hexdigest(), 16) % 2**32
            v = np.random.default_rng(seed).standard_normal(dim).astype(np.float32)
            out.append(v / np.linalg.norm(v))
        return pd.Series(out)

    return rows.withColumn("vec", draw("text"))


def derivatives(entries: DataFrame) -> DataFrame:
    """``entry_id, d1, d2`` of sentences: away from the weighted mean of the document's paragraphs, and the change of that.

    A paragraph weighs its dot product with the document, 0.1 at least. All of a document meet by one aggregate.
    """
    from ..functions.vectors import normalised

    docs = entries.where("level = 2").select(F.col("entry_id").alias("doc"), F.col("vec").cast("array<double>").alias("dv"))
    paras = entries.where("level = 1").select(F.col("parent").alias("doc"), F.col("vec").cast("array<double>").alias("pv")).join(docs, "doc")
    paras = paras.withColumn("w", F.greatest(dot(F.col("pv"), F.col("dv")), F.lit(0.1)))
    mean = paras.select("doc", "w", F.posexplode("pv").alias("i", "x")).groupBy("doc", "i").agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("x"))
    mean = mean.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("mean"))
    rows = entries.where("level = 0").select("entry_id", F.col("parent").alias("doc"), F.col("vec").cast("array<double>").alias("sv")).join(docs, "doc").join(mean, "doc")
    less = lambda a, b: F.zip_with(a, b, lambda x, y: x - y)
    rows = rows.withColumn("d1", normalised(less("sv", "mean")))
    return rows.select("entry_id", "d1", normalised(less("d1", less("sv", "dv"))).alias("d2"))


def _entries(entries: DataFrame, derived: DataFrame | None) -> DataFrame:
    rows = entries.where("vec is not null").select("entry_id", F.col("level").cast("int").alias("level"), F.coalesce("parent", "entry_id").alias("doc_id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows if derived is None else rows.join(derived.select("entry_id", "d1", "d2"), "entry_id", "left")


def _products(batch, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity and derivative bonus, [query, entry], of an Arrow batch of `_entries`."""
    sim = queries @ matrix(batch.column("vec"), queries.shape[1]).T
    bonus = np.zeros_like(sim)
    for name, weight in (("d1", DERIVATIVE), ("d2", DERIVATIVE * 0.6)) if "d1" in batch.schema.names else ():
        column = batch.column(name)
        some = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
        if len(some):
            bonus[:, some] += weight * (queries @ matrix(column.drop_null(), queries.shape[1]).T)
    return sim, bonus


def _slices(batches, width: int):
    """Pieces of the batches whose products with so many queries take CELLS cells at most."""
    for batch in batches:
        rows = max(1, CELLS // max(1, width))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def similarities(entries: DataFrame, queries: DataFrame, derived: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, level, sim, bonus, both`` for a stated set of queries: of each document's entries of a level the largest similarity, bonus, and sum of them. These are pairs, so only for tables that bear them.

    Blocks of queries multiply Arrow batches of entries, and each batch is reduced to its documents before any row
    leaves it, so that vectors are never carried along with pairs.
    """
    rows = _entries(entries, derived)
    kinds = queries.schema["query_id"].dataType, rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kinds[0])

    def of(block):
        def run(batches):
            ids, q, _ = block.value
            asked = pa.array(ids, id_type)
            for batch in _slices(batches, len(q)):
                sim, bonus = _products(batch, q)
                groups = batch.select(["doc_id", "level"]).to_pandas().groupby(["doc_id", "level"], sort=False)
                order = np.argsort(groups.ngroup().to_numpy(), kind="stable")
                sizes = np.bincount(groups.ngroup().to_numpy())
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                first = pa.array(order[starts])
                best = [np.maximum.reduceat(x[:, order], starts, axis=1).ravel() for x in (sim, bonus, sim + bonus)]
                of_query = pa.array(np.repeat(np.arange(len(q)), len(starts)))
                of_group = pa.array(np.tile(np.arange(len(starts)), len(q)))
                docs, levels = (batch.column(c).take(first).take(of_group) for c in ("doc_id", "level"))
                yield pa.RecordBatch.from_arrays([asked.take(of_query), docs, levels, *map(pa.array, best)], ["query_id", "doc_id", "level", "sim", "bonus", "both"])

        return run

    found = over_blocks(rows, queries, of, f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, level int, sim double, bonus double, both double")
    return found.groupBy("query_id", "doc_id", "level").agg(*[F.max(c).alias(c) for c in ("sim", "bonus", "both")])


def by_level(entries: DataFrame, queries: DataFrame, derived: DataFrame | None = None, levels: list[int] | None = None) -> DataFrame:
    """``query_id, level, entry_id, score, rank``: the best entries of each level, weighed and counted by the query's kind.

    Each Arrow batch gives the best of a query and level alone, which the last sort then merges.
    """
    rows = _entries(entries.where(F.col("level").isin(levels)) if levels else entries, derived)
    w = Q.level_weights(F.col("kind"))
    asked = queries.select("query_id", "vec", *[w[c].alias(c) for c in ("w0", "w1", "w2", "deriv", "k")])
    kinds = queries.schema["query_id"].dataType, rows.schema["entry_id"].dataType
    id_type = to_arrow_type(kinds[0])

    def of(block):
        def run(batches):
            ids, q, more = block.value
            asked = pa.array(ids, id_type)
            weights = np.array([more["w0"], more["w1"], more["w2"]], float)
            most = np.array(more["k"], int)
            for batch in _slices(batches, len(q)):
                sim, bonus = _products(batch, q)
                level = batch.column("level").to_numpy(zero_copy_only=False)
                names = batch.column("entry_id")
                place = np.argsort(np.array(names.to_pylist(), dtype=object), kind="stable").argsort()
                score = np.round(sim * weights[level].T + bonus * np.array(more["deriv"], float)[:, None], 6)
                for n in np.unique(level):
                    own = np.flatnonzero(level == n)
                    row, column = first_of_rows(score[:, own], place[own], int(most.max()))
                    column = own[column]
                    yield pa.RecordBatch.from_arrays(
                        [asked.take(pa.array(row)), pa.array(np.full(len(row), n, np.int32)), names.take(pa.array(column)), pa.array(score[row, column]), pa.array(most[row].astype(np.int32))],
                        ["query_id", "level", "entry_id", "score", "k"],
                    )

        return run

    found = over_blocks(rows, asked, of, f"query_id {kinds[0].simpleString()}, level int, entry_id {kinds[1].simpleString()}, score double, k int", "w0", "w1", "w2", "deriv", "k")
    order = Window.partitionBy("query_id", "level").orderBy(F.col("score").desc(), "entry_id")
    return found.withColumn("rank", F.row_number().over(order)).where("rank <= k").drop("k")


class _Spool:
    """All entries that a task reads: vectors in a file, and of each level the order that has a document's entries together.

    ``docs`` are the documents, by id.
    """

    def __init__(self, batches, dim: int, boosted: bool):
        self.file, ids, levels, boosts, self.derived = tempfile.TemporaryFile(), [], [], [], None
        self.kind, self.n = None, 0
        for batch in batches:
            column = batch.column("vec")
            self.kind = self.kind or (np.float32 if pa.types.is_float32(column.type.value_type) else np.float64)
            self.file.write(matrix(column, dim).astype(self.kind).tobytes())
            if "d1" in batch.schema.names:
                self.derived = self.derived or tempfile.TemporaryFile()
                moved = np.zeros((batch.num_rows, dim))
                for name, weight in (("d1", DERIVATIVE), ("d2", DERIVATIVE * 0.6)):
                    some = np.flatnonzero(batch.column(name).is_valid().to_numpy(zero_copy_only=False))
                    if len(some):
                        moved[some] += weight * matrix(batch.column(name).drop_null(), dim)
                self.derived.write(moved.tobytes())
            ids.append(batch.column("doc_id"))
            levels.append(batch.column("level").to_numpy(zero_copy_only=False))
            if boosted:
                boosts.append(batch.column("boost").to_numpy(zero_copy_only=False).astype(float))
            self.n += batch.num_rows
        if self.n:
            every = pa.concat_arrays(ids)
            code = places(every) - 1
            first = np.unique(code, return_index=True)[1]
            self.docs, self.dim = every.take(pa.array(first)), dim
            self.boost = np.concatenate(boosts)[first] if boosted else np.zeros(len(first))
            self.levels = {}
            for level in np.unique(levels := np.concatenate(levels)):
                own = np.flatnonzero(levels == level)
                own = own[np.argsort(code[own], kind="stable")]
                held, starts = np.unique(code[own], return_index=True)
                self.levels[int(level)] = own, held, starts

    def _products(self, file, kind, queries: np.ndarray) -> np.ndarray:
        file.flush()
        rows, out = np.memmap(file, kind, "r", shape=(self.n, self.dim)), np.empty((len(queries), self.n))
        for at in range(0, self.n, step := max(1, CELLS // self.dim)):
            out[:, at : at + step] = queries @ np.asarray(rows[at : at + step], float).T
        return out

    def best(self, queries: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By level: the documents that have it, and [query, document] the largest similarity, bonus and sum of them."""
        sim = self._products(self.file, self.kind, queries)
        bonus = self._products(self.derived, np.float64, queries) if self.derived else None
        out = {}
        for level, (own, held, starts) in self.levels.items():
            most = lambda x: np.maximum.reduceat(x[:, own], starts, axis=1)  # noqa: E731, B023
            alone = most(sim)
            out[level] = (held, alone, np.zeros_like(alone), alone) if bonus is None else (held, alone, most(bonus), most(sim + bonus))
        return out


def _flat(best: dict, spool: _Spool) -> tuple[np.ndarray, np.ndarray]:
    held, sim, *_ = best.get(2, (np.zeros(0, int),) + (np.zeros((len(next(iter(best.values()))[1]), 0)),) * 3)
    score = np.full((len(sim), len(spool.docs)), -np.inf)
    score[:, held] = sim
    return score, np.isfinite(score)


def _reranked(para: float, sent: float, deriv: float) -> Callable:
    def score(best: dict, spool: _Spool) -> tuple[np.ndarray, np.ndarray]:
        def at(level: int, which: int) -> np.ndarray:
            out = np.full((len(next(iter(best.values()))[1]), len(spool.docs)), np.nan)
            if level in best:
                out[:, best[level][0]] = best[level][which]
            return out

        own, paras, sents, bonus = at(2, 1), np.nan_to_num(at(1, 1)), np.nan_to_num(at(0, 1)), np.nan_to_num(at(0, 2))
        lone = np.isnan(own)
        if lone.any():
            n = np.maximum((~lone).sum(1), 1)
            mean = np.nansum(own, 1) / n
            bar = mean + 0.5 * np.sqrt(np.nansum((own - mean[:, None]) ** 2, 1) / n)
            bar[lone.all(1)] = np.inf
            part = np.maximum(paras, sents)
            own = np.where(lone, np.where(part > bar[:, None], part * 0.7, part * 0.4), own)
        return own + paras * para + sents * sent + bonus * deriv + spool.boost, np.ones(own.shape, bool)

    return score


def _fused(rrf_k: float) -> Callable:
    def score(best: dict, spool: _Spool) -> tuple[np.ndarray, np.ndarray]:
        total = np.zeros((len(next(iter(best.values()))[1]), len(spool.docs)))
        for held, _, _, both in best.values():
            order = np.argsort(-np.round(both, 6), axis=1, kind="stable")  # documents are by id, which tells equal ones apart
            gain = np.empty(both.shape)
            np.put_along_axis(gain, order, np.broadcast_to(1 / (rrf_k + np.arange(1, both.shape[1] + 1)), both.shape), 1)
            total[:, held] += gain
        return total + spool.boost, np.ones(total.shape, bool)

    return score


def _group_keys(spark, n: int) -> list[int]:
    """Whole numbers of which each goes to a partition of its own among n."""
    found: dict[int, int] = {}
    at = 0
    while len(found) < n:
        for r in spark.range(at, at + 16 * n + 64).select(F.col("id").cast("int").alias("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p")).toLocalIterator():
            found.setdefault(r["p"], r["id"])
        at += 16 * n + 64
    return [found[p] for p in range(n)]


def best_documents(entries: DataFrame, queries: DataFrame, ways: dict[str, Callable], derived: DataFrame | None = None, k: int = 10, boosts: DataFrame | None = None) -> DataFrame:
    """The best k documents of each query by the way of scoring that its column ``way`` names.

    Ranks and means are over all documents of a query, and documents are as many as queries may be: so no pair leaves a
    task. Each task has a share of the queries and reads all entries (shuffled once a task, of which there are as many
    as cores); it keeps the vectors in a file and scores some queries at a time, CELLS products at once.
    """
    spark, boosted = entries.sparkSession, boosts is not None
    rows = entries.where("vec is not null").select("entry_id", F.col("level").cast("int").alias("level"), F.coalesce("parent", "entry_id").alias("doc_id"), "vec")
    if derived is not None:
        rows = rows.join(derived.select("entry_id", "d1", "d2"), "entry_id", "left")
    if boosted:
        rows = rows.join(boosts.groupBy("doc_id").agg(F.max("boost").cast("double").alias("boost")), "doc_id", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))
    rows = rows.drop("entry_id")
    kinds = queries.schema["query_id"].dataType, rows.schema["doc_id"].dataType
    id_type = to_arrow_type(kinds[0])
    groups = _group_keys(spark, max(1, spark.sparkContext.defaultParallelism))
    spread = rows.withColumn("_group", F.explode(F.array(*map(F.lit, groups)))).repartition(len(groups), "_group")

    def of(block):
        def run(batches):
            first = next(iter(batches := iter(batches)), None)
            if first is None:
                return
            while not first.num_rows:
                if (first := next(batches, None)) is None:
                    return
            ids, q, more = block.value
            share = groups.index(first.column("_group")[0].as_py())
            spool = _Spool(itertools.chain([first], batches), q.shape[1], boosted)
            asked = pa.array(ids, id_type)
            mine = np.arange(share, len(q), len(groups))
            own = np.array(more["way"])[mine]
            for way, score_of in ways.items():
                which = mine[own == way]
                for at in range(0, len(which), step := max(1, CELLS // spool.n)):
                    some = which[at : at + step]
                    score, fits = score_of(spool.best(q[some]), spool)
                    score = np.round(score, 6)
                    row, column = first_of_rows(score, np.arange(len(spool.docs)), k, fits)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(some[row])), spool.docs.take(pa.array(column)), pa.array(score[row, column])], ["query_id", "doc_id", "score"])

        return run

    found = over_blocks(spread, queries, of, f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double", "way")
    return top_k(found, k)


def reranked(entries: DataFrame, queries: DataFrame, derived: DataFrame | None = None, k: int = 10, para: float = 0.3, sent: float = 0.2, deriv: float = 0.1, boosts: DataFrame | None = None) -> DataFrame:
    """Documents by their own similarity and boosts from their best paragraph, sentence and derivative.

    Documents found below level 2 only start from their best part, discounted by how it compares with the documents' mean.
    ``boosts`` is ``doc_id, boost``.
    """
    return best_documents(entries, queries.withColumn("way", F.lit("reranked")), {"reranked": _reranked(para, sent, deriv)}, derived, k, boosts)


def fused_levels(entries: DataFrame, queries: DataFrame, derived: DataFrame | None = None, k: int = 10, rrf_k: float = 60.0, boosts: DataFrame | None = None) -> DataFrame:
    """Documents by reciprocal ranks over the levels, each ranked by a document's best entry."""
    return best_documents(entries, queries.withColumn("way", F.lit("fused")), {"fused": _fused(rrf_k)}, derived, k, boosts)


def metadata_filter(docs: DataFrame, domain=None, journal=None, year_min: int | None = None, year_max: int | None = None, mesh_terms: list[str] | None = None) -> DataFrame:
    """Documents that meet every filter given; a list means any of its values. Plain predicates, so scans can use them."""
    for column, value in (("domain", domain), ("journal", journal)):
        if value is not None:
            docs = docs.where(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    if year_min is not None:
        docs = docs.where(F.col("year") >= year_min)
    if year_max is not None:
        docs = docs.where(F.col("year") <= year_max)
    if mesh_terms:
        docs = docs.where(F.arrays_overlap("mesh_terms", F.array(*map(F.lit, mesh_terms))))
    return docs


def metadata_boost(domain_target=(), domain_boost: float = 0.0, mesh_target=(), mesh_boost: float = 0.0, recency_boost: float = 0.0) -> Column:
    """Sum of a flat boost for the domain, one for each mesh term met, and one that grows from 2000 to 2026."""
    out: Column = F.lit(0.0)
    if domain_target:
        out = out + F.when(F.col("domain").isin(*domain_target), domain_boost).otherwise(0.0)
    if mesh_target:
        out = out + F.size(F.array_intersect("mesh_terms", F.array(*map(F.lit, mesh_target)))) * F.lit(mesh_boost)
    if recency_boost:
        out = out + F.coalesce(F.least(F.greatest((F.col("year") - 2000) / F.lit(26.0), F.lit(0.0)), F.lit(1.0)) * F.lit(recency_boost), F.lit(0.0))
    return out


def diversify(ranked: DataFrame, k: int = 10, weight: float = 0.4) -> DataFrame:
    """Greedy choice of k among a query's candidates (query_id, doc_id, score, domain), which prefers domains not yet chosen.

    Each step depends on the one before, so a query's candidates, a top-k already, are folded in one array.
    """
    listed = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "domain"))).alias("c"))
    score = lambda c: -c["s"]
    low, high = score(F.element_at("c", -1)), score(F.element_at("c", 1))
    listed = listed.withColumn("low", low).withColumn("spread", F.when(high > low, high - low).otherwise(1.0))

    def step(state: Column, _: Column) -> Column:
        def gain(c: Column, i: Column) -> Column:
            novel = F.when(c["domain"].isNotNull() & (c["domain"] != "") & ~F.array_contains(state["domains"], c["domain"]), 1.0).otherwise(0.0)
            return F.struct(((1 - F.lit(weight)) * (score(c) - F.col("low")) / F.col("spread") + F.lit(weight) * novel).alias("g"), (-i).alias("i"))

        best = -F.array_max(F.transform(state["rest"], gain))["i"] + 1
        one = F.element_at(state["rest"], best)
        return F.when(F.size(state["rest"]) == 0, state).otherwise(
            F.struct(
                F.concat(state["done"], F.array(one)).alias("done"),
                F.filter(state["rest"], lambda c, i: i != best - 1).alias("rest"),
                F.array_append(state["domains"], F.coalesce(one["domain"], F.lit(""))).alias("domains"),
            )
        )

    start = F.struct(F.slice("c", 1, 0).alias("done"), F.col("c").alias("rest"), F.array(F.lit("")).alias("domains"))
    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["done"])
    rows = listed.select("query_id", F.posexplode(chosen).alias("rank", "c"))
    return rows.select("query_id", F.col("c.doc_id").alias("doc_id"), (-F.col("c.s")).alias("score"), (F.col("rank") + 1).alias("rank"))


#: Share of a document's adapter that its vectors of each level take.
ADAPTED = {2: 1.0, 1: 0.8, 0: 0.6}


def adapted(entries: DataFrame, adapters: DataFrame, strength: float = 0.25) -> DataFrame:
    """Entries moved towards their document's adapter (doc_id, adapter: a unit vector) and scaled to length 1 again."""
    from ..functions.vectors import normalised

    share = F.when(F.col("level") == 2, ADAPTED[2]).when(F.col("level") == 1, ADAPTED[1]).otherwise(ADAPTED[0])
    rows = entries.withColumn("_doc", F.coalesce("parent", "entry_id")).join(adapters.select(F.col("doc_id").alias("_doc"), "adapter"), "_doc", "left").withColumn("_share", share)
    moved = F.zip_with(F.col("vec").cast("array<double>"), F.col("adapter").cast("array<double>"), lambda x, a: x + a * F.lit(strength) * F.col("_share"))
    return rows.withColumn("vec", normalised(F.coalesce(F.when(F.col("adapter").isNotNull(), moved), F.col("vec").cast("array<double>")))).drop("_doc", "_share", "adapter")


def build(docs: DataFrame, embed, adapters: DataFrame | None = None, strength: float = 0.25, most_sentences: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and derivatives of documents: cut at three scales, embedded by ``embed(rows with text) -> rows with vec``.

    Parts are embedded behind the document's title, where there is one.
    """
    from .chunking import scales

    cut = scales(docs)
    if most_sentences:
        cut = cut.where((F.col("level") > 0) | (F.col("position") < most_sentences))
    title = docs.select("doc_id", "title") if "title" in docs.columns else docs.select("doc_id", F.lit("").alias("title"))
    mark = F.element_at(F.array(F.lit("_s"), F.lit("_p")), F.col("level") + 1)
    rows = cut.join(title, "doc_id").select(
        F.when(F.col("level") == 2, F.col("doc_id").cast("string")).otherwise(F.concat(F.col("doc_id").cast("string"), F.when(F.col("level") < 2, mark), F.col("position"))).alias("entry_id"),
        "level", F.when(F.col("level") < 2, F.col("doc_id").cast("string")).alias("parent"),
        F.when((F.coalesce("title", F.lit("")) != "") & (F.col("level") < 2), F.concat("title", F.lit(": "), "text")).otherwise(F.col("text")).alias("text"),
    )
    entries = embed(rows).select("entry_id", "level", "parent", "vec")
    if adapters is not None:
        entries = adapted(entries, adapters, strength)
    return entries, derivatives(entries)


def adaptive(entries: DataFrame, queries: DataFrame, derived: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Documents by each query's kind: documents alone for specifications, fused levels for syntheses, else re-ranked."""
    way = F.when(F.col("kind") == "specification", "flat").when(F.col("kind") == "synthesis", "fused").otherwise("reranked")
    ways = {"flat": _flat, "fused": _fused(60.0), "reranked": _reranked(0.3, 0.2, 0.1)}
    return best_documents(entries, queries.where("kind is not null").withColumn("way", way), ways, derived, k)


def statistics(entries: DataFrame) -> DataFrame:
    return entries.groupBy("level").agg(F.count("*").alias("entries"), F.max(F.size("vec")).alias("dim"))
