"""Exhaustive vector search by blocks of a stated query set, and hash embeddings."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as T
from ..functions.vectors import cosine
from ..sources import store
from ..sources.stage import staged
from .forward import CELLS, first_of_rows
from .lexical import Tokens, top_k

#: Bytes of the queries that go out together.
BLOCK_BYTES = 64 << 20


def blocks(queries: DataFrame, *more: str) -> Iterator[Broadcast]:
    """The queries ``query_id, vec`` and further columns in broadcasts of BLOCK_BYTES: (ids, matrix, {name: values}).

    The driver reads one block at a time; null vectors are left out. ValueError for vectors of different lengths.
    """
    context = queries.sparkSession.sparkContext
    now: list = []

    def send() -> Broadcast:
        if len({len(r["vec"]) for r in now}) > 1:
            raise ValueError("vectors differ in length")
        return context.broadcast(([r["query_id"] for r in now], np.array([r["vec"] for r in now], float), {c: [r[c] for r in now] for c in more}))

    for r in queries.select("query_id", F.col("vec").cast("array<double>").alias("vec"), *more).where("vec is not null").toLocalIterator():
        now.append(r)
        if len(now) * 8 * max(1, len(r["vec"])) >= BLOCK_BYTES:
            yield send()
            now = []
    if now:
        yield send()


def matrix(column, dim: int) -> np.ndarray:
    """An Arrow column of lists without nulls as rows of a matrix."""
    x = np.array(column.flatten().to_numpy(zero_copy_only=False), float)
    if len(x) != len(column) * dim:
        raise ValueError("vectors differ in length")
    return x.reshape(len(column), dim)


def over_blocks(rows: DataFrame, queries: DataFrame, run: Callable[[Broadcast], Callable], schema: str, *more: str) -> DataFrame:
    """What ``run(block)`` makes of the rows' Arrow batches, for all blocks of the queries: one pass over the rows a block."""
    out = rows.sparkSession.createDataFrame([], schema)
    for block in blocks(queries, *more):
        out = out.unionByName(rows.mapInArrow(run(block), schema))
    return out


def exact_search(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``query_id, doc_id, score, rank``: the k largest positive cosines of each query, over all vectors.

    Tables are ``doc_id, vec`` and ``query_id, vec``. Queries go out in blocks; for each, one pass over the vectors
    multiplies matrices and keeps k hits a query and Arrow batch, so what is shuffled grows with batches and queries, not
    with pairs. Zero and null vectors find nothing and are not found.
    """
    rows = vectors.where("vec is not null").select("doc_id", F.col("vec").cast("array<double>").alias("vec"))
    kinds = queries.schema["query_id"].dataType, vectors.schema["doc_id"].dataType
    schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"
    return top_k(over_blocks(rows, queries, _search(k, to_arrow_type(kinds[0])), schema), k)


def _search(k: int, id_type: pa.DataType):
    def of(block: Broadcast):
        def run(batches):
            ids, queries, _ = block.value
            asked = pa.array(ids, id_type)
            q_norm = np.sqrt((queries * queries).sum(1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, docs = matrix(batch.column("vec"), queries.shape[1]), batch.column("doc_id")
                x_norm = np.sqrt((x * x).sum(1))
                place = np.argsort(np.array(docs.to_pylist(), dtype=object), kind="stable").argsort()
                step = max(1, CELLS // len(x))
                for at in range(0, len(queries), step):
                    scale = q_norm[at : at + step, None] * x_norm[None, :]
                    score = np.round(np.divide(queries[at : at + step] @ x.T, scale, out=np.zeros_like(scale), where=scale > 0), 6)
                    row, best = first_of_rows(score, place, k, score > 0)
                    yield pa.RecordBatch.from_arrays([asked.take(pa.array(row + at)), docs.take(pa.array(best)), pa.array(score[row, best])], ["query_id", "doc_id", "score"])

        return run

    return of


def hash_embeddings(docs: DataFrame, dim: int = 256, tokens: Tokens = T.compound_tokens) -> DataFrame:
    """``doc_id, vec``: feature-hashed texts of length 1. Only the distinct terms cross to Python for their BLAKE2b places."""
    rows = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))

    @F.pandas_udf("struct<i:int,sign:int>")
    def place(terms: pd.Series) -> pd.DataFrame:
        h = lambda s: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big")
        return pd.DataFrame({"i": [h(t) % dim for t in terms], "sign": [1 if h(t + ":sign") % 2 == 0 else -1 for t in terms]})

    places = rows.select("term").distinct().withColumn("at", place("term"))
    cells = rows.join(places, "term").groupBy("doc_id", F.col("at.i").alias("i")).agg(F.sum(F.col("tf") * F.col("at.sign")).cast("double").alias("x"))
    cells = cells.where("x <> 0").groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    full = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i) / F.col("size"), F.lit(0.0)))
    return docs.select("doc_id").join(cells, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("m").isNotNull(), full), F.array_repeat(F.lit(0.0), dim)).alias("vec"))


def learned_sparse(rows: DataFrame, encode) -> DataFrame:
    """``id, token, weight`` from ``id, text`` by a plug-in ``encode(list of texts) -> list of {token: weight}``, batch by batch."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            flat = [(i, int(t), float(w)) for i, weights in zip(pdf["id"], encode(pdf["text"].tolist())) for t, w in weights.items()]
            yield pd.DataFrame(flat, columns=["id", "token", "weight"])

    return rows.select("id", "text").mapInPandas(run, f"id {kind}, token int, weight double")


def sparse_dot(docs: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """Top k by the dot product of two tables from ``learned_sparse``; zero and negative products of met tokens count too."""
    met = docs.select(F.col("id").alias("doc_id"), "token", F.col("weight").alias("dw")).join(queries.select(F.col("id").alias("query_id"), "token", F.col("weight").alias("qw")), "token")
    return top_k(met.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("dw") * F.col("qw")), 6).alias("score")), k)


def embedded(rows: DataFrame, load: Callable[[], Callable[[list[str]], list]], dim: int, prefix: str = "") -> DataFrame:
    """``rows`` (with ``text``) and ``vec`` from a plug-in model, which each worker loads once.

    Each distinct text is embedded once, behind ``prefix`` (an instruction for questions, nothing for documents). Where
    a batch fails, its texts are tried one by one, and those that fail get a zero vector; so do null texts.
    """

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            said = [prefix + (t or "") for t in texts]
            try:
                out = [list(map(float, v)) for v in model(said)]
            except Exception:
                out = [_one(model, t, dim) for t in said]
            yield pd.Series([v if t is not None else [0.0] * dim for v, t in zip(out, texts)])

    distinct = rows.select(F.col("text").alias("_text")).distinct().withColumn("vec", embed("_text"))
    return rows.join(distinct, F.col("text").eqNullSafe(F.col("_text")), "left").drop("_text")


def embedded_once(rows: DataFrame, load: Callable[[], Callable[[list[str]], list]], dim: int, path: str, name: str, prefix: str = "") -> DataFrame:
    """As `embedded`, with vectors kept in a table at ``path`` by the model's ``name``, prefix and text: only new texts are embedded."""
    spark = rows.sparkSession
    key = F.sha2(F.encode(F.concat_ws("\0", F.lit(name), F.lit(prefix), F.coalesce("text", F.lit(""))), "UTF-8"), 256)
    schema = "key string, vec array<float>"
    known = spark.read.schema(schema).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], schema)
    wanted = rows.where("text is not null").select(key.alias("key"), "text").dropDuplicates(["key"])
    new = staged(embedded(wanted.join(known, "key", "left_anti"), load, dim, prefix).select("key", "vec"))
    new.write.mode("append").parquet(path)
    kept = spark.read.schema(schema).parquet(path).dropDuplicates(["key"])
    none = F.array_repeat(F.lit(0.0).cast("float"), dim)
    boxed = rows.select(F.struct("*").alias("row"), F.when(F.col("text").isNotNull(), key).alias("key"))
    return boxed.join(kept, "key", "left").select("row.*", F.coalesce("vec", none).alias("vec"))


def _one(model, text: str, dim: int) -> list[float]:
    try:
        return list(map(float, model([text])[0]))
    except Exception:
        return [0.0] * dim


def instructed(task: str) -> str:
    """The prefix that tells a model what a question is asked for."""
    return f"Instruct: {task}\nQuery: "


def pairwise(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b: vectors) and their ``cosine``."""
    return pairs.withColumn("cosine", cosine(F.col("a"), F.col("b")))
