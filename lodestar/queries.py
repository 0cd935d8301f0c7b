"""The engine's queries over the driver's tables, each with SQL of the same results where SQL can express it.

Documents are ``documents``, questions are ``benchmark``; where a query needs other shapes they are projected from the
tables: titles are a text's first 60 characters, vectors are ``embeddings``, observations are ``events``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import dense, fusion, lexical, multiscale
from .sources import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "lang", F.substring("text", 1, 60).alias("title"))


def asked(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_INDEXES: dict[tuple, lexical.Index] = {}


def indexed(spark, d, *kinds) -> lexical.Index:
    """The documents' stored index, built once in a session for the same files, with the tokenizers named."""
    docs = documents(spark, d)
    key = (spark.sparkContext.applicationId, stage.fingerprint(docs))
    return _INDEXES.setdefault(key, lexical.Index(docs)).build(*kinds)


# --- SQL that several oracles share

PLAIN = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda t: lower(t))"
COMPOUND = "list_transform(regexp_extract_all({}, '[0-9A-Za-z]+(?:[_-][0-9A-Za-z]+)*'), lambda t: lower(t))"
LONG = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: len(t) > 1)"
ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"


def bm25_sql(name: str, k: int, tok: str = COMPOUND, queries: str = ASKED, docs: str = "SELECT doc_id, text FROM documents") -> str:
    q, d = tok.format("query"), tok.format("text")
    return f"""{name}_q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest({q}) AS term FROM ({queries})) GROUP BY ALL),
{name}_d AS (SELECT doc_id, len({d}) AS dl, {d} AS t FROM ({docs})),
{name}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM {name}_d) WHERE term IN (SELECT term FROM {name}_q) GROUP BY ALL),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY term),
{name}_n AS (SELECT count(*) AS n, avg(dl) AS avg_dl FROM {name}_d),
{name}_s AS (SELECT query_id, doc_id, round(sum(qf * ln((n + 1) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM {name}_q JOIN {name}_p USING (term) JOIN {name}_f USING (term), {name}_n GROUP BY ALL),
{name} AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


def tfidf_sql(name: str, k: int) -> str:
    q, d = LONG.format("text"), LONG.format("text")
    return f"""{name}_p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM (SELECT doc_id, {d} AS t, len({d}) AS dl FROM documents)) GROUP BY ALL),
{name}_w AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 0.5)) AS idf FROM {name}_p GROUP BY term),
{name}_q AS (SELECT query_id, term, qf / sum(qf) OVER (PARTITION BY query_id) * idf AS qw FROM (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({q}) AS term FROM benchmark) GROUP BY ALL) LEFT JOIN {name}_w USING (term)),
{name}_d AS (SELECT doc_id, term, tf / dl * idf AS dw FROM {name}_p JOIN {name}_w USING (term)),
{name}_s AS (SELECT query_id, doc_id, sum(qw * dw) AS dot FROM {name}_q JOIN {name}_d USING (term) GROUP BY ALL),
{name}_r AS (SELECT query_id, doc_id, round(dot / (sqrt(qq) * sqrt(dd)), 6) AS score FROM {name}_s
  JOIN (SELECT query_id, sum(qw * qw) AS qq FROM {name}_q GROUP BY query_id) USING (query_id) JOIN (SELECT doc_id, sum(dw * dw) AS dd FROM {name}_d GROUP BY doc_id) USING (doc_id)),
{name} AS (SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {name}_r WHERE score > 0 QUALIFY rank <= {k})"""


def rrf_sql(k: int, dense_weight: str = "0.6", sparse_weight: str = "0.4") -> str:
    return f"""every AS (SELECT *, 'dense' AS source, {dense_weight} AS w FROM tf UNION ALL SELECT *, 'sparse', {sparse_weight} FROM bm),
fused AS (SELECT query_id, doc_id, round(sum(w / (60.0 + rank)), 6) AS score, map_from_entries(list({{'k': source, 'v': rank}} ORDER BY source)) AS source_ranks,
  map_from_entries(list({{'k': source, 'v': score}} ORDER BY source)) AS source_scores FROM every GROUP BY query_id, doc_id),
ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM fused QUALIFY rank <= {k})"""


EVIDENCE_SQL = f"WITH {bm25_sql('bm', 20)},\n{tfidf_sql('tf', 20)},\n{rrf_sql(10)}"


def evidence(spark, d) -> DataFrame:
    """The ten best documents of each question by fused BM25 and TF-IDF."""
    docs, qs = indexed(spark, d, T.compound_tokens, T.long_tokens), asked(spark, d)
    lists = {"dense": lexical.tfidf(docs, qs, 20), "sparse": lexical.bm25(docs, qs, 20)}
    return fusion.rrf(lists, weights={"dense": 0.6, "sparse": 0.4}, k=10)


def reranked_sql(score: str, joins: str = "", columns: str = "", before: str = EVIDENCE_SQL) -> str:
    return f"""{before},
new AS (SELECT ev.query_id, ev.doc_id, ev.rank AS prev, round({score}, 6) AS score{columns} FROM ev {joins})
SELECT * EXCLUDE (prev), CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev) - 1 AS INT) AS rank FROM new"""


def ranked(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"), *more)


# --- Retrieval


@query(f"WITH {bm25_sql('bm', 20)} SELECT * FROM bm")
def bm25_topk(spark, d):
    return ranked(lexical.bm25(indexed(spark, d), asked(spark, d), 20))


@query(f"WITH {tfidf_sql('tf', 5)} SELECT * FROM tf")
def tfidf_topk(spark, d):
    return ranked(lexical.tfidf(indexed(spark, d), asked(spark, d), 5))


RULES = [(0, "src1", "the", 1.5, "first"), (1, "src1", "of", 2.0, "second"), (2, "src3", "and", 0.5, "third")]
ALIASES = [("the", "lang:en"), ("of", "lang:fr"), ("and", "source:src2"), ("on", "lang")]
_rules = "(VALUES " + ", ".join(map(str, RULES)) + ") r(ordinal, domain, keyword, boost, reason)"
_aliases = "(VALUES " + ", ".join(map(str, ALIASES)) + ") a(term, target)"


@query(
    f"""WITH {tfidf_sql('tf', 1000000000)},
used AS (SELECT DISTINCT query_id, term, target FROM (SELECT DISTINCT query_id, term FROM tf_q) JOIN {_aliases} USING (term)),
held AS (SELECT doc_id, unnest(['lang', 'lang:' || lang, 'source', 'source:' || source]) AS target FROM documents),
met AS (SELECT query_id, doc_id, count(DISTINCT term) / any_value(total) AS score FROM used JOIN held USING (target) JOIN (SELECT query_id, count(DISTINCT term) AS total FROM used GROUP BY query_id) USING (query_id) GROUP BY query_id, doc_id),
both_ AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, dot / (sqrt(qq) * sqrt(dd)) AS score FROM tf_s
  JOIN (SELECT query_id, sum(qw * qw) AS qq FROM tf_q GROUP BY query_id) USING (query_id) JOIN (SELECT doc_id, sum(dw * dw) AS dd FROM tf_d GROUP BY doc_id) USING (doc_id) UNION ALL SELECT * FROM met) GROUP BY ALL),
rule AS (SELECT item_id AS query_id, domain, arg_min(boost, ordinal) AS boost, arg_min(reason, ordinal) AS reason FROM benchmark, {_rules} WHERE contains(lower(text), keyword) GROUP BY item_id, domain),
s AS (SELECT query_id, doc_id, round(score * coalesce(boost, 1), 6) AS score, reason FROM both_ JOIN documents USING (doc_id) LEFT JOIN rule USING (query_id) WHERE rule.domain = documents.source OR rule.domain IS NULL
  UNION ALL SELECT query_id, doc_id, round(score, 6), NULL FROM both_ b JOIN documents USING (doc_id) WHERE EXISTS (FROM rule WHERE rule.query_id = b.query_id) AND NOT EXISTS (FROM rule WHERE rule.query_id = b.query_id AND rule.domain = documents.source))
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank, reason FROM s WHERE score > 0 QUALIFY rank <= 5"""
)
def tfidf_rules(spark, d):
    docs = documents(spark, d).withColumn("domain", F.col("source")).withColumn("metadata", F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"))
    aliases = spark.createDataFrame(ALIASES, "term string, target string")
    rules = spark.createDataFrame(RULES, "ordinal int, domain string, keyword string, boost double, reason string")
    return ranked(lexical.tfidf(docs, asked(spark, d), 5, aliases, rules), "reason")


@query(
    """WITH p AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM p WHERE score > 0 QUALIFY rank <= 10"""
)
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return ranked(dense.exact_search(vectors, vectors.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id"), 10))


@query(
    """SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm,
  round(list_cosine_similarity(embedding::DOUBLE[], lead(embedding, 1, embedding) OVER (ORDER BY vec_id)::DOUBLE[]), 6) AS cosine_next,
  round(list_distance(embedding::DOUBLE[], lead(embedding, 1, embedding) OVER (ORDER BY vec_id)::DOUBLE[]), 6) AS distance_next FROM embeddings"""
)
def vector_functions(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    rows = V.with_following(rows, "vec_id", "embedding").withColumnRenamed("following", "after")
    v, w = F.col("embedding"), F.col("after")
    return rows.select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(V.cosine(v, w), 6).alias("cosine_next"), F.round(V.distance(v, w), 6).alias("distance_next"))


@query()
def hash_embeddings(spark, d):
    return dense.hash_embeddings(documents(spark, d), 64)


@query()
def gaussian_embeddings(spark, d):
    return multiscale.gaussian_embeddings(documents(spark, d).select("doc_id", "text")).select("doc_id", "vec")


# --- Fusion and re-ranking


@query(f"{EVIDENCE_SQL} SELECT query_id, doc_id, score, rank, CAST(coalesce(map_extract(source_ranks, 'dense')[1], 0) AS INT) AS dense_rank, CAST(coalesce(map_extract(source_ranks, 'sparse')[1], 0) AS INT) AS sparse_rank, CAST(coalesce(map_extract(source_scores, 'sparse')[1], 0) AS DOUBLE) AS sparse_score FROM ev")
def rrf_fuse(spark, d):
    of = lambda m, k, none: F.coalesce(F.col(m)[k], F.lit(none))
    rows = evidence(spark, d).withColumn("dense_rank", of("source_ranks", "dense", 0)).withColumn("sparse_rank", of("source_ranks", "sparse", 0))
    return ranked(rows.withColumn("sparse_score", of("source_scores", "sparse", 0.0)), "dense_rank", "sparse_rank", "sparse_score")


IDF_SQL = f"""WITH qt AS (SELECT item_id AS query_id, unnest({COMPOUND.format('text')}) AS term FROM benchmark),
f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({COMPOUND.format('text')}) AS term FROM documents) GROUP BY term),
m AS (SELECT query_id, avg(ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1))) AS m FROM qt LEFT JOIN f USING (term) GROUP BY query_id),
s AS (SELECT item_id AS query_id, coalesce(0.4 + 0.3 * (1 / (1 + exp(-1.5 * (m - 3.0))) - 0.5), 0.4) AS s0 FROM benchmark LEFT JOIN m ON item_id = query_id),
c AS (SELECT query_id, least(greatest(s0, 0.1), 0.9) AS s, least(greatest(1 - s0, 0.1), 0.9) AS d FROM s)
SELECT query_id, round(d / (d + s), 6) AS dense_weight, round(s / (d + s), 6) AS sparse_weight FROM c"""


@query(IDF_SQL)
def idf_fusion_weights(spark, d):
    return fusion.idf_weights(indexed(spark, d), asked(spark, d))


@query(reranked_sql(f"ev.score * (1 + 0.5 * len(list_intersect({PLAIN.format('b.text')}, {PLAIN.format('substr(o.text, 1, 60)')})) / len(list_distinct({PLAIN.format('b.text')})))", "JOIN benchmark b ON b.item_id = ev.query_id JOIN documents o USING (doc_id)"))
def title_boost(spark, d):
    return ranked(fusion.title_boost(evidence(spark, d), asked(spark, d), documents(spark, d)))


@query(reranked_sql("ev.score * CASE WHEN len(map_keys(source_ranks)) = 2 THEN 1.2 ELSE 1 END"))
def intersection_boost(spark, d):
    return ranked(fusion.intersection_boost(evidence(spark, d)))


@query(
    f"""{EVIDENCE_SQL}, x AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS low, max(score) OVER w AS high FROM ev WINDOW w AS (PARTITION BY query_id)),
new AS (SELECT query_id, doc_id, rank AS prev, round(CASE WHEN n < 2 THEN score WHEN high <= low THEN 1 - rank / n ELSE (score - low) / (high - low) + 0.001 * (n - rank) / n END, 6) AS score FROM x)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev) - 1 AS INT) AS rank FROM new"""
)
def score_normalize(spark, d):
    return ranked(fusion.score_normalize(evidence(spark, d)))


@query(
    f"""{EVIDENCE_SQL}, v AS (SELECT vec_id AS doc_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings),
e AS (SELECT query_id, doc_id, u FROM ev JOIN v USING (doc_id)),
m AS (SELECT a.query_id, a.doc_id, greatest(avg(list_inner_product(a.u, b.u)), 0) AS c, count(*) AS others FROM e a JOIN e b ON a.query_id = b.query_id AND a.doc_id <> b.doc_id GROUP BY ALL),
new AS (SELECT ev.query_id, ev.doc_id, rank AS prev, round(score * (1 + 0.2 * coalesce(CASE WHEN others >= 2 THEN c END, 0)), 6) AS score FROM ev LEFT JOIN m ON ev.query_id = m.query_id AND ev.doc_id = m.doc_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev) - 1 AS INT) AS rank FROM new"""
)
def coherence_boost(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    return ranked(fusion.coherence_boost(evidence(spark, d), vectors))


@query(
    f"""WITH {bm25_sql('bm', 20)}, qt AS (SELECT DISTINCT item_id AS query_id, unnest({PLAIN.format('text')}) AS term FROM benchmark),
p AS (SELECT DISTINCT doc_id, unnest({PLAIN.format('text')}) AS term FROM documents),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT query_id, term, coalesce(df, 0) > 0.1 * (SELECT count(*) FROM documents) AS common FROM qt LEFT JOIN f USING (term)),
m AS (SELECT query_id FROM c GROUP BY query_id HAVING bool_or(common) AND NOT bool_and(common)),
flood AS (SELECT bm.query_id, bm.doc_id FROM bm JOIN c USING (query_id) JOIN p ON p.doc_id = bm.doc_id AND p.term = c.term WHERE bm.query_id IN (FROM m) GROUP BY ALL HAVING bool_and(common))
SELECT bm.* FROM bm ANTI JOIN flood USING (query_id, doc_id)"""
)
def antiflood(spark, d):
    docs, qs = indexed(spark, d, T.compound_tokens, T.plain_tokens), asked(spark, d)
    return ranked(lexical.antiflood(docs, qs, lexical.bm25(docs, qs, 20)))


EXPANSION_SQL = f"""{EVIDENCE_SQL}, t AS (SELECT query_id, rank, unnest({COMPOUND.format('text')}) AS term, generate_subscripts({COMPOUND.format('text')}, 1) AS pos FROM ev JOIN documents USING (doc_id) WHERE rank <= 3),
n AS (SELECT query_id, term, count(*) AS n, min(rank * 10000000 + pos) AS first FROM t WHERE len(term) >= 3 AND regexp_matches(term, '[A-Za-z]') AND term NOT IN ({", ".join(repr(w) for w in lexical.EXPANSION_STOPWORDS)}) GROUP BY ALL),
k AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, term) AS nth FROM n ANTI JOIN bm_q USING (query_id, term) QUALIFY nth <= 8)
SELECT query_id, string_agg(term, ' ' ORDER BY nth) AS terms FROM k GROUP BY query_id"""


@query(EXPANSION_SQL)
def expansion_terms(spark, d):
    found = lexical.expansion_terms(indexed(spark, d), asked(spark, d), evidence(spark, d))
    return found.select("query_id", F.array_join("terms", " ").alias("terms"))


@query(f"{EVIDENCE_SQL} SELECT query_id, doc_id, array_to_string(list_sort(list_intersect({PLAIN.format('b.text')}, {PLAIN.format('o.text')})), ' ') AS matched FROM ev JOIN documents o USING (doc_id) JOIN benchmark b ON item_id = query_id")
def matched_terms(spark, d):
    found = lexical.matched_terms(documents(spark, d), asked(spark, d), evidence(spark, d))
    return found.select("query_id", "doc_id", F.array_join("matched_terms", " ").alias("matched"))


PARTS_SQL = r"""SELECT query_id, nth - 1 AS part, query FROM (SELECT query_id, unnest(p) AS query, generate_subscripts(p, 1) AS nth FROM (SELECT item_id AS query_id,
  list_filter(list_transform(string_split_regex(text, '(?i)\b(?:along with|in addition to|as well as|and|or)\b|[,;]'), lambda p: trim(p)), lambda p: p <> '') AS p FROM benchmark) WHERE len(p) > 1) WHERE len(query) >= 5"""


@query(
    f"""{EVIDENCE_SQL}, parts AS ({PARTS_SQL}), {bm25_sql('sub', 20, queries="SELECT {'q': query_id, 'p': part} AS query_id, query FROM parts")},
new AS (SELECT query_id.q AS query_id, doc_id, arg_min(score * 0.8, query_id.p) AS score, min(query_id.p) AS part FROM sub WHERE NOT EXISTS (FROM ev WHERE ev.query_id = sub.query_id.q AND ev.doc_id = sub.doc_id) GROUP BY ALL),
x AS (SELECT query_id, doc_id, score, -1 AS part FROM ev UNION ALL SELECT * FROM new)
SELECT query_id, doc_id, round(score, 6) AS score, CAST(part AS INT) AS part, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, part, doc_id) - 1 AS INT) AS rank FROM x"""
)
def decompose_merge(spark, d):
    found = lexical.decompose_merge(indexed(spark, d), asked(spark, d), evidence(spark, d))
    return found.select("query_id", "doc_id", "score", F.col("part").cast("int").alias("part"), F.col("rank").cast("int").alias("rank"))


@query(
    f"""{EVIDENCE_SQL}, t AS (SELECT query_id, rank, unnest({PLAIN.format('text')}) AS term, generate_subscripts({PLAIN.format('text')}, 1) AS pos FROM ev JOIN documents USING (doc_id) WHERE rank <= 5),
own AS (SELECT DISTINCT item_id AS query_id, unnest({PLAIN.format('text')}) AS term FROM benchmark),
n AS (SELECT query_id, term, count(*) AS n, min(rank * 10000000 + pos) AS first FROM t WHERE len(term) >= 3 AND regexp_matches(term, '[A-Za-z]') AND term NOT IN ({", ".join(repr(w) for w in lexical.EXPANSION_STOPWORDS)}) GROUP BY ALL),
k AS (SELECT n.*, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, term) AS nth FROM n ANTI JOIN own USING (query_id, term) QUALIFY nth <= 8),
again AS (SELECT query_id, trim(text) || ' ' || string_agg(term, ' ' ORDER BY nth) AS query FROM k JOIN benchmark ON item_id = query_id GROUP BY query_id, text), {bm25_sql('hop', 20, PLAIN, 'FROM again')},
x AS (SELECT query_id, doc_id, score, 1 AS hop, rank AS prev FROM ev UNION ALL SELECT query_id, doc_id, score, 2, 1000000 FROM hop ANTI JOIN ev USING (query_id, doc_id))
SELECT query_id, doc_id, score, CAST(hop AS INT) AS hop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev, doc_id) - 1 AS INT) AS rank FROM x QUALIFY rank < 10"""
)
def multi_hop(spark, d):
    found = lexical.multi_hop(indexed(spark, d), asked(spark, d), evidence(spark, d))
    return ranked(found, "hop")
