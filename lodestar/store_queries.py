"""Queries of what reads, writes and plugs in: folders, stores, plug-in models, plans, streams, each with SQL of the same results."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from .functions import questions as Q
from .functions import sensitive as S
from .functions import text as T
from .operators import answers, dense, fusion, graph, lexical, multiscale, training, tuning, verify
from .plans import planner
from .queries import ALIASES, EVIDENCE_SQL, PLAIN, RULES, asked, bm25_sql, documents, evidence, indexed, query, ranked, reranked_sql, table
from .score_queries import GOLDEN_SQL, LEVELS_SQL, STATS_SQL, _base, _lv, _methods, entries, golden, graph_tables, level_queries, measured, observations, rewards
from .sources import files, stage, store, tables
from .streaming import state


def _folder(spark) -> str:
    path = f"{stage.folder(spark)}/lodestar-folder-{uuid.uuid4().hex}"
    stage.remove_at_exit(spark, path)
    return path


# --- Folders: each question of benchmark is a file, or a line of one


def _written(spark, d, make) -> str:
    """A folder with the files ``make(item_id, text) -> {path: text or bytes}`` of all questions."""
    root = _folder(spark)
    for r in asked(spark, d).toLocalIterator():
        for name, body in make(r["query_id"], r["query"]).items():
            store.write_text(spark, f"{root}/{name}", body) if isinstance(body, str) else store.write_bytes(spark, f"{root}/{name}", body)
    return root


@query(
    """SELECT 'part' || item_id % 3 || '/q' || item_id || '.md' AS source, CASE WHEN item_id % 2 = 0 THEN 'Item ' || item_id ELSE 'q' || item_id END AS title, 'md' AS format,
CASE WHEN item_id % 2 = 0 THEN '# Item ' || item_id || chr(10) || chr(10) ELSE '' END || text AS text FROM benchmark"""
)
def folder_markdown(spark, d):
    root = _written(spark, d, lambda i, t: {f"part{i % 3}/q{i}.md": f"# Item {i}\n\n{t}" if i % 2 == 0 else t, f"blank{i}.txt": "  ", f"other{i}.csv": "x"})
    return files.read_folder(spark, root).select("source", "title", "format", "text")


@query(
    """SELECT 'q' || item_id || '.jsonl#' || k AS source, CASE WHEN k = 0 THEN 'T' || item_id ELSE 'q' || item_id END AS title, CASE WHEN k = 0 THEN text ELSE 'second ' || text END AS text FROM benchmark, (VALUES (0), (2)) v(k)
UNION ALL SELECT 'q' || item_id || '.json#0', 'M' || item_id, 'in array ' || text FROM benchmark"""
)
def folder_json(spark, d):
    def make(i, t):
        lines = [json.dumps({"title": f"T{i}", "content": t}), "not json", json.dumps({"no": "text"}), json.dumps({"body": f"second {t}"})]
        return {f"q{i}.jsonl": "\n".join(lines), f"q{i}.json": json.dumps([{"text": f"in array {t}", "metadata": {"title": f"M{i}"}}])}

    return files.read_folder(spark, _written(spark, d, make)).select("source", "title", "text")


def _docx(text: str, row: str) -> bytes:
    p = lambda t: f"<w:p><w:r><w:t>{escape(t)}</w:t></w:r></w:p>"
    body = p(text) + f"<w:tbl><w:tr><w:tc>{p(row)}</w:tc><w:tc>{p('cell')}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query("SELECT 'q' || item_id || '.docx' AS source, 'docx' AS format, substr(list_filter(list_transform(list_slice(string_split(trim(text), chr(10)), 1, 10), lambda x: trim(x)), lambda x: len(x) > 3)[1], 1, 120) AS title, text || chr(10) || chr(10) || 'row ' || item_id || ' | cell' AS text, 'docx_text' AS parser FROM benchmark")
def folder_docx(spark, d):
    root = _written(spark, d, lambda i, t: {f"q{i}.docx": _docx(t, f"row {i}"), f"broken{i}.docx": b"not a zip"})
    return files.read_folder(spark, root, ("docx",)).select("source", "format", "title", "text", F.col("metadata")["parser"].alias("parser"))


@query("SELECT 'q' || item_id || '.pdf' AS source, substr(list_filter(list_transform(list_slice(string_split(trim(text), chr(10)), 1, 10), lambda x: trim(x)), lambda x: len(x) > 3)[1], 1, 120) AS title, text, CAST(item_id % 5 AS VARCHAR) AS page_count FROM benchmark")
def folder_parsed(spark, d):
    """Files of a format with a parser of one's own, which tells text and pages."""
    root = _written(spark, d, lambda i, t: {f"q{i}.pdf": f"{i % 5}|{t}"})

    def parser(content: bytes):
        pages, _, text = content.decode().partition("|")
        return text, int(pages)

    return files.read_folder(spark, root, ("pdf",), {"pdf": parser}).select("source", "title", "text", F.col("metadata")["page_count"].alias("page_count"))


@query(
    """SELECT 'src/q' || item_id || '.py' AS path, 'py' AS language, 'implementation' AS category, 'q' || item_id AS slug, substr('a = ' || item_id || chr(10) || text, 1, 1400) AS snippet
FROM (SELECT * FROM benchmark ORDER BY 'src/q' || item_id || '.py' LIMIT 80)"""
)
def code_files(spark, d):
    return files.read_code(spark, _written(spark, d, lambda i, t: {f"src/q{i}.py": f"a = {i}\n\n   {t}", f"src/node_modules/q{i}.js": "x", f"notes{i}.md": "y"}))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE substr(text, 1, 60) || chr(10) || text END AS text FROM documents")
def benchmark_corpus(spark, d):
    title = F.when(F.col("doc_id") % 3 != 0, F.col("title")).otherwise(F.when(F.col("text") != "", ""))
    return files.read_corpus(documents(spark, d).select(F.col("doc_id").alias("_id"), title.alias("title"), "text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Doc ' || doc_id ELSE 'stem' || doc_id END AS title FROM documents")
def markdown_titles(spark, d):
    text = F.concat(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\n# Doc "), "doc_id", F.lit(" \n"))).otherwise(F.lit("")), F.replace("text", F.lit("#"), F.lit("")))
    return documents(spark, d).select("doc_id", T.markdown_title(text, F.concat(F.lit("stem"), "doc_id")).alias("title"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Mark ' || page_id ELSE substr(list_filter(list_transform(list_slice(string_split(trim(replace(html, '#', '-')), chr(10)), 1, 10), lambda x: trim(x)), lambda x: len(x) > 3)[1], 1, 120) END AS title FROM pages")
def parsed_titles(spark, d):
    text = F.concat(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("one\n## Mark "), "page_id", F.lit("\n"))).otherwise(F.lit("")), F.replace("html", F.lit("#"), F.lit("-")))
    return table(spark, d, "pages").select("page_id", T.parsed_title(text, F.lit("none")).alias("title"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN source WHEN 1 THEN 'c' || lang WHEN 2 THEN 'm' || doc_id WHEN 3 THEN 'd' || doc_id WHEN 4 THEN CAST(doc_id AS VARCHAR) ELSE '' END AS item_source,
CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, 60) ELSE '' END AS item_text FROM documents"""
)
def item_fields(spark, d):
    at = lambda n, c: F.when(F.col("doc_id") % 6 == n, c)
    none = F.lit(None).cast("string")
    ident = F.col("doc_id").cast("string")
    kept = F.when(F.col("doc_id") % 6 == 2, F.create_map(F.lit("document_id"), F.concat(F.lit("m"), ident))).when(F.col("doc_id") % 6 == 3, F.create_map(F.lit("doc_id"), F.concat(F.lit("d"), ident)))
    source = T.item_source(F.coalesce(at(0, F.col("source")), F.lit("")), at(1, F.concat(F.lit("c"), "lang")), kept, none, at(4, F.col("doc_id")), none)
    third = F.col("doc_id") % 3
    return documents(spark, d).select("doc_id", source.alias("item_source"), T.item_text(F.when(third == 0, F.col("text")), F.when(third == 1, F.col("title"))).alias("item_text"))


# --- Stores


@query(f"SELECT method_id, problem, solution, source, '1' AS part FROM ({_methods}) UNION ALL SELECT p_brand, CAST(count(*) AS VARCHAR), max(p_type), 'family', '2' FROM part GROUP BY p_brand")
def graph_store(spark, d):
    methods, families, links, _ = graph_tables(spark, d)
    path = _folder(spark)
    tables.write_graph_store({"methods": methods.select("method_id", "problem", "solution", "notes", "language", "tags", "source"), "families": families, "memberships": links}, path)
    held = tables.read_graph_store(spark, path)
    sizes = held["memberships"].groupBy("family_id").agg(F.count("*").cast("string").alias("n"))
    rows = held["families"].join(sizes, "family_id").select(F.col("family_id").alias("method_id"), F.col("n").alias("problem"), F.col("category").alias("solution"), F.lit("family").alias("source"), F.lit("2").alias("part"))
    return held["methods"].select("method_id", "problem", "solution", "source", F.lit("1").alias("part")).unionByName(rows)


@query(f"SELECT CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE problem END AS problem, method_id FROM ({_methods}) JOIN part ON CAST(p_partkey AS VARCHAR) = method_id")
def graph_upsert(spark, d):
    methods = graph_tables(spark, d)[0].select("method_id", "problem")
    return tables.upsert(methods, methods.where("cast(method_id as long) % 10 = 0").withColumn("problem", F.lit("changed")), "method_id")


@query("SELECT CAST(level AS INT) AS level, count(*) AS entries, 64 AS dim FROM (SELECT CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level FROM embeddings) GROUP BY level")
def index_statistics(spark, d):
    path = _folder(spark)
    rows = entries(spark, d)
    titles = rows.where("level = 2").select(F.col("entry_id").alias("doc_id"), F.lit("t").alias("title"))
    tables.write_index(rows, multiscale.derivatives(rows), path, 64, doc_titles=titles)
    held = tables.read_index_tables(spark, path, 64)
    return multiscale.statistics(held["entries"].join(held["doc_titles"].withColumnRenamed("doc_id", "entry_id"), "entry_id", "left"))


@query(f"SELECT id, CASE WHEN id % 9 = 0 THEN 'q' || id ELSE CAST(id AS VARCHAR) END AS golden_id, answer AS question, len(wn) AS n_sources, len(terms) AS n_terms, id % 10 = 0 AS no_evidence FROM (SELECT *, row_number() OVER (ORDER BY id) AS line FROM ({GOLDEN_SQL} SELECT * FROM w))")
def golden_round_trip(spark, d):
    rows = golden(spark, d).select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("q"), "id")).otherwise(F.col("id").cast("string")).alias("golden_id"), F.col("answer").alias("question"), "expected_sources", "expected_terms", (F.col("id") % 10 == 0).alias("no_evidence"))
    path = _folder(spark)
    tables.write_golden(rows.drop("id").withColumnRenamed("golden_id", "id"), path)
    held = tables.read_golden(spark, path)
    n = F.size(F.array_distinct(F.transform("expected_sources", F.lower))).cast("long")
    return held.select(F.regexp_replace("id", "q", "").cast("long").alias("id"), F.col("id").alias("golden_id"), "question", n.alias("n_sources"), F.size("expected_terms").cast("long").alias("n_terms"), "no_evidence")


@query(_base.format(0))
def baselines_round_trip(spark, d):
    path = f"{_folder(spark)}/baselines.json"
    tables.write_baselines(measured(spark, d, 0).withColumn("timestamp", F.lit("")), path)
    return tables.read_baselines(spark, path).select("task", "config", "metric", "value")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', CAST(NULL AS DOUBLE))" for a, b in ALIASES) + ", " + ", ".join(f"('{k}', '{dom}', {boost})" for _, dom, k, boost, _ in RULES) + ") v(term, target, boost)")
def rules_round_trip(spark, d):
    path = f"{_folder(spark)}/rules.json"
    named: dict[str, list] = {}
    for term, target in ALIASES:
        named.setdefault(term, []).append(target)
    store.write_json(spark, path, {"aliases": named, "routing": [{"domain": dom, "keywords": [k], "boost": boost, "reason": why} for _, dom, k, boost, why in RULES]})
    aliases, rules = tables.read_rules(spark, path)
    return aliases.select("term", "target", F.lit(None).cast("double").alias("boost")).unionByName(rules.select(F.col("keyword").alias("term"), F.col("domain").alias("target"), "boost"))


@query(f"SELECT arm, pulls, round(total, 6) AS total, pulls > 0 AS used FROM ({STATS_SQL}) UNION ALL SELECT * FROM (VALUES {', '.join(f'({a!r}, 0, 0.0, false)' for a in tables.FIRST_ARMS)}) v")
def arms_round_trip(spark, d):
    given = rewards(spark, d)
    arms = tables.read_arms(spark, f"{_folder(spark)}/none.json")
    names = [r["arm"] for r in given.select("arm").distinct().collect()]  # one row a kind of event
    for name in names:
        arms = tables.with_arm(arms, name, ["sparse_bm25"])
    path = f"{_folder(spark)}/arms.json"
    tables.write_arms(tables.rewarded(arms, given), path)
    return tables.read_arms(spark, path).select("arm", "pulls", F.round("total", 6).alias("total"), (F.col("pulls") > 0).alias("used"))


# --- Plug-in models


def _lengths():
    return lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts]


@query("SELECT doc_id, CAST(len(text) AS DOUBLE) + 2 AS size, CAST(len(text) - len(replace(text, 'e', '')) AS DOUBLE) AS letters FROM documents")
def plugin_embeddings(spark, d):
    """Vectors of a plug-in model, kept in a table from which a second run takes them all."""
    path, rows = f"{_folder(spark)}/vectors", documents(spark, d).select("doc_id", "text")

    def broken():
        raise RuntimeError("every vector is stored")

    dense.embedded_once(rows, _lengths, 2, path, "lengths", "q:").write.format("noop").mode("overwrite").save()
    held = dense.embedded_once(rows, lambda: broken, 2, path, "lengths", "q:")
    return held.select("doc_id", F.col("vec")[0].cast("double").alias("size"), F.col("vec")[1].cast("double").alias("letters"))


@query(
    """WITH t AS (SELECT doc_id, unnest(list_distinct(w)) AS token, w FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '[^\\s]+'), lambda x: len(x)) AS w FROM documents)),
dd AS (SELECT doc_id, token, count(*) AS n, len(list_filter(any_value(w), lambda x: x = token)) AS c FROM t GROUP BY doc_id, token),
q AS (SELECT item_id AS query_id, token, CASE WHEN token > 5 THEN 1.0 ELSE 0.0 END AS qw FROM (SELECT item_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '[^\\s]+'), lambda x: len(x)))) AS token FROM benchmark)),
s AS (SELECT query_id, doc_id, round(sum(qw * c / 4.0), 6) AS score FROM q JOIN dd USING (token) GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s QUALIFY rank <= 10"""
)
def learned_sparse(spark, d):
    """Word lengths as tokens: documents weigh how many words have the length, questions weigh short ones 0, which counts as met."""
    from collections import Counter

    of_docs = lambda texts: [{n: c / 4.0 for n, c in Counter(len(w) for w in t.split()).items()} for t in texts]
    of_asked = lambda texts: [{len(w): 1.0 if len(w) > 5 else 0.0 for w in t.split()} for t in texts]
    docs = dense.learned_sparse(documents(spark, d).select(F.col("doc_id").alias("id"), "text"), of_docs)
    return ranked(dense.sparse_dot(docs, dense.learned_sparse(asked(spark, d).select(F.col("query_id").alias("id"), F.col("query").alias("text")), of_asked), 10))


@query(
    """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1"""
)
def pairwise_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    pairs = rows.select("vec_id", F.col("embedding").alias("a")).join(rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return dense.pairwise(pairs).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"{EVIDENCE_SQL}, p AS (SELECT query_id, string_agg('[' || nth || '] ' || substr(text, 1, 1000), chr(10) || chr(10) ORDER BY nth) AS block FROM (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS nth FROM ev JOIN documents USING (doc_id)) GROUP BY query_id) SELECT query_id, 'Question: ' || text || chr(10) || chr(10) || block || chr(10) || chr(10) || 'Mark each passage from 0 to 10, as JSON.' AS prompt FROM p JOIN benchmark ON item_id = query_id")
def judge_prompts(spark, d):
    return answers.judge_prompts(_pairs(spark, d)).select("query_id", "prompt")


def _pairs(spark, d):
    return lexical.of_documents(evidence(spark, d).select("query_id", "doc_id").join(asked(spark, d), "query_id"), documents(spark, d), "text")


@query(
    f"""{EVIDENCE_SQL}, n AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS nth FROM ev)
SELECT query_id, doc_id, CAST(CASE WHEN query_id % 4 = 0 THEN 0.5 WHEN nth = 1 THEN 1 WHEN nth = 2 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS reranked FROM n"""
)
def judge_reranker(spark, d):
    """A model that marks two passages in a fenced reply, and whose reply can't be read for every fourth question."""
    ids = {r["query"]: r["query_id"] for r in asked(spark, d).toLocalIterator()}  # stated questions
    reply = lambda prompt: "no marks" if ids[prompt.removeprefix("Question: ").partition("\n\n[1] ")[0]] % 4 == 0 else 'Here:\n```json\n{"1": 15, "2": 3}\n```'
    return answers.judge_reranker(lambda: lambda system, prompt: reply(prompt))(_pairs(spark, d)).select("query_id", "doc_id", "reranked")


@query(reranked_sql("0.8 * ev.score + 0.2 * (len(o.text) % 100) / 100.0", "JOIN documents o USING (doc_id)"))
def blended_rerank(spark, d):
    """The reranking step with a pair model and a blend of 0.2."""
    rerank = answers.pair_reranker(lambda: lambda pairs: [len(p) % 100 / 100.0 for _, p in pairs])
    c = planner.Context(documents(spark, d), asked(spark, d), strategy=planner.STRATEGIES["blended_rerank"], reranker=rerank, evidence=evidence(spark, d))
    return ranked(planner.run(c, ["cross_encoder_rerank"]).evidence)


@query(
    f"""WITH {bm25_sql('bm', 100, PLAIN, "SELECT item_id AS query_id, text || ' the' AS query FROM benchmark")}, e AS (SELECT query_id, doc_id, score, rank FROM bm WHERE rank <= 10),
x AS (SELECT *, count(*) OVER w AS n, min(score) OVER w AS low, max(score) OVER w AS high FROM e WINDOW w AS (PARTITION BY query_id)),
new AS (SELECT query_id, doc_id, rank AS prev, round(CASE WHEN n < 2 THEN score WHEN high <= low THEN 1 - (rank - 1) / n ELSE (score - low) / (high - low) + 0.001 * (n - (rank - 1)) / n END, 6) AS score FROM x)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, prev) - 1 AS INT) AS rank FROM new"""
)
def dense_only_plan(spark, d):
    """A plan of steps with a plug-in search over rewritten questions: hyde, search, evidence, normalised scores."""
    search = lambda docs, qs, k: lexical.bm25(indexed(spark, d), qs, k, tokens=T.plain_tokens)
    c = planner.Context(documents(spark, d), asked(spark, d), strategy=planner.STRATEGIES["dense_only"], searches={"dense": search}, rewriter=lambda qs: qs.withColumn("query", F.concat("query", F.lit(" the"))))
    return ranked(planner.run(c, ["hyde_expansion", "dense_vector", "dense_to_evidence", "score_normalize"]).evidence)


@query(
    f"""WITH {bm25_sql('bm', 100, PLAIN)}, {bm25_sql('al', 100, PLAIN, "SELECT item_id AS query_id, text || ' of' AS query FROM benchmark")}, {bm25_sql('be', 100, PLAIN, "SELECT item_id AS query_id, text || ' and' AS query FROM benchmark")},
every AS (SELECT *, 0.4 AS w FROM bm UNION ALL SELECT *, 0.25 FROM al UNION ALL SELECT *, 0.6 / 2 FROM be),
f AS (SELECT query_id, doc_id, round(sum(w / (60.0 + rank)), 6) AS score FROM every GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM f QUALIFY rank <= 10"""
)
def ensemble_fusion(spark, d):
    """A sparse list and two plug-in lists, one with a weight of its own, the other with its share of the dense weight."""
    also = lambda word: lambda docs, qs, k: lexical.bm25(indexed(spark, d), qs.withColumn("query", F.concat("query", F.lit(word))), k, tokens=T.plain_tokens)
    c = planner.Context(documents(spark, d), asked(spark, d), searches={"dense": also(" of"), "dense_b": also(" and")}, ensemble={"dense": 0.25})
    return ranked(planner.run(c, ["sparse_bm25", "dense_vector", "rrf_fusion"]).evidence)


@query("SELECT item_id AS query_id, CASE WHEN item_id % 3 = 0 THEN NULL ELSE 'said ' || len(text) END AS said FROM benchmark")
def generated_answers(spark, d):
    """A plug-in generator that fails for every third question, where answers stay null."""
    def write(system, prompt):
        number, _, text = prompt.partition(" ")
        if int(number) % 3 == 0:
            raise RuntimeError
        return f"said {len(text)}"

    rows = answers.generated(asked(spark, d).withColumn("prompt", F.concat_ws(" ", "query_id", "query")), lambda: write, "said")
    return rows.select("query_id", "said")


@query("SELECT doc_id, CASE WHEN len(trim(regexp_extract(text, '[^\\s]+'))) > 0 THEN instr(text, regexp_extract(text, '[^\\s]+')) - 1 END AS start, len(nullif(regexp_extract(text, '[^\\s]+'), '')) AS size, CASE WHEN regexp_matches(text, '[^\\s]') THEN 'pii' END AS kind FROM documents")
def entity_spans(spark, d):
    """A model that finds each text's first word as a person, a few characters off; its span is mended."""
    def model(text):
        word = text.split()[:1]
        return "found: " + json.dumps([{"value": w, "type": "person", "start": max(0, text.find(w) - 7)} for w in word] + [{"value": "\u0001", "start": 0}])

    rows = S.entity_spans(documents(spark, d).select("doc_id", "text", F.array().cast(S.SPANS).alias("spans")), lambda: model)
    first = F.try_element_at("spans", F.lit(1))
    return rows.select("doc_id", first["start"].cast("long").alias("start"), (first["end"] - first["start"]).cast("long").alias("size"), first["type"].alias("kind"))


@query(
    """WITH w AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'q', 'g'), '[a-z]+')) AS word FROM documents), c AS (SELECT word, count(*) AS n, ceil(len(word) / 4.0) AS p FROM w GROUP BY word)
SELECT round(sum(CASE WHEN p >= 3 THEN n ELSE 0 END) / sum(n), 6) AS fragmented, round(sum(p * n) / sum(n), 6) AS mean_pieces, round(sum(CASE WHEN len(word) > 12 THEN n ELSE 0 END) / sum(n), 6) AS technical, round(sum(CASE WHEN p > 1 THEN n ELSE 0 END) / sum(n), 6) AS unknown FROM c"""
)
def piece_profile(spark, d):
    letters = F.array_join(T.found(F.regexp_replace("text", "[^\\x00-\\x7F]", "q"), "[a-z]+"), " ")
    return tuning.piece_profile(documents(spark, d).select(letters.alias("text")), lambda words: [-(-len(w) // 4) for w in words])


@query("SELECT doc_id, round(least(greatest(0.25 * least(n / 400, 1) + 0.25 * 0.5 + 0.15 * (doc_id % 10) / 10 + 0.20 * 1 + 0.15 * 0, 0), 1), 6) AS gap, CASE WHEN round(least(greatest(0.25 * least(n / 400, 1) + 0.25 * 0.5 + 0.15 * (doc_id % 10) / 10 + 0.20 * 1 + 0.15 * 0, 0), 1), 6) < 0.3 THEN 'none' WHEN round(least(greatest(0.25 * least(n / 400, 1) + 0.25 * 0.5 + 0.15 * (doc_id % 10) / 10 + 0.20 * 1 + 0.15 * 0, 0), 1), 6) < 0.6 THEN 'optional' ELSE 'recommended' END AS advice FROM (SELECT doc_id, len(text) AS n FROM documents)")
def domain_gap(spark, d):
    gap = tuning.domain_gap(F.length("text") / 400, F.lit(0.5), F.col("doc_id") % 10 / 10, F.lit(3.0), F.lit(-1.0))
    return documents(spark, d).select("doc_id", gap.alias("gap"), tuning.gap_advice(gap).alias("advice"))


@query("SELECT event_id, round(0.30 * least((user_id % 9) / 5.0, 1) + 0.20 * 0.5 + 0.15 * 0.5 + 0.15 * 0.5 + 0.10 * greatest(1 - (value / 20) / 5, 0) + 0.10 * 0.5, 6) AS fitness FROM events")
def run_fitness(spark, d):
    return table(spark, d, "events").select("event_id", tuning.run_observation(F.col("user_id") % 9, 5, F.col("value") / 20).alias("fitness"))


# --- Levels by kind, chunks and pairs


@query(
    f"""{LEVELS_SQL}, g AS (SELECT query_id, any_value(kind) AS kind, doc_id, max(sim) FILTER (WHERE level = 2) AS own, coalesce(max(sim) FILTER (WHERE level = 1), 0) AS p, coalesce(max(sim) FILTER (WHERE level = 0), 0) AS t FROM s GROUP BY query_id, doc_id),
b AS (SELECT query_id, kind, level, doc_id, round(max(sim), 6) AS sim FROM s WHERE kind = 'synthesis' GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY sim DESC, doc_id) AS r FROM b),
x AS (SELECT query_id, doc_id, round(own, 6) AS score FROM g WHERE kind = 'specification' UNION ALL SELECT query_id, doc_id, round(own + p * 0.3 + t * 0.2, 6) FROM g WHERE kind NOT IN ('specification', 'synthesis')
  UNION ALL SELECT query_id, doc_id, round(sum(1 / (60.0 + r)), 6) FROM r GROUP BY query_id, doc_id)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x QUALIFY rank <= 10"""
)
def multiscale_adaptive(spark, d):
    return ranked(multiscale.adaptive(entries(spark, d), level_queries(spark, d)))


@query("SELECT doc_id, substr(text, 1, 60) AS anchor, trim(text) AS positive FROM documents WHERE trim(substr(text, 1, 60)) <> '' AND len(regexp_extract_all(text, '[^\\s]+')) >= 5 AND substr(text, 1, 60) = trim(substr(text, 1, 60)) AND text = trim(text, ' ' || chr(9) || chr(10) || chr(13))")
def title_pairs(spark, d):
    rows = documents(spark, d).where((F.col("title") == F.trim("title")) & (F.col("text") == F.btrim("text", F.lit(" \t\n\r"))))
    return training.title_pairs(rows.withColumn("heading", F.lit("")))


@query("SELECT doc_id, text AS positive, 'n' || doc_id AS negative FROM documents")
def exported_examples(spark, d):
    path = _folder(spark)
    training.export(documents(spark, d).select("doc_id", F.col("text").alias("positive"), F.concat(F.lit("n"), "doc_id").alias("negative")), path)
    return store.read_tables(spark, path)[0]["examples"]


@query(
    f"""{GOLDEN_SQL}, m AS (SELECT id, CASE WHEN len(wn) = 0 THEN 1 ELSE round(len(list_intersect(wn, list_slice(retrieved, 1, 5))) / len(wn), 6) END AS recall_at_k,
CASE WHEN len(c) = 0 THEN CASE WHEN len(wn) = 0 THEN 1 ELSE 0 END WHEN len(wn) = 0 THEN 0 ELSE round(len(list_filter(c, lambda x: list_contains(wn, x))) / len(c), 6) END AS citation_source_accuracy,
CASE WHEN len(terms) = 0 THEN 1 ELSE round(len(list_filter(terms, lambda t: contains(lower(answer), lower(t)))) / len(terms), 6) END AS expected_term_match,
CASE WHEN id % 10 <> 0 THEN 1 WHEN len(retrieved) > 0 THEN 0 ELSE 0 END AS no_evidence_behavior FROM (SELECT *, list_slice(retrieved, 1, 3) AS c FROM w))
SELECT id, CAST(recall_at_k AS DOUBLE) AS recall_at_k, CAST(citation_source_accuracy AS DOUBLE) AS citation_source_accuracy, CAST(expected_term_match AS DOUBLE) AS expected_term_match, CAST(no_evidence_behavior AS DOUBLE) AS no_evidence_behavior,
round((recall_at_k + citation_source_accuracy + expected_term_match + no_evidence_behavior) / 4.0, 6) AS overall FROM m"""
)
def evaluation_metrics(spark, d):
    rows = golden(spark, d)
    results = rows.select("id", "answer", "retrieved", F.slice("retrieved", 1, 3).alias("cited"))
    return verify.evaluate(rows.select("id", "expected_sources", "expected_terms", (F.col("id") % 10 == 0).alias("no_evidence")), results).drop("no_evidence")


# --- Streams, each run to the end of what there is


def _streamed(spark, d, columns, run) -> object:
    """The last table that a stream of events, read from a folder, gave to its sink."""
    root, out = _folder(spark), f"{_folder(spark)}/out"
    table(spark, d, "events").select(*columns).write.parquet(root)
    rows = spark.readStream.schema(spark.read.parquet(root).schema).parquet(root)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    found, mode = run(rows)
    found.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", _folder(spark)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


@query("SELECT event_type AS arm, count(*) AS pulls, round(sum(least(greatest(value / 100, 0), 1)), 6) AS total FROM events GROUP BY event_type")
def stream_arms(spark, d):
    reward = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    found = _streamed(spark, d, ["event_type", "value"], lambda rows: (state.arm_stream(rows.select(F.col("event_type").alias("arm"), reward.alias("reward"))), "complete"))
    return found.select("arm", "pulls", F.round("total", 6).alias("total"))


@query("SELECT event_type AS arm, epoch(date_trunc('hour', ts))::BIGINT AS hour, count(*) AS pulls, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def stream_windows(spark, d):
    found = _streamed(spark, d, ["event_type", "value", "ts"], lambda rows: (state.windowed_rewards(rows.select(F.col("event_type").alias("arm"), F.col("value").alias("reward"), F.col("ts").cast("timestamp").alias("ts"))), "complete"))
    return found.select("arm", F.unix_timestamp("w.start").alias("hour"), "pulls", F.round("mean", 6).alias("mean"))


@query()
def stream_lifecycle(spark, d):
    found = _streamed(spark, d, ["event_type", "event_id", "value"], lambda rows: (state.lifecycle_stream(rows.select(F.col("event_type").alias("technique"), F.col("event_id").alias("seq"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("value"))), "update"))
    return found.select("technique", "state", F.round("fitness", 6).alias("fitness"), F.col("n").alias("observations"))


@query(f"SELECT doc_id, CAST(dl AS INT) AS dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM (SELECT item_id AS doc_id, {PLAIN.format('text')} AS t FROM benchmark)) GROUP BY ALL")
def stream_postings(spark, d):
    """Postings of documents as they arrive; the questions stand for documents."""
    root, out = _folder(spark), _folder(spark)
    asked(spark, d).select(F.col("query_id").alias("doc_id"), F.col("query").alias("text")).write.parquet(root)
    rows = spark.readStream.schema("doc_id long, text string").parquet(root)
    state.postings_stream(rows, out, _folder(spark), T.plain_tokens).awaitTermination()
    return spark.read.schema("doc_id long, dl int, term string, tf int").parquet(out).withColumn("tf", F.col("tf").cast("long"))
