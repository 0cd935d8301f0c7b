"""More of the engine's queries: text scores, chunks, graphs, levels, verification, evaluation, tuning."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import questions as Q
from .functions import sensitive as S
from .functions import text as T
from .operators import answers, chunking, fusion, graph, lexical, multiscale, training, tuning, verify
from .queries import EVIDENCE_SQL, PLAIN, asked, bm25_sql, documents, evidence, indexed, query, ranked, reranked_sql, table
from .sources import stage

# --- Text scores

_split = r"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda s: s <> '')"
_punct = T.PUNCTUATION.replace("'", "''")
_words = rf"list_filter(list_transform(regexp_extract_all(text, '[^\s]+'), lambda w: trim(w, '{_punct}')), lambda w: w <> '')"
_ramp = "least(greatest(({0} - {1}) / {2}, 0), 1)"
_technical = T.TECHNICAL.replace("'", "''")


def _of(pattern: str, text: str = "text") -> str:
    return "len(regexp_extract_all(" + text + ", '" + pattern.replace("'", "''") + "'))"


COMPLEXITY_SQL = f"""WITH w AS (SELECT doc_id, text, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS ascii, {_split.format(x='text')} AS s, {_words} AS w FROM documents),
c AS (SELECT doc_id, {_ramp.format('len(s)', 1, 9)} AS n_sentences,
  CASE WHEN len(s) > 0 THEN {_ramp.format("list_sum(list_transform(s, lambda x: len(regexp_extract_all(x, '[^\\s]+')))) / len(s)", 8, 22)} ELSE 0 END AS sentence_length,
  CASE WHEN len(w) > 0 THEN {_ramp.format('len(list_distinct(list_transform(w, lambda x: lower(x)))) / len(w)', 0.3, 0.6)} ELSE 0 END AS diversity,
  CASE WHEN len(w) > 0 THEN {_ramp.format('(' + _of(T.TECHNICAL, 'ascii') + ' + len(list_filter(w, lambda x: len(x) > 12))) / len(w)', 0, 0.08)} ELSE 0 END AS technical,
  CASE WHEN len(w) > 0 THEN {_ramp.format(_of(T.CITED) + ' / len(w)', 0, 0.03)} ELSE 0 END AS citations,
  CASE WHEN len(w) > 0 THEN {_ramp.format(_of(T.LISTED) + ' / len(w)', 0, 0.05)} ELSE 0 END AS lists,
  CASE WHEN len(w) > 0 THEN {_ramp.format("len(list_filter(w, lambda x: regexp_matches(x, '[0-9]'))) / len(w)", 0, 0.20)} ELSE 0 END AS numbers FROM w),
x AS (SELECT doc_id, least(greatest({" + ".join(f"{w} * {k}" for k, w in T.COMPLEXITY_WEIGHTS.items())}, 0), 1) AS score FROM c)"""
_label = "CASE WHEN {0} <= 0.33 THEN 'low' WHEN {0} <= 0.66 THEN 'medium' ELSE 'high' END"


def complexity_of(docs):
    return docs.select("doc_id", T.complexity(T.complexity_parts(F.col("text"))).alias("score"))


@query(f"{COMPLEXITY_SQL} SELECT doc_id, round(score, 6) AS score, {_label.format('score')} AS label FROM x")
def complexity_score(spark, d):
    return complexity_of(documents(spark, d)).select("doc_id", F.round("score", 6).alias("score"), T.complexity_label(F.col("score")).alias("label"))


def _vote(name: str, toks: str = "t") -> str:
    words = ", ".join(f"'{w}'" for w in T.PANEL[name][2].split())
    return f"least(len(list_filter({toks}, lambda x: list_contains([{words}], x))) / 5.0, 1) AS {name}"


_votes = ", ".join(map(_vote, T.PANEL))
_mean = "round((" + " + ".join(f"{w} * {k}" for k, (w, _, _) in T.PANEL.items()) + f") / {sum(w for w, _, _ in T.PANEL.values())}, 6)"
_storage = "round(" + " + ".join(f"({s}) * {k}" for k, (_, s, _) in T.PANEL.items()) + " + 0.10 * score, 6)"
_role = "CASE WHEN context_sovereignty >= 0.45 THEN '{}' WHEN methodology >= 0.5 THEN '{}' WHEN novelty >= 0.5 OR emergence_leverage >= 0.5 THEN '{}' ELSE '{}' END"
#: The driver's prose is invented, so each document also gets English words by its id, some of which the panel knows.
WORDS = "must never safety novel frontier protocol algorithm workflow context evidence verified feedback cascade template default score test warning security critical".split()
_seeded = f"text || ' ' || array_to_string(list_transform(range(doc_id % 9), lambda i: [{', '.join(repr(w) for w in WORDS)}][1 + (doc_id * 7 + i * i) % {len(WORDS)}]), ' ')"
PANEL_SQL = f"{COMPLEXITY_SQL}, v AS (SELECT *, {_votes} FROM (SELECT x.doc_id, x.score, {PLAIN.format(_seeded)} AS t FROM x JOIN documents USING (doc_id)))"


def voted(spark, d, held=None):
    """Votes and complexity of all documents, or of those of a ``doc_id`` table."""
    docs = documents(spark, d)
    if held is not None:
        docs = docs.join(lexical.near(held.select("doc_id").distinct()), "doc_id", "left_semi")
    words = F.array(*map(F.lit, WORDS))
    picks = F.transform(F.sequence(F.lit(0), F.col("doc_id") % 9), lambda i: F.element_at(words, (1 + (F.col("doc_id") * 7 + i * i) % len(WORDS)).cast("int")))
    seeded = F.concat_ws(" ", "text", F.array_join(F.slice(picks, F.lit(1), (F.col("doc_id") % 9).cast("int")), " "))
    score = T.complexity(T.complexity_parts(F.col("text")))
    return docs.select("doc_id", score.alias("score"), *(v.alias(k) for k, v in T.panel_votes(seeded).items()))


def _v():
    return {k: F.col(k) for k in T.PANEL}


@query(f"{PANEL_SQL} SELECT doc_id, {', '.join(T.PANEL)}, {_mean} AS combined, {_storage} AS storage FROM v")
def panel_scores(spark, d):
    rows = voted(spark, d)
    return rows.select("doc_id", *T.PANEL, T.panel_mean(_v()).alias("combined"), T.panel_storage(_v(), F.col("score")).alias("storage"))


@query(
    f"""{PANEL_SQL} SELECT doc_id, CASE WHEN accuracy_criticality >= 0.6 THEN 'hard' WHEN accuracy_criticality >= 0.35 THEN 'medium' ELSE 'soft' END AS tier,
{_role.format('context_sovereignty_rule', 'methodology', 'frontier_concept', 'operational_hint')} AS concept, {_role.format('constrain', 'route', 'seed', 'support')} AS role FROM v"""
)
def contract_tier(spark, d):
    return voted(spark, d).select("doc_id", T.contract_tier(_v()).alias("tier"), T.concept_type(_v()).alias("concept"), T.emergence_role(_v()).alias("role"))


@query(f"{PANEL_SQL} SELECT doc_id, CASE WHEN score > 0.66 OR {_mean} > 0.7 THEN 'deep' WHEN score <= 0.33 AND {_mean} <= 0.3 THEN 'fast' ELSE 'standard' END AS routing FROM v")
def routing_tag(spark, d):
    return voted(spark, d).select("doc_id", T.routing_tag(F.col("score"), T.panel_mean(_v())).alias("routing"))


_factor = "CASE WHEN accuracy_criticality >= 0.82 AND reproducibility < 0.7 THEN 1.5 WHEN st >= 0.55 THEN least(1 + (st - 0.55), 1.5) ELSE 0.5 + st / 0.55 * 0.5 END"


@query(
    reranked_sql(f"ev.score * {_factor}", f"JOIN (SELECT *, {_storage} AS st FROM v) v USING (doc_id)", before=EVIDENCE_SQL + ", " + PANEL_SQL.removeprefix("WITH "), columns=", ev.score AS pre_filter_score")
)
def selective_filter(spark, d):
    found = evidence(spark, d)
    scored = voted(spark, d, found).select("doc_id", F.col("accuracy_criticality").alias("accuracy"), "reproducibility", T.panel_storage(_v(), F.col("score")).alias("store_score"))
    return ranked(fusion.selective_filter(found.join(lexical.near(scored), "doc_id")), "pre_filter_score")


@query("SELECT doc_id, 'doc_' || substr(sha256(encode(source) || '\\x00'::BLOB || encode(text)), 1, 16) AS id FROM documents")
def stable_id(spark, d):
    return documents(spark, d).select("doc_id", T.stable_id(F.col("source"), F.col("text")).alias("id"))


@query(f"SELECT doc_id, nth - 1 AS position, s AS text FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS nth FROM (SELECT doc_id, {_split.format(x='text')} AS s FROM documents))")
def sentence_split(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("position", "text")).withColumn("position", F.col("position").cast("long"))


@query(
    r"""SELECT page_id, CAST(count(*) AS BIGINT) AS headings FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS l FROM pages)
WHERE trim(l) <> '' AND (trim(l) LIKE '#%' OR (len(trim(l)) < 80 AND NOT right(trim(l), 1) IN ('.', '!', '?', ':', ';', ',') AND regexp_matches(trim(l), '^[\p{Lu}\p{Nd}]'))) GROUP BY page_id"""
)
def heading_lines(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("l"))
    return rows.where(T.is_heading(F.col("l"))).groupBy("page_id").agg(F.count("*").alias("headings"))


PAGE_TITLE = "<h1>([^<]*)"


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(html, '<h1>([^<]*)', 1)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN regexp_matches(lower(url), 'test|spec') THEN 'testing' WHEN regexp_matches(lower(url), 'cli|command') THEN 'cli_ux' WHEN regexp_matches(lower(url), 'api|server|route') THEN 'api'
WHEN regexp_matches(lower(url), 'db|store|schema') THEN 'persistence' WHEN regexp_matches(lower(url), 'retriev|search|rag') THEN 'retrieval' WHEN regexp_matches(lower(url), 'config|settings') THEN 'configuration' ELSE 'implementation' END AS category FROM pages"""
)
def page_slugs(spark, d):
    return table(spark, d, "pages").select("page_id", T.slug(F.regexp_extract("html", PAGE_TITLE, 1)).alias("slug"), graph.path_category(F.col("url")).alias("category"))


# --- Chunks


@query(r"SELECT doc_id, nth - 1 AS position, p AS text FROM (SELECT doc_id, unnest(p) AS p, generate_subscripts(p, 1) AS nth FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS p FROM documents))")
def paragraph_split(spark, d):
    docs = documents(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return chunking.paragraphs(docs, 10**9).withColumn("position", F.col("position").cast("long"))


@query(
    r"""WITH RECURSIVE p AS (SELECT doc_id, nth AS para, t FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda x: x <> '')) AS t,
  generate_subscripts(list_filter(list_transform(string_split_regex(text, '\n\s*\n+'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))), lambda x: x <> ''), 1) AS nth FROM documents)),
l AS (SELECT doc_id, para, string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)) AS s FROM p WHERE len(t) > 900),
f AS (SELECT doc_id, para, s, 1 AS i, s[1] AS now, len(s[1]) + 1 AS size, CAST(NULL AS VARCHAR) AS done FROM l
  UNION ALL SELECT doc_id, para, s, i + 1, CASE WHEN size = 0 OR (size > 0 AND size + len(s[i + 1]) + 1 > 900) THEN s[i + 1] ELSE now || ' ' || s[i + 1] END,
    CASE WHEN size > 0 AND size + len(s[i + 1]) + 1 > 900 THEN len(s[i + 1]) ELSE size + len(s[i + 1]) + 1 END, CASE WHEN size > 0 AND size + len(s[i + 1]) + 1 > 900 THEN now END FROM f WHERE i < len(s)),
c AS (SELECT doc_id, para, i, trim(done) AS t FROM f WHERE trim(done) <> '' UNION ALL SELECT doc_id, para, i + 1, trim(now) FROM f WHERE i = len(s) AND trim(now) <> '' UNION ALL SELECT doc_id, para, 1, t FROM p WHERE len(t) <= 900),
n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY para, i) AS nth FROM c),
g AS (SELECT doc_id, nth, t AS text FROM n WHERE nth = 1 UNION ALL SELECT n.doc_id, n.nth, right(g.text, 40) || n.t FROM g JOIN n ON n.doc_id = g.doc_id AND n.nth = g.nth + 1)
SELECT doc_id, CAST(nth - 1 AS INT) AS position, text FROM g"""
)
def packed_chunks(spark, d):
    return chunking.paragraphs(documents(spark, d), 900, 40)


@query()
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(documents(spark, d))


_bare = "trim({}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_pieces = lambda text, pattern, trim: rf"list_filter(list_transform(string_split(regexp_replace({text}, '([.!?])\s+({pattern})', '\1' || chr(30) || '\2', 'g'), chr(30)), lambda x: {trim}), lambda x: x <> '')"


@query(
    f"""WITH RECURSIVE r AS (SELECT doc_id, text, {_pieces('text', '[A-Z]', _bare.format('x'))} AS raw FROM documents),
f AS (SELECT doc_id, raw, 1 AS i, raw[1] AS now, CAST(NULL AS VARCHAR) AS done FROM r WHERE len(raw) > 0
  UNION ALL SELECT doc_id, raw, i + 1, CASE WHEN len(raw[i + 1]) < 30 THEN now || ' ' || raw[i + 1] ELSE raw[i + 1] END, CASE WHEN len(raw[i + 1]) >= 30 THEN now END FROM f WHERE i < len(raw)),
s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, t AS text FROM (SELECT doc_id, i, done AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, now FROM f WHERE i = len(raw))),
g AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {_bare.format('x')}), lambda x: x <> '') AS given, text FROM documents),
k AS (SELECT doc_id, CASE WHEN len(given) > 0 THEN given ELSE [text] END AS p, (SELECT count(*) FROM s WHERE s.doc_id = g.doc_id) AS n FROM g),
p AS (SELECT doc_id, unnest(p) AS text, generate_subscripts(p, 1) - 1 AS position FROM k WHERE NOT (len(p) = 1 AND n >= 4)
  UNION ALL SELECT s.doc_id, string_agg(s.text, ' ' ORDER BY position), position // 3 FROM s JOIN k ON k.doc_id = s.doc_id WHERE len(p) = 1 AND n >= 4 GROUP BY s.doc_id, position // 3)
SELECT doc_id, CAST(level AS INT) AS level, CAST(position AS INT) AS position, text FROM (SELECT doc_id, 0 AS level, position, text FROM s UNION ALL SELECT doc_id, 1, position, text FROM p UNION ALL SELECT doc_id, 2, 0, text FROM documents WHERE text IS NOT NULL)"""
)
def scale_chunks(spark, d):
    return chunking.scales(documents(spark, d))


_last = "rtrim(list_last(regexp_extract_all(now, '[a-zA-Z][.a-zA-Z]*')), '.')"
_short = f"coalesce(now LIKE '%.' AND (lower({_last}) IN ({', '.join(repr(a) for a in T.ABBREVIATIONS)}) OR regexp_matches({_last}, '^[A-Z]$')), false)"


@query(
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents)),
p AS (SELECT doc_id, ln, CASE WHEN l LIKE '#%' THEN [l] ELSE {_pieces('l', "[A-Z0-9(\\[\"'']", 'trim(x)')} END AS p FROM l),
f AS (SELECT doc_id, ln, p, 1 AS i, p[1] AS now, CAST(NULL AS VARCHAR) AS done FROM p WHERE len(p) > 0
  UNION ALL SELECT doc_id, ln, p, i + 1, CASE WHEN {_short} THEN now || ' ' || p[i + 1] ELSE p[i + 1] END, CASE WHEN NOT {_short} THEN now END FROM f WHERE i < len(p))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln, i) - 1 AS INT) AS position, t AS text FROM (SELECT doc_id, ln, i, done AS t FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, ln, i + 1, now FROM f WHERE i = len(p))"""
)
def careful_sentences(spark, d):
    return chunking.sentence_chunks(documents(spark, d))


_cuts = f"SELECT doc_id, nth - 1 AS position, s AS text FROM (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS nth FROM (SELECT doc_id, {_split.format(x='text')} AS s FROM documents))"


@query(
    rf"""WITH c AS ({_cuts}), p AS (SELECT doc_id, position, trim(text) AS anchor, trim(lead(text) OVER (PARTITION BY doc_id ORDER BY position)) AS positive FROM c)
SELECT * FROM p WHERE len(regexp_extract_all(anchor, '[^\s]+')) >= 5 AND len(regexp_extract_all(positive, '[^\s]+')) >= 5"""
)
def adjacent_pairs(spark, d):
    return training.adjacent_pairs(sentence_split(spark, d))


@query(
    f"""WITH {bm25_sql('bm', 10)}, r AS (SELECT bm.*, o.source FROM bm JOIN documents o USING (doc_id))
SELECT query_id AS pair_id, arg_min(doc_id, rank) AS negative_id FROM r WHERE source <> 'src' || (query_id % 20) GROUP BY query_id"""
)
def hard_negatives(spark, d):
    pairs = asked(spark, d).select(F.col("query_id").alias("pair_id"), F.col("query").alias("anchor"), F.concat(F.lit("src"), F.col("query_id") % 20).alias("doc_id"))
    return training.hard_negatives(pairs, documents(spark, d).select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), "text"))


# --- Questions

QUESTIONS = [
    "Why does the model fail? What can be done?", "compare the two drug trials and the imaging study of retinal scans across sites, and clinical triage", "What is BERT?",
    "Define sepsis", "summarize the evidence for telemedicine", "How do random forests detect sepsis", "how are models applied to triage", "list the exact procedure code",
    "What is the current evidence on surgical robots", "explain ontology", "what type of scan did the study use in what setting", "How does warfarin affect bleeding",
]
_asked = "(SELECT conv_id * 1000 + turn AS qid, text AS q FROM conversations WHERE role = 'user' UNION ALL SELECT -i, q FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS, 1)) + ") v(i, q))"
_low = f"(SELECT qid, q, lower(trim(q)) AS l, len(regexp_extract_all(lower(trim(q)), '[^\\s]+')) AS words, regexp_matches(lower(trim(q)), '{Q.STUDY}') AS study, contains(lower(trim(q)), 'being') AS being, len(q) - len(replace(q, ',', '')) AS commas FROM {_asked})"


def questions(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("q"))
    return rows.unionByName(spark.createDataFrame([(-i, q) for i, q in enumerate(QUESTIONS, 1)], "qid long, q string"))


SIMPLE_SQL = "CASE WHEN len(l) - len(replace(l, '?', '')) > 1 OR regexp_matches(l, 'compare|contrast|synthesi[sz]e|versus') THEN 'synthesis' WHEN regexp_matches(l, '^(what is|define|definition of|describe)') THEN 'specification' WHEN regexp_matches(l, 'why|how|because|reason|cause|explain') THEN 'logic' ELSE 'summary' END"


@query(f"SELECT qid, {SIMPLE_SQL} AS kind FROM {_low}")
def query_type(spark, d):
    return questions(spark, d).select("qid", Q.simple_type(F.col("q")).alias("kind"))


def _signal_sql(kind: str) -> str:
    parts = []
    for k, points, guard, what in Q.SIGNALS:
        if k == kind and guard == "+":
            parts += [f"CASE WHEN contains(l, '{p}') THEN {points} ELSE 0 END" for p in what.split("|")]
        elif k == kind:
            parts.append(f"CASE WHEN {guard or 'true'} AND {f'''regexp_matches(l, '{what}')''' if what else 'true'} THEN {points} ELSE 0 END")
    return " + ".join(parts)


@query(
    f"""WITH s AS (SELECT qid, l, words, {', '.join(f'{_signal_sql(k)} AS {k}' for k in Q.KINDS)} FROM {_low}),
t AS (SELECT qid, synthesis, summary, logic, specification + CASE WHEN regexp_matches(l, '^what(\\s|$)') AND words < 14 AND summary = 0 THEN 1 ELSE 0 END AS specification FROM s)
SELECT qid, {', '.join(f'CAST({k} AS DOUBLE) AS {k}' for k in Q.KINDS)}, CASE greatest(synthesis, summary, logic, specification) WHEN synthesis THEN 'synthesis' WHEN summary THEN 'summary' WHEN logic THEN 'logic' ELSE 'specification' END AS kind FROM t"""
)
def query_type_multi(spark, d):
    scores = Q.signal_scores(F.col("q"))
    rows = questions(spark, d).select("qid", *(c.alias(k) for k, c in scores.items()))
    return rows.withColumn("kind", Q.best_kind({k: F.col(k) for k in Q.KINDS}))


_search = "(VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in Q.SEARCH.items()) + ") p(kind, dk, sk, dw, sw, fk, dv, mc)"


@query(
    f"""WITH k AS (SELECT qid, q, {SIMPLE_SQL} AS kind, len(q) - len(replace(q, '?', '')) > 1 AS several, len(q) > 100 AS long, (SELECT count(*) FROM documents) AS n FROM {_low})
SELECT qid, CAST((CASE WHEN n > 50 THEN trunc(dk * 1.5) ELSE dk END) + (CASE WHEN several THEN 10 ELSE 0 END) + (CASE WHEN long THEN 5 ELSE 0 END) AS INT) AS dense_k, CAST(CASE WHEN n > 50 THEN trunc(sk * 1.5) ELSE sk END AS INT) AS sparse_k,
CAST(round(dw / (dw + sw), 6) AS DOUBLE) AS dense_weight, CAST(round(sw / (dw + sw), 6) AS DOUBLE) AS sparse_weight, CAST(greatest(fk + CASE WHEN several THEN 5 ELSE 0 END, 3) AS INT) AS final_k, CAST(dv AS DOUBLE) AS diversity, CAST(mc AS DOUBLE) AS min_confidence
FROM k JOIN {_search} USING (kind)"""
)
def adaptive_params(spark, d):
    n = table(spark, d, "documents").agg(F.count("*").alias("n"))
    rows = questions(spark, d).crossJoin(F.broadcast(n)).withColumn("kind", Q.simple_type(F.col("q")))
    return rows.select("qid", *(c.alias(k) for k, c in Q.search_params(F.col("kind"), F.col("q"), F.col("n")).items()))


_hits = ", ".join(f"({i}, '{dom}', len(list_filter([{', '.join(repr(p) for p in Q.DOMAINS[dom].split('|'))}], lambda p: contains(lower(q), p))))" for i, dom in enumerate(Q.DOMAIN_ORDER))


@query(
    f"""WITH h AS (SELECT qid, i, dom, n FROM {_asked} x, LATERAL (VALUES {_hits}) v(i, dom, n) WHERE n > 0),
s AS (SELECT qid, list(dom ORDER BY n DESC, i) AS doms, max(n) AS top FROM h GROUP BY qid)
SELECT x.qid, CAST(CASE WHEN doms IS NULL THEN NULL WHEN top >= 2 OR len(doms) = 1 THEN 0.05 ELSE 0.03 END AS DOUBLE) AS boost, CASE WHEN doms IS NULL THEN NULL WHEN top >= 2 OR len(doms) = 1 THEN doms[1] ELSE array_to_string(doms, ',') END AS targets FROM {_asked} x LEFT JOIN s USING (qid)"""
)
def domain_hints(spark, d):
    rows = questions(spark, d).select("qid", Q.domain_hints(F.col("q")).alias("h"))
    return rows.select("qid", F.col("h.boost").alias("boost"), F.array_join("h.targets", ",").alias("targets"))


# --- Sensitive data

_counts = ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS {n}" for n, p in (S.PII | S.PHI).items())


@query(f"SELECT doc_id, {_counts} FROM documents")
def sensitive_counts(spark, d):
    return documents(spark, d).select("doc_id", *(c.alias(n) for n, c in S.pattern_counts(F.col("text")).items()))


_redact = "text"
for _p in S.PII.values():
    _redact = f"regexp_replace({_redact}, '{_p}', '[REDACTED]', 'g')"


@query(f"SELECT doc_id, {_redact} AS redacted FROM documents")
def redact(spark, d):
    return documents(spark, d).select("doc_id", S.redacted(F.col("text")).alias("redacted"))


@query()
def sensitive_spans(spark, d):
    rows = S.redact_spans(S.spans(documents(spark, d).select("doc_id", "text")))
    return rows.select("doc_id", F.size("spans").alias("n_spans"), F.sha2("redacted", 256).alias("redacted_sha256"))


# --- Verification and evaluation


def _with_terms(spark, d):
    return lexical.matched_terms(documents(spark, d), asked(spark, d), evidence(spark, d))


@query(
    f"""{EVIDENCE_SQL}, m AS (SELECT ev.*, len(list_intersect({PLAIN.format('b.text')}, {PLAIN.format('o.text')})) AS met FROM ev JOIN documents o USING (doc_id) JOIN benchmark b ON item_id = query_id),
x AS (SELECT query_id, max(score) FILTER (WHERE rank = 1) AS s1, coalesce(max(score) FILTER (WHERE rank = 2), 0) AS s2, count(*) AS n, max(len(map_keys(source_ranks))) FILTER (WHERE rank = 1) AS k, max(met) FILTER (WHERE rank = 1) AS met,
  bool_or(len(map_extract(source_ranks, 'sparse')) > 0) FILTER (WHERE rank = 1) AS sp FROM m GROUP BY query_id)
SELECT item_id AS query_id, coalesce(round(least(s1 * 80, 1) * 0.25 + least(greatest(s1 - s2, 0) * 120, 1) * 0.10 + CASE WHEN k >= 2 THEN 1 ELSE 0.5 END * 0.25 + least(met / CASE WHEN sp THEN 4 ELSE 5 END, 1) * 0.30 + least(n / 3, 1) * 0.10, 6), 0) AS confidence,
  CAST(coalesce(n, 0) AS BIGINT) AS evidence_count FROM benchmark LEFT JOIN x ON item_id = query_id"""
)
def confidence(spark, d):
    return verify.confidence(_with_terms(spark, d), asked(spark, d))


@query(
    f"""{EVIDENCE_SQL}, c AS (SELECT query_id, CASE WHEN query_id % 3 = 0 AND rank = 2 THEN -1 ELSE doc_id END AS doc_id, source FROM ev JOIN documents USING (doc_id) WHERE rank <= 3 AND query_id % 5 <> 0),
m AS (SELECT query_id, count(*) FILTER (WHERE NOT EXISTS (FROM ev WHERE ev.query_id = c.query_id AND ev.doc_id = c.doc_id)) AS missing FROM c GROUP BY query_id)
SELECT item_id AS query_id, coalesce(missing = 0, false) AS grounded, CAST(coalesce(missing, 0) AS BIGINT) AS n_missing FROM benchmark LEFT JOIN m ON item_id = query_id"""
)
def citations_grounded(spark, d):
    held = lexical.of_documents(evidence(spark, d), documents(spark, d), "source")
    cited = held.where("rank <= 3 and query_id % 5 <> 0").withColumn("doc_id", F.when((F.col("query_id") % 3 == 0) & (F.col("rank") == 2), F.lit(-1).cast("long")).otherwise(F.col("doc_id")))
    return verify.grounded(cited, held, asked(spark, d))


_generic = " + ".join(f"CAST(contains(lower(answer), '{p}') AS INT)" for p in verify.GENERIC.split("|"))
_content = f"list_distinct(list_filter({PLAIN.format('{}')}, lambda t: NOT list_contains([{', '.join(repr(w) for w in verify.STOPWORDS)}], t)))"


@query(
    f"""{EVIDENCE_SQL}, a AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'In general, more or less: ' ELSE '' END || text AS answer FROM benchmark),
ans AS (SELECT query_id, unnest({_content.format('answer')}) AS term FROM a), et AS (SELECT DISTINCT query_id, unnest({_content.format('text')}) AS term FROM ev JOIN documents USING (doc_id)),
g AS (SELECT query_id, count(et.term) / count(*) AS share FROM ans LEFT JOIN et USING (query_id, term) GROUP BY query_id), s AS (SELECT a.query_id, coalesce(share, 0) AS share, greatest(1 - 0.15 * ({_generic}), 0) AS skeptic FROM a LEFT JOIN g USING (query_id))
SELECT query_id, round(share, 6) AS sovereignty, CAST(round(skeptic, 6) AS DOUBLE) AS skeptic, round(0.6 * share + 0.4 * skeptic, 6) AS overall FROM s"""
)
def tension(spark, d):
    said = asked(spark, d).select("query_id", F.concat(F.when(F.col("query_id") % 2 == 0, "In general, more or less: ").otherwise(""), "query").alias("answer"))
    return verify.tension(said, lexical.of_documents(evidence(spark, d), documents(spark, d), "text"))


GOLDEN_SQL = f"""{EVIDENCE_SQL}, r AS (SELECT query_id, list(source ORDER BY rank) AS retrieved FROM ev JOIN documents USING (doc_id) GROUP BY query_id),
g AS (SELECT item_id AS id, CASE WHEN item_id % 7 = 0 THEN [] ELSE ['SRC' || (item_id % 20), 'src' || (item_id * 3 % 20)] END AS want, list_slice(regexp_extract_all(text, '[A-Za-z]+'), 1, 3) || CASE WHEN item_id % 4 = 0 THEN ['zzz'] ELSE [] END AS terms, text AS answer, coalesce(retrieved, []) AS retrieved FROM benchmark LEFT JOIN r ON item_id = query_id),
w AS (SELECT *, list_distinct(list_transform(want, lambda x: lower(x))) AS wn FROM g)"""


def golden(spark, d):
    found = lexical.of_documents(evidence(spark, d), documents(spark, d), "source").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("retrieved"))
    rows = asked(spark, d).join(found, "query_id", "left")
    want = F.when(F.col("query_id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("SRC"), F.col("query_id") % 20), F.concat(F.lit("src"), F.col("query_id") * 3 % 20)))
    terms = F.concat(F.slice(T.found(F.col("query"), "[A-Za-z]+"), 1, 3), F.when(F.col("query_id") % 4 == 0, F.array(F.lit("zzz"))).otherwise(F.array().cast("array<string>")))
    return rows.select(F.col("query_id").alias("id"), want.alias("expected_sources"), terms.alias("expected_terms"), F.col("query").alias("answer"), F.coalesce("retrieved", F.array().cast("array<string>")).alias("retrieved"))


@query(f"{GOLDEN_SQL} SELECT id, CASE WHEN len(wn) = 0 THEN 1 ELSE round(len(list_intersect(wn, list_slice(retrieved, 1, 5))) / len(wn), 6) END AS recall FROM w")
def recall_at_k(spark, d):
    return golden(spark, d).select("id", verify.recall(F.col("expected_sources"), F.col("retrieved"), 5).alias("recall"))


@query(f"{GOLDEN_SQL} SELECT id, CASE WHEN len(retrieved) = 0 THEN CASE WHEN len(wn) = 0 THEN 1 ELSE 0 END WHEN len(wn) = 0 THEN 0 ELSE round(len(list_filter(retrieved, lambda x: list_contains(wn, x))) / len(retrieved), 6) END AS accuracy FROM w")
def citation_accuracy(spark, d):
    return golden(spark, d).select("id", verify.citation_accuracy(F.col("expected_sources"), F.col("retrieved")).alias("accuracy"))


@query(f"{GOLDEN_SQL} SELECT id, CASE WHEN len(terms) = 0 THEN 1 ELSE round(len(list_filter(terms, lambda t: contains(lower(answer), lower(t)))) / len(terms), 6) END AS term_share FROM w")
def term_match(spark, d):
    return golden(spark, d).select("id", verify.term_match(F.col("answer"), F.col("expected_terms")).alias("term_share"))


@query()
def evaluation_report(spark, d):
    rows = golden(spark, d)
    results = rows.select("id", "answer", "retrieved", F.slice("retrieved", 1, 3).alias("cited"))
    return verify.evaluate(rows.select("id", "expected_sources", "expected_terms", (F.col("id") % 10 == 0).alias("no_evidence")), results)


@query(
    f"""WITH {bm25_sql('bm', 10)}, rel AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents o ON contains(o.text, b.text)),
g AS (SELECT query_id, sum(1 / log2(rank + 1)) AS dcg, min(rank) AS first FROM bm JOIN rel USING (query_id, doc_id) GROUP BY query_id),
i AS (SELECT query_id, list_sum(list_transform(range(1, least(count(*), 10)::BIGINT + 1), lambda r: 1 / log2(r + 1))) AS ideal FROM rel GROUP BY query_id)
SELECT item_id AS query_id, round(coalesce(dcg / ideal, 0), 6) AS ndcg, round(coalesce(1 / first, 0), 6) AS mrr FROM benchmark LEFT JOIN g ON g.query_id = item_id LEFT JOIN i ON i.query_id = item_id"""
)
def ndcg_mrr(spark, d):
    docs, qs = documents(spark, d), asked(spark, d)
    # A document holds a passage only if it holds the passage's first words, which its hits and this join go by.
    anchor = lambda t: F.slice(F.split(t, r"\s+"), 1, 4)
    grams = docs.select("doc_id", "text", F.split("text", r"\s+").alias("w")).select("doc_id", "text", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 3, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, 4)))).alias("h"))
    firsts = qs.select("query_id", "query", F.xxhash64(F.slice(F.split("query", r"\s+"), 2, 4)).alias("h"))
    relevant = grams.join(firsts, "h").where(F.contains("text", "query")).select("query_id", "doc_id").distinct()
    return verify.ranking_metrics(lexical.bm25(indexed(spark, d), qs, 10), relevant, qs, 10)


@query(f"{EVIDENCE_SQL}, l AS (SELECT query_id, count(*) AS n, string_agg(CASE WHEN rank <= 3 THEN '- ' || substr(text, 1, 60) || ': ' || substr(text, 1, 180) END, chr(10) ORDER BY rank) AS lines FROM ev JOIN documents USING (doc_id) GROUP BY query_id), s AS (SELECT item_id, CASE WHEN len(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS shown FROM benchmark) SELECT item_id AS query_id, CASE WHEN n IS NULL THEN 'No cited evidence found for: ' || shown ELSE 'Retrieved ' || n || ' cited evidence item(s) for: ' || shown || chr(10) || lines END AS answer FROM s LEFT JOIN l ON item_id = query_id")
def template_answers(spark, d):
    held = lexical.of_documents(evidence(spark, d), documents(spark, d), "title", "text")
    return answers.template_answers(held, asked(spark, d))


@query(
    f"""{EVIDENCE_SQL}, b AS (SELECT query_id, rank, text, substr(text, 1, 60) AS title, 12000 - coalesce(sum(len(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM ev JOIN documents USING (doc_id)),
l AS (SELECT query_id, string_agg('[' || rank || '] Source: ' || title || chr(10) || CASE WHEN len(text) > room THEN substr(text, 1, room::BIGINT) || '...' ELSE text END, chr(10) || chr(10) ORDER BY rank) AS block FROM b WHERE room > 0 GROUP BY query_id)
SELECT item_id AS query_id, 'Evidence:' || chr(10) || coalesce(block, '(none)') || chr(10) || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer from the evidence above, and cite its numbers in brackets.' AS prompt FROM benchmark LEFT JOIN l ON item_id = query_id"""
)
def prompts(spark, d):
    return answers.prompts(lexical.of_documents(evidence(spark, d), documents(spark, d), "title", "text"), asked(spark, d))


# --- Graph: parts as methods, brands as families

_methods = "SELECT CAST(p_partkey AS VARCHAR) AS method_id, p_name AS problem, p_type AS solution, '' AS notes, split_part(p_name, ' ', 1) AS language, p_brand AS source FROM part"
_graph_tokens = "list_distinct(list_filter(regexp_extract_all(lower({}), '[a-z0-9_]+'), lambda t: len(t) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.GRAPH_STOPWORDS) + "], t)))"
_gq = "(SELECT DISTINCT p_name || ' economy brand' AS query_id, p_name || ' economy brand' AS query FROM part WHERE p_partkey % 10 = 0)"
GRAPH_SQL = f"""WITH m AS ({_methods}), q AS (SELECT query_id, len(t) AS n, unnest(t) AS term FROM (SELECT query_id, {_graph_tokens.format('query')} AS t FROM {_gq})),
p AS (SELECT method_id, unnest({_graph_tokens.format("concat_ws(' ', problem, solution, notes, language, 'category:' || lower(solution), source)")}) AS term FROM m),
rows_ AS (SELECT query_id, method_id, round(count(*) / any_value(n), 6) AS score FROM q JOIN p USING (term) GROUP BY query_id, method_id),
hit AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, method_id) AS INT) AS rank FROM rows_ QUALIFY rank <= 15)"""


def graph_tables(spark, d):
    part = table(spark, d, "part")
    methods = part.select(F.col("p_partkey").cast("string").alias("method_id"), F.col("p_name").alias("problem"), F.col("p_type").alias("solution"), F.lit("").alias("notes"), F.substring_index("p_name", " ", 1).alias("language"), F.array(F.concat(F.lit("category:"), F.lower("p_type"))).alias("tags"), F.col("p_brand").alias("source"))
    families = part.groupBy(F.col("p_brand").alias("family_id")).agg(F.max("p_type").alias("category")).select("family_id", F.col("family_id").alias("name"), F.concat(F.lit("bar:"), "family_id").alias("barcode"), F.when(F.col("family_id").endswith("5"), "draft").otherwise("approved").alias("status"), "category", F.lit("").alias("language"), F.array("family_id").alias("sources"), F.array(F.concat(F.lit("o"), F.length("family_id"))).alias("origins"))
    links = part.select(F.col("p_brand").alias("family_id"), F.col("p_partkey").cast("string").alias("method_id"), (F.col("p_size") / 50.0).alias("confidence"), F.lit("approved").alias("review_status"))
    text = F.concat("p_name", F.lit(" economy brand"))
    return methods, families, links, part.where("p_partkey % 10 = 0").select(text.alias("query_id"), text.alias("query")).distinct()


@query(f"{GRAPH_SQL} SELECT * FROM hit")
def graph_rows(spark, d):
    methods, _, _, qs = graph_tables(spark, d)
    return graph.search_methods(methods, qs).select("query_id", "method_id", "score", F.col("rank").cast("int").alias("rank"))


@query(
    f"""{GRAPH_SQL}, j AS (SELECT hit.*, CASE WHEN p_brand LIKE '%5' THEN NULL ELSE p_brand END AS family_id, round(score + CASE WHEN p_brand LIKE '%5' THEN 0 ELSE least(greatest(p_size / 50, 0), 1) * 0.05 END, 6) AS s FROM hit JOIN part ON CAST(p_partkey AS VARCHAR) = method_id),
k AS (SELECT query_id, coalesce('family:' || family_id, 'methodology:' || method_id) AS key, arg_max(method_id, {{'s': s, 'r': -rank}}) AS method_id, max(s) AS score FROM j GROUP BY ALL)
SELECT query_id, key, method_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM k QUALIFY rank <= 5"""
)
def graph_families(spark, d):
    found = graph.search_families(*graph_tables(spark, d), expand=False)
    return found.select("query_id", "key", "method_id", "score", F.col("rank").cast("int").alias("rank"))


_words = lambda *parts: _graph_tokens.format("concat_ws(' ', " + ", ".join(parts) + ")")
EXPANDED_SQL = f"""{GRAPH_SQL}, part_ AS (SELECT *, p_brand AS f, split_part(p_name, ' ', 1) AS lang FROM part),
fam AS (SELECT f, max(p_type) AS category, min(CAST(p_partkey AS VARCHAR)) AS first_method FROM part_ GROUP BY f),
j AS (SELECT hit.*, CASE WHEN p_brand LIKE '%5' THEN NULL ELSE p_brand END AS family_id, round(score + CASE WHEN p_brand LIKE '%5' THEN 0 ELSE least(greatest(p_size / 50, 0), 1) * 0.05 END, 6) AS s FROM hit JOIN part ON CAST(p_partkey AS VARCHAR) = method_id),
found AS (SELECT query_id, coalesce('family:' || family_id, 'methodology:' || method_id) AS key, any_value(family_id) AS family_id, arg_max(method_id, {{'s': s, 'r': -rank}}) AS method_id, max(s) AS score FROM j GROUP BY query_id, coalesce('family:' || family_id, 'methodology:' || method_id)),
keys_ AS (SELECT f, 'origin' AS kind, 'o' || len(f) AS v FROM fam UNION SELECT f, 'source', lower(f) FROM fam UNION SELECT f, 'category', lower(category) FROM fam UNION SELECT f, 'category', lower(p_type) FROM part_),
tok AS (SELECT DISTINCT f, t AS v FROM (SELECT f, unnest({_words("f", "translate('bar:' || f, ':-', '  ')", "category", "''", "f")}) AS t FROM fam UNION ALL SELECT f, unnest({_words('p_name', "''", 'lang', "'category:' || lower(p_type)", 'f')}) FROM part_)),
langs AS (SELECT f, list_distinct(list(lower(lang))) AS ls FROM part_ WHERE lang <> '' GROUP BY f), sizes AS (SELECT f, count(*) AS n FROM tok GROUP BY f),
every AS (SELECT * FROM keys_ UNION ALL SELECT f, 'token', v FROM tok),
pairs AS (SELECT x.f AS a, y.f AS b, CAST(bool_or(x.kind = 'origin') AS INT) AS origin, CAST(bool_or(x.kind = 'source') AS INT) AS source, CAST(bool_or(x.kind = 'category') AS INT) AS category, coalesce(list_sort(list_distinct(list(x.v) FILTER (WHERE x.kind = 'token'))), []) AS words
  FROM every x JOIN every y ON x.kind = y.kind AND x.v = y.v AND x.f <> y.f GROUP BY ALL),
w AS (SELECT p.*, CAST(coalesce(len(list_intersect(la.ls, lb.ls)) > 0, false) AS INT) AS language, len(words) AS shared, least(sa.n, sb.n) AS least_n FROM pairs p LEFT JOIN langs la ON la.f = a LEFT JOIN langs lb ON lb.f = b LEFT JOIN sizes sa ON sa.f = a LEFT JOIN sizes sb ON sb.f = b),
edge AS (SELECT a, b, round(least(origin * 0.95 + source * 0.55 + category * 0.58 + language * 0.05 + CASE WHEN shared > 0 THEN least(0.65, 0.22 + shared / greatest(least_n, 1) * 1.4) ELSE 0 END, 1), 6) AS weight, category = 1 AND origin = 0 AND source = 0 AND shared = 0 AS only_category,
  list_filter([CASE WHEN origin = 1 THEN 'same_split_origin' END, CASE WHEN source = 1 THEN 'shared_source' END, CASE WHEN category = 1 THEN 'shared_category' END, CASE WHEN language = 1 THEN 'shared_language' END, CASE WHEN shared > 0 THEN 'lexical_overlap:' || array_to_string(list_slice(words, 1, 5), ',') END], lambda x: x IS NOT NULL) AS reasons FROM w),
reach AS (SELECT query_id, score AS seed, e.*, row_number() OVER (PARTITION BY query_id, a, only_category ORDER BY b) AS nth FROM found JOIN edge e ON family_id = a WHERE weight >= 0.30 AND b NOT LIKE '%5'),
best AS (SELECT query_id, b AS family_id, max(g) AS graph, arg_min(list_concat(['from:' || a], reasons), {{'g': -g, 's': -seed, 'a': a}}) AS why FROM (SELECT *, round(greatest(seed - (0.09 - least(weight, 1) * 0.06), 0), 6) AS g FROM reach WHERE NOT only_category OR nth = 1) GROUP BY ALL),
both_ AS (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(key, 'family:' || y.family_id) AS key, coalesce(method_id, first_method) AS method_id, greatest(score, graph) AS score,
  CASE WHEN score IS NULL THEN 'graph' WHEN coalesce(graph > score, false) THEN 'direct+graph' ELSE 'direct' END AS source, CASE WHEN score IS NOT NULL AND NOT coalesce(graph > score, false) THEN '' ELSE array_to_string(why, ';') END AS reasons
  FROM found x FULL JOIN best y ON x.query_id = y.query_id AND x.family_id = y.family_id LEFT JOIN fam ON fam.f = y.family_id),
kept AS (SELECT * FROM both_ WHERE source <> 'graph' UNION ALL SELECT * FROM (SELECT * FROM both_ WHERE source = 'graph' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) <= 5))
SELECT query_id, key, method_id, score, source, reasons, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS INT) AS rank FROM kept QUALIFY rank <= 5"""


@query(EXPANDED_SQL)
def graph_expanded(spark, d):
    found = graph.search_families(*graph_tables(spark, d))
    return found.select("query_id", "key", "method_id", "score", "source", F.array_join("reasons", ";").alias("reasons"), F.col("rank").cast("int").alias("rank"))


# --- Levels: every third vector is a document, the next two its paragraph and sentence

_entries = "SELECT vec_id AS entry_id, CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS level, vec_id // 3 * 3 AS doc_id, embedding::DOUBLE[] AS vec FROM embeddings"
_kinds = "['synthesis', 'summary', 'logic', 'specification'][1 + label % 4]"
LEVELS_SQL = f"WITH e AS ({_entries}), q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, {_kinds} AS kind FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, kind, entry_id, level, doc_id, list_inner_product(q, vec) AS sim FROM q, e)"


def entries(spark, d):
    rows = table(spark, d, "embeddings")
    level = F.element_at(F.array(F.lit(2), F.lit(1), F.lit(0)), (F.col("vec_id") % 3 + 1).cast("int"))
    return rows.select(F.col("vec_id").alias("entry_id"), level.alias("level"), F.when(F.col("vec_id") % 3 > 0, F.floor(F.col("vec_id") / 3) * 3).alias("parent"), F.col("embedding").alias("vec"))


def level_queries(spark, d):
    kinds = F.array(*map(F.lit, Q.KINDS))
    return table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), F.element_at(kinds, (F.col("label") % 4 + 1).cast("int")).alias("kind"))


_lv = "(VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[4]})" for k, v in Q.LEVELS.items()) + ") l(kind, w2, w1, w0, k)"


@query(
    f"""{LEVELS_SQL}, x AS (SELECT query_id, level, entry_id, k, round(sim * CASE level WHEN 2 THEN w2 WHEN 1 THEN w1 ELSE w0 END, 6) AS score FROM s JOIN {_lv} USING (kind))
SELECT query_id, level, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, entry_id) AS INT) AS rank FROM x QUALIFY rank <= k"""
)
def multiscale_levels(spark, d):
    return multiscale.by_level(entries(spark, d), level_queries(spark, d)).withColumn("rank", F.col("rank").cast("int"))


@query(
    f"""{LEVELS_SQL}, g AS (SELECT query_id, doc_id, max(sim) FILTER (WHERE level = 2) AS own, coalesce(max(sim) FILTER (WHERE level = 1), 0) AS p, coalesce(max(sim) FILTER (WHERE level = 0), 0) AS t FROM s GROUP BY query_id, doc_id),
x AS (SELECT query_id, doc_id, round(own + p * 0.3 + t * 0.2, 6) AS score FROM g)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x QUALIFY rank <= 10"""
)
def multiscale_reranked(spark, d):
    return ranked(multiscale.reranked(entries(spark, d), level_queries(spark, d)))


@query(
    f"""{LEVELS_SQL}, b AS (SELECT query_id, level, doc_id, round(max(sim), 6) AS sim FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY sim DESC, doc_id) AS r FROM b),
x AS (SELECT query_id, doc_id, round(sum(1 / (60.0 + r)), 6) AS score FROM r GROUP BY ALL)
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM x QUALIFY rank <= 10"""
)
def multiscale_rrf(spark, d):
    return ranked(multiscale.fused_levels(entries(spark, d), level_queries(spark, d)))


def _unit(v: str) -> str:
    return f"(CASE WHEN list_inner_product({v}, {v}) > 0 THEN list_transform({v}, lambda x: x / sqrt(list_inner_product({v}, {v}))) ELSE {v} END)"


def _minus(a: str, b: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda z: z[1] - z[2])"


#: A document has one paragraph here, which is therefore the mean that its sentence moves away from.
DERIVED_SQL = f"""{LEVELS_SQL}, t AS (SELECT a.entry_id, a.vec AS sv, p.vec AS pv, o.vec AS dv FROM e a JOIN e p ON p.doc_id = a.doc_id AND p.level = 1 JOIN e o ON o.doc_id = a.doc_id AND o.level = 2 WHERE a.level = 0),
d1 AS (SELECT *, {_minus('sv', 'pv')} AS u FROM t), d2 AS (SELECT *, {_unit('u')} AS v1 FROM d1), d3 AS (SELECT *, {_minus('v1', _minus('sv', 'dv'))} AS u2 FROM d2), dd AS (SELECT entry_id, v1, {_unit('u2')} AS v2 FROM d3)"""
_deriv = "(VALUES " + ", ".join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]}, {v[4]})" for k, v in Q.LEVELS.items()) + ") l(kind, w2, w1, w0, wd, k)"


@query(
    f"""{DERIVED_SQL}, x AS (SELECT s.query_id, s.level, s.entry_id, k, round(sim * CASE s.level WHEN 2 THEN w2 WHEN 1 THEN w1 ELSE w0 END + coalesce(list_inner_product(q.q, v1) * {multiscale.DERIVATIVE} + list_inner_product(q.q, v2) * {multiscale.DERIVATIVE * 0.6}, 0) * wd, 6) AS score
  FROM s JOIN q USING (query_id) LEFT JOIN dd USING (entry_id) JOIN {_deriv} ON l.kind = s.kind)
SELECT query_id, level, entry_id, score, CAST(row_number() OVER (PARTITION BY query_id, level ORDER BY score DESC, entry_id) AS INT) AS rank FROM x QUALIFY rank <= k"""
)
def multiscale_derivatives(spark, d):
    return multiscale.by_level(entries(spark, d), level_queries(spark, d), multiscale.derivatives(entries(spark, d))).withColumn("rank", F.col("rank").cast("int"))


def _metadata(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("domain"), (F.lit(2000) + F.col("doc_id") % 30).cast("int").alias("year"), F.array("lang", F.concat(F.lit("m"), F.col("doc_id") % 7)).alias("mesh_terms"), F.col("lang").alias("journal"))


@query("SELECT doc_id, source AS domain, CAST(2000 + doc_id % 30 AS INT) AS year FROM documents WHERE source IN ('src1', 'src2', 'src3') AND 2000 + doc_id % 30 BETWEEN 2005 AND 2020 AND (lang IN ('fr', 'm3') OR doc_id % 7 = 3)")
def metadata_filter(spark, d):
    return multiscale.metadata_filter(_metadata(spark, d), ["src1", "src2", "src3"], None, 2005, 2020, ["fr", "m3"]).select("doc_id", "domain", "year")


@query("SELECT doc_id, round(CASE WHEN source IN ('src1', 'src4') THEN 0.05 ELSE 0 END + 0.02 * (CAST(lang = 'fr' AS INT) + CAST(doc_id % 7 = 3 AS INT)) + 0.1 * least(greatest((doc_id % 30) / 26, 0), 1), 6) AS boost FROM documents")
def metadata_boost(spark, d):
    return _metadata(spark, d).select("doc_id", F.round(multiscale.metadata_boost(["src1", "src4"], 0.05, ["fr", "m3"], 0.02, 0.1), 6).alias("boost"))


@query(
    f"""WITH RECURSIVE {EVIDENCE_SQL.removeprefix('WITH ')}, c AS (SELECT query_id, doc_id, score, source, min(score) OVER w AS low, max(score) OVER w AS high, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS nth FROM ev JOIN documents USING (doc_id) WINDOW w AS (PARTITION BY query_id)),
pick AS (SELECT query_id, 0 AS step, CAST([] AS BIGINT[]) AS got, CAST([] AS VARCHAR[]) AS domains, CAST(NULL AS BIGINT) AS doc_id FROM c WHERE nth = 1
  UNION ALL SELECT p.query_id, p.step + 1, list_append(p.got, b.doc_id), list_append(p.domains, coalesce(b.source, '')), b.doc_id FROM pick p, LATERAL (SELECT c.doc_id, c.source FROM c WHERE c.query_id = p.query_id AND NOT list_contains(p.got, c.doc_id)
    ORDER BY 0.6 * (c.score - c.low) / CASE WHEN c.high > c.low THEN c.high - c.low ELSE 1 END + 0.4 * CASE WHEN coalesce(c.source, '') <> '' AND NOT list_contains(p.domains, c.source) THEN 1 ELSE 0 END DESC, c.nth LIMIT 1) b WHERE p.step < 5)
SELECT pick.query_id, pick.doc_id, c.score, CAST(step AS INT) AS rank FROM pick JOIN c ON c.query_id = pick.query_id AND c.doc_id = pick.doc_id WHERE step > 0"""
)
def diversified(spark, d):
    rows = lexical.of_documents(evidence(spark, d), documents(spark, d).withColumn("domain", F.col("source")), "domain")
    return ranked(multiscale.diversify(rows, 5, 0.4))


# --- Corpus statistics and tuning


@query(
    f"""WITH s AS (SELECT doc_id, {PLAIN.format('text')} AS t FROM documents), f AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM s) GROUP BY term)
SELECT round(avg(len(t)), 6) AS avg_length, round(stddev_samp(len(t)), 6) AS length_deviation, count(*) AS corpus_size, round((SELECT avg(CAST(df > 0.1 * (SELECT count(*) FROM s) AS INT)) FROM f), 6) AS common_share,
round((SELECT count(*) FROM f) / sum(len(t)), 6) AS richness, round(avg(CAST(len(t) < 200 AS INT)), 6) AS short_share FROM s"""
)
def corpus_signals(spark, d):
    return tuning.corpus_signals(indexed(spark, d))


@query()
def embedding_quality(spark, d):
    return tuning.embedding_quality(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")))


def pseudo(spark, d):
    return tuning.pseudo_queries(indexed(spark, d), F.col("doc_id") % 5 == 0)


PSEUDO_SQL = f"""p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM (SELECT doc_id, {PLAIN.format('text')} AS t, len({PLAIN.format('text')}) AS dl FROM documents)) GROUP BY ALL),
tr AS (SELECT term, count(*) AS df FROM p WHERE doc_id % 5 <> 0 GROUP BY term),
sc AS (SELECT doc_id, term, round(tf / dl * ln((SELECT count(*) FROM documents WHERE doc_id % 5 <> 0) / (1 + coalesce(df, 0))), 6) AS s FROM p LEFT JOIN tr USING (term) WHERE doc_id % 5 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, term) AS nth FROM sc QUALIFY nth <= 5),
pq AS (SELECT doc_id AS query_id, string_agg(term, ' ' ORDER BY nth) AS query FROM top GROUP BY doc_id ORDER BY doc_id LIMIT 20)"""


@query(f"WITH {PSEUDO_SQL} SELECT query_id, query, query_id AS doc_id FROM pq")
def pseudo_queries(spark, d):
    return pseudo(spark, d)


def thirds(text):
    """Runs of three letters, which stand for a dense search here."""
    return T.found(F.lower(text), "[a-z]{3}")


_grid = "(SELECT CAST((w - 1) * 9 + (e - 1) * 3 + k - 1 AS INT) AS point, (w + 2) / 10 AS dense_weight, CAST([50, 100, 150][e] AS INT) AS depth, [30.0, 60.0, 90.0][k]::DOUBLE AS rrf_k FROM range(1, 7) a(w), range(1, 4) b(e), range(1, 4) c(k))"


@query(
    f"""WITH {PSEUDO_SQL}, {bm25_sql('sp', 150, PLAIN, 'SELECT query_id, query FROM pq')}, {bm25_sql('de', 150, "regexp_extract_all(lower({}), '[a-z]{{3}}')", 'SELECT query_id, query FROM pq')},
every AS (SELECT *, 'sparse' AS source FROM sp UNION ALL SELECT *, 'dense' FROM de),
fu AS (SELECT point, query_id, doc_id, round(sum(CASE WHEN source = 'dense' THEN dense_weight ELSE 1 - dense_weight END / (rrf_k + rank)), 6) AS score FROM every JOIN {_grid} g ON rank <= depth GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY point, query_id ORDER BY score DESC, doc_id) AS r FROM fu)
SELECT g.point, g.dense_weight, g.depth, g.rrf_k, round(coalesce(sum(1 / r) / (SELECT count(*) FROM pq), 0), 6) AS mrr FROM {_grid} g LEFT JOIN rk ON g.point = rk.point AND rk.query_id = rk.doc_id GROUP BY ALL"""
)
def calibration_grid(spark, d):
    docs, asked_ = indexed(spark, d, T.plain_tokens, thirds), stage.staged(pseudo(spark, d))
    lists = {"sparse": lexical.bm25(docs, asked_, 150, tokens=T.plain_tokens), "dense": lexical.bm25(docs, asked_, 150, tokens=thirds)}
    return tuning.calibration_grid(lists, asked_)


_base = "SELECT event_type AS task, 'c' || (user_id % 3) AS config, 'mean' AS metric, round(avg(value), 6) AS value FROM events WHERE event_id % 2 = {} GROUP BY ALL"


def measured(spark, d, half: int):
    rows = table(spark, d, "events").where(F.col("event_id") % 2 == half)
    return rows.groupBy(F.col("event_type").alias("task"), F.concat(F.lit("c"), F.col("user_id") % 3).alias("config"), F.lit("mean").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


@query(
    f"""SELECT b.task, b.config, b.metric, b.value AS baseline, c.value, round(c.value - b.value, 6) AS delta, CASE WHEN round(c.value - b.value, 6) < -0.005 THEN 'regression' WHEN round(c.value - b.value, 6) > 0.005 THEN 'improvement' ELSE 'unchanged' END AS status
FROM ({_base.format(0)}) b JOIN ({_base.format(1)}) c ON b.task = c.task AND b.config = c.config AND b.metric = c.metric"""
)
def regression_check(spark, d):
    return tuning.regression_check(measured(spark, d, 0), measured(spark, d, 1))


@query(f"SELECT task, config, metric, max(value) AS value FROM (({_base.format(0)}) UNION ALL ({_base.format(1)})) GROUP BY ALL")
def baseline_update(spark, d):
    return tuning.update_baselines(measured(spark, d, 0), measured(spark, d, 1))


_rewards = "SELECT event_type AS arm, least(greatest(value / 100, 0), 1) AS reward FROM events"


def rewards(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("arm"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("reward"))


STATS_SQL = f"SELECT arm, count(*) AS pulls, round(sum(reward), 6) AS total, round(round(sum(reward), 6) / count(*), 6) AS mean FROM ({_rewards}) GROUP BY arm"


@query(STATS_SQL)
def arm_stats(spark, d):
    return tuning.arm_stats(rewards(spark, d))


@query(f"WITH s AS ({STATS_SQL}) SELECT arm, round(mean + 2 * sqrt(ln((SELECT sum(pulls) FROM s)) / pulls), 6) AS ucb FROM s ORDER BY ucb DESC, arm LIMIT 1")
def ucb_select(spark, d):
    from pyspark.sql import Window

    return tuning.ucb_select(tuning.arm_stats(rewards(spark, d)).withColumn("ordinal", F.row_number().over(Window.orderBy("arm"))))


@query(f"WITH r AS ({_rewards}), m AS (SELECT round(avg(reward) FILTER (WHERE arm = 'click'), 6) AS mean_a, round(avg(reward) FILTER (WHERE arm = 'view'), 6) AS mean_b FROM r) SELECT *, CASE WHEN mean_a >= mean_b THEN 'click' ELSE 'view' END AS winner, round(CASE WHEN least(mean_a, mean_b) > 0 THEN (greatest(mean_a, mean_b) - least(mean_a, mean_b)) / least(mean_a, mean_b) ELSE 0 END, 6) AS lift FROM m")
def ab_test(spark, d):
    return tuning.ab_test(rewards(spark, d), "click", "view")


@query("SELECT event_id, round(least(greatest(least(greatest(value / 100, 0), 1) * 0.5 + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END * 0.3 + least((user_id % 5) / 3.0, 1) * 0.2, 0), 1), 6) AS reward FROM events")
def reward(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", tuning.reward(F.col("value") / 100, F.col("event_type") == "click", F.col("user_id") % 5).alias("reward"))


_obs = "SELECT event_type AS technique, event_id AS seq, least(greatest(value / 100, 0), 1) AS value FROM events"


def observations(spark, d):
    return rewards_with_seq(table(spark, d, "events"))


def rewards_with_seq(events):
    return events.select(F.col("event_type").alias("technique"), F.col("event_id").alias("seq"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("value"))


@query(
    f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY seq DESC) - 1 AS back, count(*) OVER (PARTITION BY technique) AS n FROM ({_obs}))
SELECT technique, round(sum(value * CASE WHEN back = n - 1 THEN pow(0.7, back) ELSE 0.3 * pow(0.7, back) END), 6) AS fitness, count(*) AS observations FROM o GROUP BY technique"""
)
def ema_fitness(spark, d):
    return tuning.ema(observations(spark, d))


@query(
    f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY seq) AS i FROM ({_obs})),
s AS (SELECT technique, 0::BIGINT AS i, 'embryonic' AS state, 0.0::DOUBLE AS fitness, 0 AS low FROM o WHERE i = 1
  UNION ALL SELECT technique, i, CASE WHEN state = 'embryonic' AND i >= 10 THEN 'active' WHEN state = 'active' AND f > 0.7 THEN 'preferred' WHEN state = 'preferred' AND f < 0.4 THEN 'declining' WHEN state = 'declining' AND f < 0.2 AND l >= 5 THEN 'disabled' ELSE state END, f, l
  FROM (SELECT s.technique, o.i, s.state, CASE WHEN s.i = 0 THEN value ELSE 0.3 * value + 0.7 * fitness END AS f, CASE WHEN s.state = 'declining' AND 0.3 * value + 0.7 * fitness < 0.2 THEN low + 1 WHEN s.state = 'declining' THEN 0 ELSE low END AS l FROM s JOIN o ON o.technique = s.technique AND o.i = s.i + 1))
SELECT technique, arg_max(state, i) AS state, round(arg_max(fitness, i), 6) AS fitness, max(i) AS observations FROM s GROUP BY technique"""
)
def lifecycle(spark, d):
    return tuning.lifecycle(observations(spark, d))


@query()
def answered(spark, d):
    """Template answers with confidence, grounding and citations for every question."""
    from .plans import planner

    found = planner.answer(documents(spark, d), asked(spark, d))
    return found.withColumn("citations", F.size("citations"))


@query()
def hybrid_plan(spark, d):
    """All steps of the hybrid strategy over every question."""
    from .plans import planner

    done = planner.run(planner.Context(documents(spark, d), asked(spark, d), 10, planner.STRATEGIES["hybrid"]))
    return done.evidence.select("query_id", "doc_id", "score", F.col("rank").cast("int").alias("rank"))
