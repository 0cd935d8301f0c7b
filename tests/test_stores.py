"""Stores, plug-ins and plans beside what the queries with SQL hold: failures, edges and round trips."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import sensitive
from lodestar.functions import text as T
from lodestar.functions import vectors as V
from lodestar.operators import answers, dense, forward, graph, lexical, multiscale, training, tuning
from lodestar.plans import planner
from lodestar.sources import connectors, files, stage, store, tables
from lodestar.streaming import state


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "Triage sorts patients by need.", "a.md", "Triage"), (2, "Billing codes, and triage of bills.", "b.md", "Billing"), (3, None, "c.md", None), (4, "", "d.md", "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, title string")


def test_index_is_built_once(spark, docs, monkeypatch):
    """Searches of one index cut each text once a tokenizer, and give what they give without it."""
    asked = spark.createDataFrame([(1, "triage bills"), (2, "patients"), (3, "")], "query_id long, query string")
    index = lexical.Index(docs)
    built = []
    monkeypatch.setattr(lexical, "staged", lambda df, *by: built.append(by) or stage.staged(df, *by))
    key = lambda r: (r["query_id"], r["rank"])
    found = [sorted(map(tuple, f(index, asked).collect())) for f in (lexical.bm25, lexical.bm25, lexical.tfidf, lexical.tfidf)]
    assert len([b for b in built if b == ("kind",)]) == 2 and found[0] == found[1] and found[2] == found[3]
    assert found[0] == sorted(map(tuple, lexical.bm25(docs, asked).collect())) and found[2] == sorted(map(tuple, lexical.tfidf(docs, asked).collect()))
    assert lexical.lengths(index).first()["n"] == 4 and lexical.lengths(docs).first()["n"] == 4 and key
    none = docs.limit(0)
    assert lexical.bm25(none, asked).count() == 0 and lexical.lengths(lexical.Index(none)).first()["n"] == 0


@pytest.mark.parametrize("share", [0.0, 0.1, 0.5, 1.0])
def test_common_terms_are_bounded(spark, share):
    """The best k are those of all scores, whichever terms count as common: closed queries, open ones, and ones of common terms only."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    rows = [(i, " ".join(rng.choice(words, 12, p=odds / odds.sum()))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 4))) for q in range(20)] + [(90, "w0 w1"), (91, "w0 w59 w58"), (92, "none")], "query_id long, query string")
    index = lexical.Index(docs)
    want = lexical.top_k(lexical.bm25_scores(index, asked), 5)
    assert sorted(map(tuple, lexical.bm25(index, asked, 5, share=share).collect())) == sorted(map(tuple, want.collect()))


def test_aliases_by_profile_as_brute_force(spark):
    """The first documents of each profile stand for the rest of it: the same top k as all pairs give."""
    rng = np.random.default_rng(5)
    words = "alpha beta gamma delta".split()
    rows = [(i, " ".join(rng.choice(words, 3)) if i % 3 else "nothing here", {"lang": str(rng.choice(["en", "fr"])), "kind": str(rng.choice(["x", "y"]))}, f"d{i % 2}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, metadata map<string,string>, domain string")
    asked = spark.createDataFrame([(0, "alpha speaks"), (1, "speaks typed"), (2, "beta")], "query_id long, query string")
    pairs = [("speaks", "lang:en"), ("typed", "kind:x"), ("typed", "kind")]
    got = lexical.tfidf(docs, asked, 7, spark.createDataFrame(pairs, "term string, target string")).collect()
    plain = {(r["query_id"], r["doc_id"]): r["score"] for r in lexical.tfidf(docs, asked, 1_000).collect()}
    for q, text in ((0, "alpha speaks"), (1, "speaks typed"), (2, "beta")):
        used = {t for t in text.split() if any(t == a for a, _ in pairs)}
        share = lambda m: sum(any(a == t and (b in m or b in {f"{k}:{v}" for k, v in m.items()}) for a, b in pairs) for t in used) / len(used) if used else 0
        want = sorted(((-round(plain.get((q, i), 0) + share(m), 6), i) for i, _, m, _ in rows))
        want = [(i, -s) for s, i in want if s < 0][:7]
        assert [i for i, _ in want] == [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]


def test_edges_of_seeds(spark):
    """Edges from seeds are those of all families that start there; a language that all share makes none."""
    methods, families, links = (tables.seed_graph(spark)[n] for n in tables.GRAPH)
    more = spark.createDataFrame([(f"g{i}", f"thing{i}", "", "approved", f"cat{i % 2}", "python", [], []) for i in range(6)], tables.GRAPH["families"])
    every = families.unionByName(more)
    key = lambda r: (r["a"], r["b"])
    whole = sorted(graph.family_edges(methods, every, links).collect(), key=key)
    some = sorted(graph.family_edges(methods, every, links, every.where("family_id = 'g0'")).collect(), key=key)
    assert some == [r for r in whole if r["a"] == "g0"] and {r["b"] for r in some} == {"g2", "g4"}
    # Category 0.58, language 0.05, and a token in two of each: 0.65 at most.
    assert all(r["reasons"][:2] == ["shared_category", "shared_language"] and r["weight"] == 1.0 for r in some)


def test_chunked_histories(spark):
    """Means and lifecycles over many ranges are those of one pass, with ranges of a few rows."""
    rng = np.random.default_rng(6)
    rows = [(t, int(s), float(v)) for t in ("a", "b") for s, v in enumerate(np.concatenate((rng.uniform(0.75, 1, 40), rng.uniform(0, 0.1, 40), rng.uniform(0, 1, 21))))] + [("c", 0, 0.5)]
    df = spark.createDataFrame(rows, "technique string, seq long, value double")
    means = {r["technique"]: r["fitness"] for r in tuning.ema(df).collect()}
    ends = {r["technique"]: (r["state"], r["fitness"], r["observations"]) for r in tuning.lifecycle(df).collect()}
    for t in "abc":
        now = ("embryonic", 0.0, 0, 0)
        for _, _, v in sorted(r for r in rows if r[0] == t):
            now = state.advance(now, v)
        assert means[t] == pytest.approx(now[1], abs=1e-6) and ends[t] == (now[0], pytest.approx(now[1], abs=1e-6), now[2])
    assert ends["a"][0] == "disabled"
    gaps = spark.createDataFrame([(i * i, float(i)) for i in range(50)], "k long, v double")
    got = {r["k"]: r["following"] for r in V.with_following(gaps, "k", "v").collect()}
    assert got == {i * i: float(min(i + 1, 49)) for i in range(50)}


def test_blocks_of_queries(spark, monkeypatch):
    """Several blocks, ties, zero vectors, and vectors of other lengths."""
    monkeypatch.setattr(dense, "BLOCK_BYTES", 64)
    monkeypatch.setattr(dense, "CELLS", 8)
    rng = np.random.default_rng(7)
    x = rng.integers(-2, 3, (40, 4)).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "doc_id long, vec array<double>")
    got = dense.exact_search(vectors, vectors.where("doc_id < 9").withColumnRenamed("doc_id", "query_id"), 5).collect()
    for q in range(9):
        n = np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])
        s = np.round(np.divide(x @ x[q], n, out=np.zeros(40), where=n > 0), 6)
        want = [i for i in np.lexsort((np.arange(40), -s)) if s[i] > 0][:5]
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    with pytest.raises(Exception, match="differ in length"):
        dense.exact_search(vectors, spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")).collect()
    assert dense.exact_search(vectors, vectors.limit(0).withColumnRenamed("doc_id", "query_id")).count() == 0
    assert multiscale.similarities(spark.createDataFrame([], "entry_id long, level int, parent long, vec array<double>"), spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vec array<double>")).count() == 0


def test_stores_replace_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "s")
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    store.write_tables(spark, path, {"t": one}, dim=3)
    held, facts = store.read_tables(spark, path)
    store.write_tables(spark, path, {"t": one.unionByName(held["t"])})
    assert store.read_tables(spark, path)[0]["t"].count() == 2 and facts == {"dim": 3} and held["t"].count() == 1
    tables.write_index(spark.createDataFrame([("a", 2, None, [1.0])], "entry_id string, level int, parent string, vec array<double>"), spark.createDataFrame([], "entry_id string, d1 array<double>, d2 array<double>"), f"{path}/i", 1)
    with pytest.raises(ValueError):
        tables.read_index(spark, f"{path}/i", 2)
    with pytest.raises(ValueError):
        tables.write_index(one, one, f"{path}/j", 1, other=one)
    assert {n: t.count() for n, t in tables.seed_graph(spark).items()} == {"methods": 3, "families": 3, "memberships": 3}
    tables.write_graph_store(tables.seed_graph(spark), f"{path}/g")
    assert tables.read_graph_store(spark, f"{path}/g")["families"].count() == 3
    tables.write_summary(one, f"{path}/summary.json", task="t")
    assert store.read_json(spark, f"{path}/summary.json") == {"task": "t", "rows": [{"id": 1, "name": "a"}]}


def test_arms_and_calibration_are_kept(spark, tmp_path, docs):
    path = str(tmp_path / "arms.json")
    arms = tables.with_arm(tables.read_arms(spark, path), "mine", ["rrf_fusion"])
    arms = tables.rewarded(arms, spark.createDataFrame([("mine", 0.5), ("mine", 1.0), ("unknown", 1.0)], "arm string, reward double"))
    tables.write_arms(arms, path)
    got = {r["arm"]: (r["pulls"], r["total"]) for r in tables.read_arms(spark, path).collect()}
    assert got["mine"] == (2, 1.5) and set(got) == {"mine", *tables.FIRST_ARMS} and got["search"] == (0, 0.0)
    first = tuning.calibrated(docs, str(tmp_path / "c")).collect()
    assert tuning.calibrated(docs, str(tmp_path / "c")).collect() == first and len(list((tmp_path / "c").iterdir())) == 1
    assert tuning.search_weights() == (0.6, 0.4) and tuning.search_weights(calibration=0.7) == (0.7, pytest.approx(0.3)) and tuning.search_weights(0.9, 0.2, 0.7) == (0.9, 0.2)
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0])], "doc_id long, vec array<double>")
    assert tuning.mean_cosine(vecs).first()["mean_cosine"] == pytest.approx(2 * 2 * 0.5**0.5 / 6, abs=1e-6)


def test_http_plug_ins(spark, monkeypatch):
    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in body:
                data = [{"index": i, "embedding": [float(len(t))]} for i, t in enumerate(body["input"])]
                reply = {"data": data[::-1]}
            else:
                reply = {"choices": [{"message": {"content": f"{self.headers.get('Authorization')} {body['messages'][-1]['content']}"}}]}
            raw = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = spark.createDataFrame([("a",), ("bcd",), (None,)], "text string").coalesce(1)
    got = {r["text"]: r["vec"] for r in dense.embedded(rows, connectors.http_embeddings(url, "m", 2, batch=1), 2).collect()}
    assert got == {"a": [1.0, 0.0], "bcd": [3.0, 0.0], None: [0.0, 0.0]}
    with pytest.raises(connectors.MissingKey):
        connectors.http_chat(url, "m", "NO_SUCH_VARIABLE")()("", "x")
    monkeypatch.setenv("LODESTAR_TEST_KEY", "k")
    assert connectors.http_chat(url, "m", "LODESTAR_TEST_KEY")()("s", "hello") == "Bearer k hello"
    server.shutdown()
    assert connectors.chat_text({"message": {"content": "b"}}) == "b" and connectors.chat_text({"response": "c"}) == "c"
    with pytest.raises(ValueError):
        connectors.chat_text({})
    monkeypatch.setitem(connectors.MODELS, "zero", lambda rest: lambda: lambda texts: [[0.0] * int(rest)] * len(texts))
    assert connectors.embedding_model("zero:2")()(["x"]) == [[0.0, 0.0]]
    with pytest.raises(ValueError):
        connectors.embedding_model("other:x")


def test_entities_are_mended():
    text = "Ann met Bob. Ann left."
    found = sensitive._entities(text, 'sure: [{"value": "Ann", "type": "person", "start": 15}, {"value": "Bob", "type": "x"}, {"value": "Eve", "start": 0}, {"value": ""}, 3] done')
    assert [(e["start"], e["end"], e["type"], e["pattern"]) for e in found] == [(0, 3, "pii", "model_person"), (8, 11, "phi", "model_x")]
    assert sensitive._entities(text, "none") == [] and sensitive._entities(text, "[oops]") == []


def test_generator_and_evaluation_of_a_folder(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "triage.md").write_text("# Triage\n\nTriage sorts patients by need.")
    (tmp_path / "docs" / "billing.txt").write_text("Billing sends invoices.")
    golden = tmp_path / "golden.jsonl"
    golden.write_text('{"question": "triage patients", "expected_sources": ["triage.md"], "must_include": ["need"]}\n{"question": "zebra", "no_evidence": true}\n')
    each, summary = planner.evaluate_folder(spark, str(tmp_path / "docs"), str(golden))
    got = {r["id"]: r for r in each.collect()}
    assert got["q1"]["recall_at_k"] == 1 and got["q1"]["expected_term_match"] == 1 and got["q2"]["no_evidence_behavior"] == 1 and summary.first()["questions"] == 2
    docs = files.read_folder(spark, str(tmp_path / "docs"))
    asked = spark.createDataFrame([(1, "triage"), (2, "invoices")], "query_id long, query string")

    def write(system, prompt):
        if "invoices" in prompt.partition("Question:")[2]:
            raise RuntimeError
        return "said: " + prompt.partition("\n")[0]

    done = {r["query_id"]: r["answer"] for r in planner.answer(docs, asked, generator=lambda prompts: answers.generated(prompts, lambda: write)).collect()}
    assert done[1] == "said: Evidence:" and done[2].startswith("Retrieved 1")


def test_export_and_train(spark, tmp_path):
    rows = spark.createDataFrame([("a", "b", "c")], "anchor string, positive string, negative string")
    training.export(rows, str(tmp_path / "e"), training.TrainingConfig(epochs=1))
    assert training.train(str(tmp_path / "e"), spark, lambda df, config: {"n": df.count(), "epochs": config.epochs}) == {"n": 1, "epochs": 1}


def test_links_and_case(spark, tmp_path):
    """Extensions in any case; links to files and folders, and what they lead to, are left out."""
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    (tmp_path / "in" / "A.MD").write_text("upper")
    (tmp_path / "out" / "b.md").write_text("outside")
    (tmp_path / "in" / "link").symlink_to(tmp_path / "out")
    (tmp_path / "in" / "c.md").symlink_to(tmp_path / "out" / "b.md")
    assert [(r["source"], r["format"]) for r in files.read_folder(spark, str(tmp_path / "in")).collect()] == [("A.MD", "md")]
    assert files.read_folder(spark, str(tmp_path / "out"), ("txt",)).count() == 0


def test_scores_without_words(spark):
    """Counts over whole texts: nulls, blanks, punctuation and long words."""
    rows = spark.createDataFrame([(0, None), (1, ""), (2, " \n "), (3, "!!! ..."), (4, "Incomprehensibilities (really)! [1] v2x"), (5, "First-Principles NOVEL must_never")], "id int, text string")
    score = T.complexity(T.complexity_parts(F.col("text")))
    got = {r["id"]: r for r in rows.select("id", score.alias("s"), *(v.alias(k) for k, v in T.panel_votes(F.col("text")).items())).collect()}
    assert [got[i]["s"] for i in range(3)] == [0.0] * 3 and got[4]["s"] == pytest.approx(0.10 * 1 / 9 + 0.15 + 0.20 + 0.10 + 0.20)
    assert got[5]["novelty"] == 0.2 and got[5]["accuracy_criticality"] == 0.4 and got[1]["usability"] == 0.0


def test_best_of_tasks_as_brute_force(spark, monkeypatch):
    """Searches that score documents where they are read move no pair of query and document, and find what all pairs give: over several tasks, pieces and blocks of queries, with rare terms of unknown weight, ties and struct ids."""
    rng = np.random.default_rng(3)
    odds = 1 / np.arange(1, 401)
    texts = [" ".join(f"w{i}" for i in rng.choice(400, int(rng.integers(1, 30)), p=odds / odds.sum())) + f" own{n % 50}" for n in range(300)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts + texts[:40])], "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(q, q % 2, " ".join(f"w{i}" for i in rng.integers(0, 400, 6)) + " w0 own1") for q in range(12)], "q int, part int, query string")
    asked = asked.select(F.struct("q", "part").alias("query_id"), "query")
    monkeypatch.setattr(lexical, "RARE", 20)
    monkeypatch.setattr(forward, "BLOCK_TERMS", 20)
    index = lexical.Index(docs)
    flat = lambda rows: sorted((*r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in rows)
    assert flat(lexical.bm25(index, asked, 7).collect()) == flat(lexical.top_k(lexical.bm25_scores(index, asked), 7).collect())
    n, cut = len(texts) + 40, [t.split() for t in texts + texts[:40]]
    df = Counter(w for t in cut for w in set(t))
    weigh = lambda t: {w: c / len(t) * np.log((n + 1) / (df[w] + 0.5)) for w, c in Counter(t).items() if w in df}
    vectors = [weigh(t) for t in cut]
    size = lambda v: sum(x * x for x in v.values()) ** 0.5
    want = []
    for r in asked.collect():
        q = weigh(r["query"].split())
        scores = sorted((-round(sum(x * v.get(w, 0) for w, x in q.items()) / size(q) / size(v), 6), f"d{i}") for i, v in enumerate(vectors))
        want += [(*r["query_id"], i, -s, at + 1) for at, (s, i) in enumerate(scores[:7]) if s < 0]
    got = flat(lexical.tfidf(index, asked, 7).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)
    moved = lexical._cosines(index, lexical._asked(asked, T.long_tokens), 7, T.long_tokens).count()
    assert 12 * 7 <= moved < 12 * 60  # of the 340 documents that each query shares a term with


def test_postings_are_not_shuffled(spark):
    """An index is one pass over the documents, and its searches shuffle no postings."""
    docs = spark.createDataFrame([(i, f"alpha w{i} w{i % 7}") for i in range(50)], "doc_id long, text string")
    plan = forward.counted(docs, {0: T.plain_tokens})._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_levels_without_pairs_as_all_pairs(spark):
    """Documents of three ways of scoring are those of all pairs: documents without a vector of their own, several parts, ties, derivatives, boosts and text ids."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        v = np.round(rng.standard_normal(3), 1)
        if i % 7:
            rows.append((f"d{i}", 2, None, v.tolist()))
        rows += [(f"d{i}_{j}", int(rng.integers(0, 2)), f"d{i}", np.round(rng.standard_normal(3), 1).tolist()) for j in range(i % 5 or not i % 7)]
    rows += [("e1", 2, None, rows[0][3]), ("e0", 2, None, rows[0][3])]
    entries = spark.createDataFrame(rows, "entry_id string, level int, parent string, vec array<double>").repartition(3)
    derived = entries.where("level = 0").select("entry_id", "vec", F.array(*[F.lit(x) for x in (0.5, -0.5, 0.1)]).alias("d2")).withColumnRenamed("vec", "d1")
    kinds = ["specification", "synthesis", "summary", "logic"]
    asked = spark.createDataFrame([(q, rng.standard_normal(3).tolist(), kinds[q % 4]) for q in range(21)], "query_id int, vec array<double>, kind string")
    boosts = spark.createDataFrame([("d3", 0.5), ("d4", -0.2)], "doc_id string, boost double")
    pairs = multiscale.similarities(entries, asked, derived).toPandas()
    boost = {"d3": 0.5, "d4": -0.2}

    def want(of, boosted=False):
        out = {}
        for q, own in pairs.groupby("query_id"):
            scores = of(own)
            ranked = sorted((-round(s + (boost.get(d, 0) if boosted else 0), 6), d) for d, s in scores.items())[:4]
            out[q] = [(d, round(-s, 6)) for s, d in ranked]
        return out

    def reranked(own):
        of = lambda level, c: own[own["level"] == level].set_index("doc_id")[c].to_dict()
        docs, paras, sents, bonus = of(2, "sim"), of(1, "sim"), of(0, "sim"), of(0, "bonus")
        bar = np.mean(list(docs.values())) + 0.5 * np.std(list(docs.values()))
        part = lambda d: max(paras.get(d, 0), sents.get(d, 0))
        return {d: docs.get(d, part(d) * (0.7 if part(d) > bar else 0.4)) + 0.3 * paras.get(d, 0) + 0.2 * sents.get(d, 0) + 0.1 * bonus.get(d, 0) for d in set(own["doc_id"])}

    def fused(own):
        out = Counter()
        for _, level in own.groupby("level"):
            for r, (_, d) in enumerate(sorted((-round(s, 6), d) for d, s in zip(level["doc_id"], level["both"])), 1):
                out[d] += 1 / (60 + r)
        return out

    flat = lambda own: own[own["level"] == 2].set_index("doc_id")["sim"].to_dict()

    def got(df):
        out = {}
        for r in sorted(df.collect(), key=lambda r: r["rank"]):
            out.setdefault(r["query_id"], []).append((r["doc_id"], round(r["score"], 6)))
        return out

    assert got(multiscale.reranked(entries, asked, derived, 4)) == want(reranked)
    assert got(multiscale.fused_levels(entries, asked, derived, 4)) == want(fused)
    assert got(multiscale.reranked(entries, asked, derived, 4, boosts=boosts)) == want(reranked, True)
    assert got(multiscale.fused_levels(entries, asked, derived, 4, boosts=boosts)) == want(fused, True)
    mixed = [want(f) for f in (flat, fused, reranked, reranked)]
    found = multiscale.adaptive(entries, asked, derived, 4)
    assert got(found) == {q: mixed[q % 4][q] for q in range(21)}
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()  # pairs of query and document are in no table
    assert multiscale.reranked(entries.limit(0), asked).count() == 0 and multiscale.fused_levels(entries, asked.limit(0)).count() == 0


def test_corpus_of_odd_texts_as_sql(spark, tmp_path):
    """Null and empty texts come out of a benchmark corpus as its SQL has them."""
    import duckdb

    from lodestar import store_queries  # noqa: F401  registers its queries
    from lodestar.queries import ORACLES, QUERIES

    rows = [(i, t, "s", "en") for i, t in enumerate(["one", "", None, "", None, "x" * 70, None, "two", "", "\n", "\n", "\n"])]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["benchmark_corpus"](spark, str(tmp_path)).collect()), key=str) == sorted(con.sql(ORACLES["benchmark_corpus"]).fetchall(), key=str)
    titled = spark.createDataFrame([("a", "T", "x"), ("b", "", "x"), ("c", None, "x"), ("d", "T", None)], "id string, title string, text string")
    assert [r["text"] for r in files.read_corpus(titled).orderBy("doc_id").collect()] == ["T\nx", "x", "x", "T"]
