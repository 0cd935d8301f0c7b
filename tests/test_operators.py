"""Behaviour of single operators on small hand-made tables, against plain Python where it is short."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import questions as Q
from lodestar.functions import sensitive as S
from lodestar.functions import text as T
from lodestar.functions import vectors as V
from lodestar.operators import answers, chunking, dense, fusion, graph, lexical, multiscale, training, tuning, verify
from lodestar.plans import planner
from lodestar.sources import files, tables
from lodestar.streaming import state


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_tokenizers(spark):
    t = F.col("t")
    text = "BM25-style RAG_core v2.0!"
    assert one(spark, T.compound_tokens(t), t=text) == ["bm25-style", "rag_core", "v2", "0"]
    assert one(spark, T.plain_tokens(t), t=text) == ["bm25", "style", "rag", "core", "v2", "0"]
    assert one(spark, T.long_tokens(t), t="A bc, d-ef") == ["bc", "ef"]
    assert one(spark, T.graph_tokens(t), t="This uses token tokens ab token") == ["token", "tokens"]
    assert one(spark, T.expanding_tokens(t, {"bp": ["blood", "pressure"]}, ["the"]), t="the BP rose") == ["bp", "blood", "pressure", "rose"]


def test_careful_sentences(spark):
    text = "# Head one. Two\nDr. Smith came. He left (at 5). J. Doe stayed.\n\nNo end"
    assert one(spark, T.careful_sentences(F.col("t")), t=text) == ["# Head one. Two", "Dr. Smith came.", "He left (at 5).", "J. Doe stayed.", "No end"]


@pytest.mark.parametrize("line, expected", [("# x", True), ("Title Case", True), ("ends.", False), ("lower", False), ("", False), ("X" * 90, False), ("5 ways", True)])
def test_heading(spark, line, expected):
    assert one(spark, T.is_heading(F.col("t")), t=line) is expected


def test_packed_as_python(spark):
    rng = np.random.default_rng(0)
    text = " ".join("x" * int(n) + "." for n in rng.integers(1, 60, 80))

    def plain(text, most):
        out, now, size = [], [], 0
        for s in re.split(r"(?<=[!?.])\s+", text):
            if now and size + len(s) + 1 > most:
                out.append(" ".join(now))
                now, size = [s], len(s)
            else:
                now.append(s)
                size += len(s) + 1
        return out + [" ".join(now)]

    assert one(spark, chunking.packed(F.col("t"), 120), t=text) == plain(text, 120)
    assert one(spark, chunking.packed(F.col("t"), 900), t="short. text") == ["short. text"]


def test_chunk_strategies(spark):
    docs = spark.createDataFrame([(1, "Para one. Still one.\n\n  \n\nPara two.", "s"), (2, "", "s"), (3, None, "s")], "doc_id long, text string, source string")
    rows = chunking.chunk(docs, "paragraph").orderBy("position").collect()
    assert [r["text"] for r in rows] == ["Para one. Still one.", "Para two."] and rows[0]["complexity"] == "low"
    overlapped = chunking.paragraphs(docs, 900, 4).orderBy("position").collect()
    assert overlapped[1]["text"] == "one.Para two."
    with pytest.raises(ValueError):
        chunking.chunk(docs, "nothing")
    semantic = chunking.semantic_chunks(spark.createDataFrame([(1, "Heading\nfirst part one. Second part here. Third part now.\nNext Heading\nlast bit there.")], "doc_id long, text string"), 40)
    parts = [(r["heading"], r["text"]) for r in semantic.orderBy("position").collect()]
    assert parts[0][0] == "Heading" and parts[-1] == ("Next Heading", "Next Heading last bit there.")


def test_scales(spark):
    text = "This sentence is certainly long enough one. This sentence is certainly long enough two. Short. This sentence is certainly long enough three. This sentence is long enough to count four."
    rows = chunking.scales(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(r["level"] == 0 for r in rows) == 4 and sum(r["level"] == 1 for r in rows) == 2 and sum(r["level"] == 2 for r in rows) == 1


def test_bm25_edges(spark):
    docs = spark.createDataFrame([("a", "apple pie"), ("b", "apple apple"), ("c", None)], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "apple"), (2, "!!!"), (3, None)], "query_id int, query string")
    hits = lexical.bm25(docs, asked).orderBy("rank").collect()
    assert [(h["query_id"], h["doc_id"], h["rank"]) for h in hits] == [(1, "b", 1), (1, "a", 2)]
    assert lexical.bm25(docs.limit(0), asked).count() == 0
    with pytest.raises(ValueError):
        lexical.bm25(docs, asked, k1=0)


def test_rrf_order_and_weights(spark):
    make = lambda rows: spark.createDataFrame([(1, *r) for r in rows], "query_id int, doc_id string, score double, rank int")
    a, b = make([("a", 9.0, 1), ("b", 8.0, 2)]), make([("c", 7.0, 0), ("a", 6.0, 0)])
    fused = fusion.rrf({"one": a, "two": b}).orderBy("rank").collect()
    assert "".join(f["doc_id"] for f in fused) == "acb"
    assert fused[0]["source_ranks"] == {"one": 1, "two": 2}
    assert fusion.rrf({"one": a, "two": b}, weights={"one": 0.0}).orderBy("rank").first()["doc_id"] == "c"
    with pytest.raises(ValueError):
        fusion.rrf({"one": a}, rrf_k=0)


def test_normalise_bounds_and_ties(spark):
    rows = spark.createDataFrame([(1, "a", 3.0, 0), (1, "b", 1.0, 1), (2, "a", 5.0, 0), (2, "b", 5.0, 1), (3, "a", 9.0, 0)], "query_id int, doc_id string, score double, rank int")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in fusion.score_normalize(rows).collect()}
    assert got == {(1, "a"): 1.001, (1, "b"): 0.0005, (2, "a"): 1.0, (2, "b"): 0.5, (3, "a"): 9.0}


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0] * 2, [1.0] * 2)], "a array<double>, b array<double>")
    got = rows.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.normalised(F.col("a")).alias("n"), V.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert abs(got[0]["c"] - 0.96) < 1e-12 and got[1]["c"] == 0 and got[0]["n"] == [0.6, 0.8] and got[1]["n"] == [0.0, 0.0]


def test_hash_embedding_as_python(spark):
    h = lambda s, m: int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "big") % m
    v = np.zeros(16)
    for t in ["red", "red", "blue"]:
        v[h(t, 16)] += -1 if h(t + ":sign", 2) else 1
    got = dense.hash_embeddings(spark.createDataFrame([(1, "Red red blue"), (2, "")], "doc_id int, text string"), 16).orderBy("doc_id").collect()
    assert np.allclose(got[0]["vec"], v / np.linalg.norm(v)) and not any(got[1]["vec"])


def test_learned_sparse(spark):
    rows = spark.createDataFrame([("d1", "a b"), ("d2", "b")], "id string, text string")
    encode = lambda texts: [{ord(c): 1.0 for c in t.split()} for t in texts]
    got = dense.sparse_dot(dense.learned_sparse(rows, encode), dense.learned_sparse(rows.limit(1), encode)).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [("d1", 2.0), ("d2", 1.0)]


def test_sensitive(spark):
    text = "SSN 123-45-6789, MRN: 1234567, DOB 1/2/1990, Patient: John Smith, a@b.co 555-123-4567"
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    counts = docs.select(*(c.alias(n) for n, c in S.pattern_counts(F.col("text")).items())).collect()
    assert {k: v for k, v in counts[0].asDict().items() if v} == {"ssn": 1, "email": 1, "phone": 1, "mrn": 1, "dob": 1, "patient_name": 1}
    got = S.redact_spans(S.spans(docs)).orderBy("doc_id").collect()
    assert "123-45" not in got[0]["redacted"] and got[0]["redacted"].count("[REDACTED]") == 6 and got[1]["redacted"] is None


def test_questions(spark):
    kinds = {"compare a and b": "synthesis", "What is x": "specification", "show it": "logic", "tell me": "summary", "a? b?": "synthesis"}
    for q, kind in kinds.items():
        assert one(spark, Q.simple_type(F.col("q")), q=q) == kind
    with pytest.raises(ValueError):
        Q.valid("  ")
    with pytest.raises(ValueError):
        Q.valid("x" * 10_001)
    assert Q.valid(" a ") == "a"
    hints = one(spark, Q.domain_hints(F.col("q")), q="drug medication trial")
    assert hints["boost"] == 0.05 and hints["targets"] == ["ai_drug_discovery_pharma"]
    assert one(spark, Q.domain_hints(F.col("q")), q="nothing here") is None


@pytest.fixture
def methods(spark):
    m = spark.createDataFrame(
        [("m1", "parse command flags", "", "", "py", ["category:cli_ux"], "r1"), ("m2", "render terminal help", "", "", "py", ["category:cli_ux"], "r2"), ("m3", "load parquet frames", "", "", "go", ["category:data"], "r3")],
        tables.GRAPH["methods"],
    )
    f = spark.createDataFrame([(f"f{i}", f"fam{i}", f"b:{i}", "approved", c, "", [], []) for i, c in ((1, "cli_ux"), (2, "cli_ux"), (3, "data"))], tables.GRAPH["families"])
    links = spark.createDataFrame([(f"f{i}", f"m{i}", 0.9, "approved") for i in (1, 2, 3)], tables.GRAPH["memberships"])
    return m, f, links


def test_graph_neighbours(spark, methods):
    asked = spark.createDataFrame([(1, "command flags")], "query_id int, query string")
    got = {r["family_id"]: r["source"] for r in graph.search_families(*methods, asked).collect()}
    assert got == {"f1": "direct", "f2": "graph"}
    assert graph.search_families(*methods, asked, expand=False).count() == 1


def test_graph_store(spark, methods, tmp_path):
    tables.write_graph(dict(zip(tables.GRAPH, methods)), str(tmp_path / "g"))
    assert tables.read_graph(spark, str(tmp_path / "g"))["families"].count() == 3
    (tmp_path / "g.json").write_text(json.dumps({"methods": [{"method_id": "x", "problem": "p", "tags": ["t"]}], "families": [], "memberships": []}))
    assert tables.read_graph_json(spark, str(tmp_path / "g.json"))["methods"].first()["tags"] == ["t"]
    assert tables.upsert(methods[1], methods[1].limit(1), "family_id").count() == 3


def test_index_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    entries = spark.createDataFrame([(f"e{i}", [2, 1, 0][i % 3], None if i % 3 == 0 else f"e{i // 3 * 3}", rng.standard_normal(4).tolist()) for i in range(9)], "entry_id string, level int, parent string, vec array<double>")
    derived = multiscale.derivatives(entries)
    tables.write_index(entries, derived, str(tmp_path / "i"), 4)
    again, d = tables.read_index(spark, str(tmp_path / "i"), 4)
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "logic")], "query_id int, vec array<double>, kind string")
    key = lambda r: (r["level"], r["rank"])
    assert sorted(multiscale.by_level(again, asked, d).collect(), key=key) == sorted(multiscale.by_level(entries, asked, derived).collect(), key=key)
    with pytest.raises(ValueError):
        tables.read_index(spark, str(tmp_path / "i"), 8)


def test_derivatives_as_numpy(spark):
    unit = lambda v: np.asarray(v) / np.linalg.norm(v)
    d, p1, p2, s = (unit(v) for v in ([1.0, 0, 0], [0.6, 0.8, 0], [0, 1.0, 0.2], [0.5, 0.5, 0.7]))
    rows = [("d", 2, None, d), ("p1", 1, "d", p1), ("p2", 1, "d", p2), ("s", 0, "d", s)]
    entries = spark.createDataFrame([(a, b, c, v.tolist()) for a, b, c, v in rows], "entry_id string, level int, parent string, vec array<double>")
    w = np.array([max(0.1, p1 @ d), max(0.1, p2 @ d)])
    mean = (w[0] * p1 + w[1] * p2) / w.sum()
    d1 = unit(s - mean)
    got = multiscale.derivatives(entries).first()
    assert np.allclose(got["d1"], d1) and np.allclose(got["d2"], unit(d1 - (s - d)))


def test_diversify(spark):
    rows = spark.createDataFrame([(1, "a", 1.0, "x"), (1, "b", 0.9, "x"), (1, "c", 0.5, "y"), (1, "d", 0.1, None)], "query_id int, doc_id string, score double, domain string")
    assert [r["doc_id"] for r in multiscale.diversify(rows, 3, 0.5).orderBy("rank").collect()] == list("acb")


def test_evaluation(spark):
    golden = spark.createDataFrame([("q1", ["A.md"], ["Term one"], False), ("q2", [], [], True)], "id string, expected_sources array<string>, expected_terms array<string>, no_evidence boolean")
    results = spark.createDataFrame([("q1", "the TERM   one is", ["a.md", "b.md"], ["a.md", "z"]), ("q2", "No evidence found", [], [])], "id string, answer string, retrieved array<string>, cited array<string>")
    got = {r["id"]: r for r in verify.evaluate(golden, results).collect()}
    assert (got["q1"]["recall_at_k"], got["q1"]["citation_source_accuracy"], got["q1"]["expected_term_match"]) == (1.0, 0.5, 1.0)
    assert got["q2"]["overall"] == 1.0
    assert verify.summary(verify.evaluate(golden, results)).first()["questions"] == 2


def test_no_evidence_answers(spark):
    docs = spark.createDataFrame([(1, "alpha beta", "s", "t")], "doc_id long, text string, source string, title string")
    asked = spark.createDataFrame([(1, "alpha"), (2, "zeta"), (3, " ")], "query_id int, query string")
    got = {r["query_id"]: r for r in planner.answer(docs, asked).collect()}
    assert set(got) == {1, 2} or set(got) == {1, 2, 3}
    assert got[2]["confidence"] == 0 and got[2]["answer"].startswith("No cited evidence") and got[1]["confidence"] > 0


def test_prompts_and_judged_scores(spark):
    ev = spark.createDataFrame([(1, 0, "t", "x" * 30), (1, 1, "u", "y" * 30)], "query_id int, rank int, title string, text string")
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id int, query string")
    got = {r["query_id"]: r["prompt"] for r in answers.prompts(ev, asked, chars=40).collect()}
    assert "y" * 10 + "..." in got[1] and "(none)" in got[2]
    assert one(spark, answers.judged_scores(F.col("t")), t='Scores:\n{"1": 7, "2": 25} done') == {"1": 0.7, "2": 1.0}


def test_registry_and_router():
    r = planner.Registry()
    r.register(planner.Technique("a"))
    r.register(planner.Technique("b", ("a",), ("logic",)))
    r.register(planner.Technique("c", ("b",), (), 100))
    assert "".join(r.compose("logic", 200)) == "abc" and r.compose("summary", 200) == ["a"] and r.compose("logic", 5) == ["a", "b"]
    with pytest.raises(ValueError):
        r.register(planner.Technique("a"))
    with pytest.raises(ValueError):
        r.register(planner.Technique("d", ("zz",)))
    assert planner.choose("strong", corpus_size=10).name == "blended_rerank"
    assert planner.choose("weak", corpus_size=10).name == "hybrid" and planner.choose("weak", corpus_size=5000).name == "sparse_boost"
    assert planner.choose("strong", "dense_only").name == "dense_only" and planner.choose("?").name == "hybrid"
    with pytest.raises(KeyError):
        planner.choose("weak", "nothing")


def test_bandit_and_calibration(spark):
    stats = spark.createDataFrame([("a", 10, 5.0, 0.5, 1), ("b", 0, 0.0, 0.0, 2), ("c", 0, 0.0, 0.0, 3)], "arm string, pulls long, total double, mean double, ordinal int")
    assert tuning.ucb_select(stats).first()["arm"] == "b"
    docs = spark.createDataFrame([(i, f"word{i} topic{i % 3} common") for i in range(60)], "doc_id long, text string")
    first = tuning.calibrate(docs).first()
    assert (first["point"], first["mrr"]) == (0, 0.0)
    assert tuning.calibrate(docs, index_all=True).first()["mrr"] > 0.5
    assert tuning.calibrate(docs.limit(10)).first()["dense_weight"] == 0.6


def test_lifecycle_batch_is_stream(spark, tmp_path):
    values = [0.9] * 12 + [0.0] * 15
    rows = [("t", i, v) for i, v in enumerate(values)] + [("u", i, 0.5) for i in range(4)]
    schema = "technique string, seq long, value double"
    batch = {r["technique"]: (r["state"], r["fitness"]) for r in tuning.lifecycle(spark.createDataFrame(rows, schema)).collect()}
    assert batch["t"][0] == "disabled" and batch["u"][0] == "embryonic"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = state.lifecycle_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("life").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["technique"]: (r["state"], round(r["fitness"], 6)) for r in spark.table("life").collect()} == batch


def test_triplets(spark):
    chunks = spark.createDataFrame([(1, 10, 0, "alpha beta gamma delta epsilon", "T", ""), (2, 10, 1, "alpha beta zeta eta theta", "T", ""), (3, 20, 0, "alpha iota kappa lambda mu", "", "")], "chunk_id long, doc_id long, position int, text string, title string, heading string")
    assert training.title_pairs(chunks).count() == 2
    pairs = training.adjacent_pairs(chunks)
    got = training.triplets(pairs.withColumn("pair_id", F.lit(1)), chunks).collect()
    assert [t["negative"] for t in got] == ["alpha iota kappa lambda mu"]


def test_read_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Title here\n\nBody.")
    (tmp_path / "sub" / "b.txt").write_text("plain")
    (tmp_path / "c.jsonl").write_text('{"title": "J", "content": "from json"}\nnot json\n{"x": 1}\n{"text": "second"}\n')
    (tmp_path / "d.json").write_text('[{"body": "in array"}]')
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "blank.txt").write_text("  ")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.md")
    got = {r["source"]: (r["title"], r["text"]) for r in files.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("Title here", "# Title here\n\nBody."), "sub/b.txt": ("b", "plain"), "c.jsonl#0": ("J", "from json"), "c.jsonl#2": ("c", "second"), "d.json#0": ("d", "in array")}
    with pytest.raises(ValueError):
        files.read_folder(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.read_folder(spark, str(tmp_path / "a.md"))


def test_golden_rules_baselines(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"question": "a", "must_include": ["x"]}\n{"id": "k", "question": "b", "should_answer": false}\n')
    got = tables.read_golden(spark, str(tmp_path / "g.jsonl")).collect()
    assert [(r["id"], r["expected_terms"], r["no_evidence"]) for r in got] == [("q1", ["x"], False), ("k", [], True)]
    (tmp_path / "r.json").write_text(json.dumps({"aliases": dict(bug=["type:bug"]), "routing": [{"domain": "d", "keywords": ["k"], "boost": 2}]}))
    aliases, rules = tables.read_rules(spark, str(tmp_path / "r.json"))
    assert aliases.first()["target"] == "type:bug" and rules.first()["boost"] == 2.0
    base = spark.createDataFrame([("t", "c", "m", 0.5, "")], tables.BASELINES)
    tables.write_baselines(base, str(tmp_path / "b.json"))
    assert tables.read_baselines(spark, str(tmp_path / "b.json")).first()["value"] == 0.5


def test_plug_in_embeddings_and_levels(spark):
    def load():
        def model(texts):
            if len(texts) > 1 and any("bad" in t for t in texts):
                raise ValueError
            if "bad" in texts[0]:
                raise ValueError
            return [[float(len(t)), 1.0] for t in texts]

        return model

    rows = spark.createDataFrame([("a", "xx"), ("b", "bad"), ("c", None), ("d", "xx")], "doc_id string, text string").coalesce(1)
    got = {r["doc_id"]: r["vec"] for r in dense.embedded(rows, load, 2).collect()}
    assert got == {"a": [2.0, 1.0], "b": [0.0, 0.0], "c": [0.0, 0.0], "d": [2.0, 1.0]}
    docs = spark.createDataFrame([("a", "One sentence that is long enough. Another sentence that is long too.", "T")], "doc_id string, text string, title string")
    entries, derived = multiscale.build(docs, lambda rows: multiscale.gaussian_embeddings(rows, 8))
    assert {r["entry_id"] for r in entries.collect()} == {"a", "a_p0", "a_s0", "a_s1"} and derived.count() == 2
    adapters = spark.createDataFrame([("a", [1.0] + [0.0] * 7)], "doc_id string, adapter array<double>")
    moved = {r["entry_id"]: r["vec"] for r in multiscale.adapted(entries, adapters, 100.0).collect()}
    assert moved["a"][0] > 0.99 and abs(sum(x * x for x in moved["a"]) - 1) < 1e-9
    asked = entries.where("level = 2").select(F.lit(1).alias("query_id"), "vec", F.lit("logic").alias("kind"))
    assert multiscale.adaptive(entries, asked.unionByName(asked.withColumn("query_id", F.lit(2)).withColumn("kind", F.lit("specification"))), derived).count() == 2


def test_profiles(spark):
    assert Q.profile_params("high", priority="precision")["k_per_level"] == 4
    docs = spark.createDataFrame([("unbelievable cat cat",)], "text string")
    got = tuning.piece_profile(docs, lambda words: [4 if len(w) > 5 else 1 for w in words]).first()
    assert got["mean_pieces"] == 2.0 and got["fragmented"] == pytest.approx(1 / 3, abs=1e-6)


def test_cli_and_server(spark, tmp_path):
    import threading
    import urllib.error
    import urllib.request
    from http.server import HTTPServer

    from lodestar import cli

    (tmp_path / "a.md").write_text("# Triage\n\nTriage sorts patients.")
    assert "Triage" in cli.ask(files.read_folder(spark, str(tmp_path)), "triage patients")["answer"]
    server = HTTPServer(("127.0.0.1", 0), cli.handler(spark))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"

    def post(body):
        request = urllib.request.Request(base + "/query", json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=120) as reply:
                return reply.status, json.loads(reply.read())
        except urllib.error.HTTPError as e:
            return e.code, {}

    assert urllib.request.urlopen(base + "/health", timeout=10).status == 200
    assert post({"question": " ", "documents": [{"text": "x"}]})[0] == 400 and post({"question": "x"})[0] == 400
    status, body = post({"question": "patients", "documents": [{"id": "1", "text": "patients wait", "title": "T"}]})
    assert status == 200 and body["confidence"] > 0
    server.shutdown()
