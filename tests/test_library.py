"""Search, recommendation, tags, processing states and model replies."""

from __future__ import annotations

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexframe.functions import replies, vectors
from codexframe.operators import embedding, recommend, search, taxonomy
from codexframe.plans import jobs

T0 = datetime.datetime(2024, 1, 1)


def test_overfetch_then_one_per_document(spark):
    chunks = spark.createDataFrame([(i, 1, [1.0, i / 1000]) for i in range(60)] + [(100 + i, 2, [0.0, 1.0]) for i in range(3)] + [(200, 3, None)], "chunk_id long, document_id long, embedding array<float>")
    documents = spark.createDataFrame([(1, "me"), (2, "me"), (3, "me")], "document_id long, user_id string")
    rows = search.semantic_search(chunks, documents, "me", [1.0, 0.0], 10, chunk_id="chunk_id").collect()
    assert [(r.chunk_id, r.document_id) for r in rows] == [(0, 1)]  # the fifty best chunks are all of one document
    assert search.semantic_search(chunks, documents, "other", [1.0, 0.0], 10, chunk_id="chunk_id").count() == 0
    assert [search.clamp_limit(x) for x in (0, 3.9, 99)] == [1, 3, 20]


def test_approximate_mode_is_part_of_the_exact_order(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    q = [float(x) for x in rows.where("vec_id = 7").first().embedding]
    exact = {r.vec_id for r in search.top_k(rows, q, 10, "vec_id").collect()}
    near = {r.vec_id for r in search.approximate_top_k(rows, q, 10, "vec_id", width=2.0).collect()}
    assert len(exact & near) >= 6 and 7 in near


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([float("nan"), 1.0],), (None,), ([1.0],), ([float("inf"), 0.0],)], "v array<double>")
    assert [r[0] for r in df.select(vectors.is_valid(F.col("v"), 2)).collect()] == [True, False, False, False, False]
    assert vectors.cosine_to([1.0, 0.0]) is not None


def test_embedder_contract(spark):
    model = embedding.checked(embedding.hashing_embedder(8), 8)
    assert np.allclose(np.linalg.norm(model(["a b", "c"]), axis=1), 1)
    for bad in ([""], ["x" * 20_001]):
        with pytest.raises(embedding.BadInput):
            model(bad)
    with pytest.raises(ValueError, match="gave"):
        embedding.checked(embedding.hashing_embedder(4), 8)(["a"])
    rows = spark.createDataFrame([(1, "a", [1.0] * 8), (2, "b", None), (3, None, None)], "id long, content string, embedding array<float>")
    got = {r.id: r.embedding for r in embedding.embed_missing(rows, embedding.hashing_embedder(8), 8, F.col("content")).collect()}
    assert got[1] == [1.0] * 8 and len(got[2]) == 8 and got[3] is None


def test_exact_then_alias(spark):
    tags = spark.createDataFrame([("t1", "me", "machine learning"), ("t2", "you", "rag"), ("t3", "me", "retrieval")], "id string, created_by_user_id string, normalized_name string")
    aliases = spark.createDataFrame([("t3", "rag", T0), ("t1", "rag", T0 + datetime.timedelta(1)), ("t1", "retrieval", T0)], "tag_id string, normalized_alias string, created_at timestamp")
    names = spark.createDataFrame([("me", "Machine-Learning"), ("me", "RAG"), ("me", "Retrieval"), ("me", "none"), ("me", "  "), ("you", "RAG")], "owner string, name string")
    got = {(r.owner, r.name): r.tag_id for r in taxonomy.resolve_exact(names, tags, aliases).collect()}
    assert got == {("me", "Machine-Learning"): "t1", ("me", "RAG"): "t3", ("me", "Retrieval"): "t3", ("me", "none"): None, ("me", "  "): None, ("you", "RAG"): "t2"}


def test_names_resolve_in_order(spark):
    angles = {"Base": 1.0, "Near": 0.95, "near!": 0.95, "Maybe": 0.8, "maybe?": 0.8, "Far": 0.0, "far.": 0.0, "!!": 0.0}

    def by_angle(texts):
        return np.array([[angles[t], (1 - angles[t] ** 2) ** 0.5] for t in texts])

    tags = spark.createDataFrame([("t", "base", "me", [1.0, 0.0])], "id string, normalized_name string, created_by_user_id string, embedding array<float>")
    aliases = spark.createDataFrame([], "tag_id string, normalized_alias string, created_at timestamp")
    names = spark.createDataFrame([("me", "d", [" Base", "Near", "near!", "Maybe", "maybe?", "Far", "far.", "!!", "Near", ""])], "owner string, document_id string, names array<string>")
    done = taxonomy.sync_tags(names, tags, aliases, by_angle)
    got = [(r.name, r.action, r.tag_id) for r in done.orderBy("position").collect()]
    fresh = "new:me:far"
    assert got == [
        ("Base", "LINK", "t"), ("Near", "MERGE", "t"), ("near!", "LINK", "t"),  # the alias that the merge made
        ("Maybe", "REVIEW", "t"), ("maybe?", "REVIEW", "t"),  # a review links nothing, so a second one comes
        ("Far", "CREATE", fresh), ("far.", "LINK", fresh), ("!!", "REJECT", None),
    ]
    links = {r.tag_id: (r.confidence, r.source) for r in taxonomy.document_links(done).collect()}
    assert links == {"t": (1.0, "AI"), fresh: (1.0, "AI")}  # the later exact hit overwrites the merge


def test_reset_keeps_user_links(spark):
    links = spark.createDataFrame([("d", "a", "AI"), ("d", "b", "USER"), ("e", "a", "MERGED")], "document_id string, tag_id string, source string")
    reviews = spark.createDataFrame([("d", "PENDING"), ("d", "APPROVED"), ("e", "PENDING")], "document_id string, status string")
    kept, left = taxonomy.reset_document_tags(links, reviews, spark.createDataFrame([("d",)], "document_id string"))
    assert sorted(tuple(r) for r in kept.collect()) == [("d", "b", "USER"), ("e", "a", "MERGED")]
    assert sorted(tuple(r) for r in left.collect()) == [("d", "APPROVED"), ("e", "PENDING")]


def test_recommendation_blend(spark):
    best = spark.createDataFrame([(1, 5, "x", 0.8), (2, 6, "y", 0.9)], "document_id long, best_chunk_id long, excerpt string, semantic_score double")
    documents = spark.createDataFrame([(1, "A", "Machine Learning", "ADVANCED", ["python"]), (2, "B", None, None, [])], "document_id long, title string, primary_topic string, difficulty string, keywords array<string>")
    tags = spark.createDataFrame([(1, "Deep Learning", "deep learning"), (1, "Cooking", "cooking")], "document_id long, name string, normalized_name string")
    project = {"title": "Learning machines", "description": "with Python", "keywords": ["AI"], "target_difficulty": "ADVANCED"}
    rows = {r.document_id: r for r in recommend.rank_documents(best, documents, tags, project).collect()}
    one = rows[1]  # words: learning, machines, with, python, ai / machine, learning, python
    assert (one.topic_score, one.difficulty_score, one.tag_score) == (pytest.approx(2 / 3), 1.0, 0.5)
    assert one.score == pytest.approx(0.65 * 0.8 + 0.15 * 2 / 3 + 0.1 + 0.05)
    assert one.reason == "Nội dung gần với đề tài (80% tương đồng), phù hợp độ khó mục tiêu, liên quan các tag Cooking, Deep Learning."
    assert rows[2].tag_score == 0.0 and rows[2].reason == "Nội dung gần với đề tài (90% tương đồng)."
    model = spark.createDataFrame([(2, "because")], "document_id long, model_reason string")
    assert {r.document_id: r.reason for r in recommend.with_reasons(rows and recommend.rank_documents(best, documents, tags, project), model).collect()}[2] == "because"


@pytest.mark.parametrize(
    ("args", "want"),
    [
        ((True, "t", 1, 1, False), None),
        ((False, None, 0, 0, False), ["EXTRACT_TEXT", "CHUNK_DOCUMENT", "EMBED_DOCUMENT", "ANALYZE_DOCUMENT"]),
        ((False, "t", 3, 1, False), ["EMBED_DOCUMENT", "ANALYZE_DOCUMENT"]),
        ((False, "t", 3, 1, True), ["EMBED_DOCUMENT"]),
        ((False, "t", 3, 0, False), ["ANALYZE_DOCUMENT"]),
        ((False, "t", 3, 0, True), None),
    ],
)
def test_resume(spark, args, want):
    row = spark.createDataFrame([args], "a boolean, t string, n long, m long, c boolean")
    assert row.select(jobs.resume_stages(*map(F.col, "atnmc"))).first()[0] == want


def test_failure_cascade(spark):
    failures = spark.createDataFrame([("d", "EXTRACT_TEXT", "m" * 600), ("e", "ANALYZE_DOCUMENT", "x")], "document_id string, failed_stage string, message string")
    rows = {(r.document_id, r.type): r for r in jobs.fail_cascade(failures).collect()}
    assert len(rows) == 5 and len(rows["d", "EXTRACT_TEXT"].error_message) == 500 and rows["d", "CHUNK_DOCUMENT"].document_status == "FAILED"
    assert rows["e", "ANALYZE_DOCUMENT"].document_status == "READY"


def test_replies(spark):
    good = '{"topic":"Database","difficulty":"ADVANCED","summary":"a summary that is long enough","subtopics":["ab","ab","cd"],"keywords":["a","b","c"],"reason":"because it is"}'
    texts = [f"```json\n{good}\n```", f"Sure: {good} bye", "nothing", '{"topic":"x"}']
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    done = {r.id: r for r in jobs.analyze(df, lambda t: t).collect()}
    assert done[0].violations == [] and done[0].analysis.subtopics == ["ab", "cd"] and done[1].violations == []
    assert "topic" in done[3].violations and len(done[2].violations) == 6

    def broken(_):
        raise RuntimeError("no answer")

    assert jobs.analyze(df, broken).first().error == "AI: no answer"
    bare = spark.createDataFrame([(1, None), (2, "")], "document_id long, text string")
    assert {r.error for r in jobs.analyze(bare, broken).collect()} == {"no text to analyze"}
    listed = spark.createDataFrame([('x [{"documentId":"1","reason":" a "},{"documentId":"2"},{"documentId":"1","reason":"b"}] y',)], "t string")
    assert listed.select(replies.reasons(F.col("t"))).first()[0] == {"1": "b"}


def test_secrets(spark):
    sealed = spark.range(1).select(replies.encrypt(F.lit("key"), "s").alias("x"))
    assert sealed.select(replies.decrypt(F.col("x"), "s")).first()[0] == "key"


def test_neighbours_in_tiles_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "TILE", 7)
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, rng.normal(size=4).round(1).tolist()) for i in range(60)] + [(90, 0, [0.0] * 4), (91, 0, None), (92, 9, [1.0] * 4)]
    got = search.neighbours_per_group(spark.createDataFrame(rows, "id long, g long, embedding array<double>"), "g", "id", k=2).collect()
    usable = {i: (g, np.array(v)) for i, g, v in rows if v and any(v)}
    for i, (g, v) in usable.items():
        want = sorted((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 9), j) for j, (h, w) in usable.items() if h == g and j != i)[:2]
        mine = sorted((r.rank, r.other_id, r.score) for r in got if r.id == i)
        assert [round(s, 9) for _, _, s in mine] == [-s for s, _ in want]


def test_providers(spark):
    from codexframe.functions import providers

    df = spark.createDataFrame([('{"data":[{"id":"b"},{"id":"a"},{"id":"b"}]}', '{"choices":[{"message":{"content":"OK"}}]}', '{"models":[{"name":"m"}]}', '{"message":{"content":"OK"}}')], "a string, b string, c string, d string")
    row = df.select(
        providers.model_names(F.col("a"), "OPENAI"), providers.chat_content(F.col("b"), "OPENAI_COMPATIBLE"),
        providers.model_names(F.col("c"), "OLLAMA"), providers.chat_content(F.col("d"), "OLLAMA"),
    ).first()
    assert tuple(row) == (["a", "b"], "OK", ["m"], "OK")
    sent = []

    def transport(*request):
        sent.append(request)
        return '{"choices":[{"message":{"content":"fine"}}]}'

    assert providers.chat_function(transport, "OPENAI", "http://x/v1/", "m", "be brief", "k")("hello") == "fine"
    assert sent[0][1] == "http://x/v1/chat/completions" and sent[0][2]["Authorization"] == "Bearer k"
    with pytest.raises(ValueError, match="no text"):
        providers.chat_function(lambda *_: '{"message":{"content":" "}}', "OLLAMA", "http://x", "m", "s")("hello")


def test_pages_and_vectors_of_tags(spark):
    from codexframe.plans import reports

    assert embedding.health(embedding.hashing_embedder(8), "hash", 8)["status"] == "ready"
    assert embedding.health(embedding.hashing_embedder(4), "hash", 8)["status"].startswith("failed")
    tags = spark.createDataFrame([("a", "x", "about", None), ("b", "y", None, [1.0] * 8)], "id string, name string, description string, embedding array<float>")
    got = {r.id: r.embedding for r in embedding.embed_tags(tags, embedding.hashing_embedder(8), 8, ["a"]).collect()}
    assert got["b"] == [1.0] * 8 and got["a"] == pytest.approx(embedding.hashing_embedder(8)(["x: about"])[0].tolist())
    providers = spark.createDataFrame([("p", "me", "http://x//", True, T0, "secret"), ("q", "me", None, False, T0, None)], "id string, user_id string, base_url string, is_active boolean, created_at timestamp, encrypted_api_key string")
    shown = reports.provider_list(providers, "me").collect()
    assert [(r.id, r.base_url, r.has_api_key) for r in shown] == [("p", "http://x", True), ("q", None, False)] and "encrypted_api_key" not in shown[0].asDict()
    projects = spark.createDataFrame([("1", "me", T0), ("2", "me", T0 + datetime.timedelta(1))], "id string, user_id string, updated_at timestamp")
    made = spark.createDataFrame([("1", "d", 0.5, "r"), ("1", "e", 0.9, "s")], "project_id string, document_id string, score double, reason string")
    documents = spark.createDataFrame([("d", "D"), ("e", "E")], "id string, title string")
    assert [(r.id, r.recommendations) for r in reports.project_list(projects, made, "me").collect()] == [("2", 0), ("1", 2)]
    detail = {r.id: r.recommendations for r in reports.project_detail(projects, made, documents).collect()}
    assert [x.title for x in detail["1"]] == ["E", "D"] and detail["2"] is None
    reviews = spark.createDataFrame([("r", "me", "d", "t", "PENDING", T0), ("s", "me", None, "t", "REJECTED", T0)], "id string, user_id string, document_id string, suggested_tag_id string, status string, created_at timestamp")
    named = spark.createDataFrame([("t", "Tag")], "id string, name string")
    assert [(r.id, r.suggested_name, r.title) for r in reports.pending_reviews(reviews, named, documents, "me").collect()] == [("r", "Tag", "D")]
    row = spark.range(1).select(jobs.document_status(F.lit("t"), F.lit(2), F.lit(0), F.lit(False), F.lit(True)), jobs.document_status(F.lit("t"), F.lit(2), F.lit(1), F.lit(False), F.lit(True)))
    assert tuple(row.first()) == ("ANALYZING", "EXTRACTED")
