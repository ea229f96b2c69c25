"""Sessions, variants of a question and rerankers that stand in for another."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import dialogue, retrieval

WORDS = "alpha beta gamma delta zeta eta 人工 智能 v1.2".split()


def made(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.mark.parametrize("part", [3, 50_000])
def test_sessions_equal_one_run_each(spark, monkeypatch, part):
    monkeypatch.setattr(retrieval, "SESSION_PART", part)
    r = random.Random(3)
    chunks = [(s, 10 * k + j, made(r, r.randint(0, 9)) if k % 5 else None) for j, (s, n) in enumerate((("a", 25), ("b", 6), ("", 4))) for k in range(n)]
    asked = [("a", 1, "alpha beta"), ("b", 1, "alpha beta"), ("", 2, "zeta zeta 智能"), ("nobody", 3, "alpha"), ("a", 4, None)]
    of_chunks, of_asked = spark.createDataFrame(chunks, "session string, chunk_pos long, text string"), spark.createDataFrame(asked, "session string, query_id long, text string")
    got = {(x["session"], x["query_id"], x["rank"]): (x["chunk_pos"], round(x["bm25"], 9)) for x in retrieval.session_topk(of_chunks, of_asked, 4).collect()}
    want = {}
    for s in ("a", "b", ""):
        own = retrieval.bm25(of_chunks.where(F.col("session") == s), of_asked.where(F.col("session") == s))
        for x in own.select("query_id", "chunk_pos", "bm25", retrieval.ranked("bm25")).where("rank <= 4").collect():
            want[s, x["query_id"], x["rank"]] = (x["chunk_pos"], round(x["bm25"], 9))
    assert got == want and len(got) > 8


def test_variants_are_searched_together(spark):
    r = random.Random(4)
    rows = [(k, made(r, 6), [r.gauss(0, 1) for _ in range(3)]) for k in range(30)]
    chunks = spark.createDataFrame(rows, "chunk_pos long, text string, vector array<double>")
    variants = [(1, 0, "alpha beta", rows[3][2]), (1, 1, "zeta 智能", None), (2, 0, "v1.2", rows[5][2]), (2, 1, None, None)]
    table = spark.createDataFrame(variants, "query_id long, variant int, text string, vector array<double>")
    cfg = retrieval.RetrieveConfig(candidate_k=5)
    best, trace = retrieval.search_variants(chunks, table, cfg, traced=2)
    alone = {}
    for q, v, text, vector in variants[:3]:
        one = spark.createDataFrame([(1, text, vector)], "query_id long, text string, vector array<double>")
        for x in retrieval.retrieve(chunks, one, cfg).collect():
            alone.setdefault(q, []).append((-round(x["fused"], 9), x["chunk_pos"], v, x["rank"]))
    for q, found in alone.items():
        first = {}
        for f, pos, v, _ in sorted(found, key=lambda y: (y[0], y[2])):
            first.setdefault(pos, (f, pos, v))
        got = [(-round(x["fused"], 9), x["chunk_pos"], x["variant"]) for x in best.where(F.col("query_id") == q).orderBy("place").collect()]
        assert got == sorted(first.values(), key=lambda y: y[:2])[:5]
        assert {(x["variant"], x["rank"], x["chunk_pos"]) for x in trace.where(F.col("query_id") == q).collect()} == {(v, rank, pos) for _, pos, v, rank in found if rank <= 2}
    with pytest.raises(ValueError):
        retrieval.search_variants(chunks, table.union(table), cfg)


def test_a_reranker_that_fails_is_stood_in_for(spark):
    candidates = spark.createDataFrame([(q, r, 10 * q + r) for q in range(1, 6) for r in (1, 2, 3)], "query_id long, rank int, chunk_pos long")
    kinds = "query_id long, index int, score double, error string"
    api = [(1, 0, 0.1, None), (1, 2, 0.9, None), (1, 7, 1.0, None), (2, None, None, "HTTP 500"), (3, 9, 0.5, None), (4, None, None, "timeout"), (5, 0, float("nan"), None)]
    llm = [(2, 1, 0.4, None), (2, 0, 0.4, None), (3, None, None, "no JSON"), (5, 1, 0.2, None)]
    serve = lambda rows: lambda asked: spark.createDataFrame(rows, kinds).join(asked.select("query_id").distinct(), "query_id", "left_semi")
    found = dialogue.rerank_with_fallback(candidates, serve(api), serve(llm), 2).collect()
    got = {q: sorted((x["place"], x["chunk_pos"], x["rerank"], x["rerank_mode"], x["degraded"]) for x in found if x["query_id"] == q) for q in range(1, 6)}
    assert got[1] == [(1, 13, 0.9, "api", None), (2, 11, 0.1, "api", None)]
    assert got[2] == [(1, 21, 0.4, "llm", dialogue.STOOD_IN + "HTTP 500"), (2, 22, 0.4, "llm", dialogue.STOOD_IN + "HTTP 500")]
    assert got[3] == [(r, 30 + r, None, "none", f"{dialogue.NOTHING} | no JSON") for r in (1, 2, 3)]
    assert got[4] == [(r, 40 + r, None, "none", f"timeout | {dialogue.NOTHING}") for r in (1, 2, 3)]
    assert got[5] == [(1, 52, 0.2, "llm", dialogue.STOOD_IN + dialogue.NOTHING)]
    only = dialogue.rerank_with_fallback(candidates, serve(llm), None, 2, ("llm", "")).where("query_id = 3").select("degraded").distinct().collect()
    assert [x[0] for x in only] == ["no JSON"]


def test_the_retry_prompt(spark):
    row = spark.range(1).select(dialogue.retry_prompt(F.lit("q?"), F.array(F.lit("one"), F.lit("two"))).alias("p")).first()["p"]
    assert row.startswith(dialogue.RETRY_SYSTEM) and row.endswith("one / two") and "q?" in row


def test_a_session_shuffles_only_what_is_asked_for(spark, monkeypatch):
    """Of texts of words that no query has, nothing is kept; chunks of two sessions may share a number."""
    written, write = {}, retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    chunks = [(s, k, " ".join(f"u{s}{k}x{j}" for j in range(50)) + f" alpha beta{k % 7}") for s in "ab" for k in range(40)]
    of_chunks = spark.createDataFrame(chunks, "session string, chunk_pos long, text string")
    of_asked = spark.createDataFrame([("a", 1, "beta1 alpha"), ("b", 1, "beta2")], "session string, query_id long, text string")
    found = retrieval.session_topk(of_chunks, of_asked, 3)
    assert [(x["session"], x["chunk_pos"]) for x in found.orderBy("session", "rank").collect()] == [("a", 1), ("a", 8), ("a", 15), ("b", 2), ("b", 9), ("b", 16)]
    assert "terms" not in written and written["postings"].count() == 80 + 40 + 6 + 6
