"""Pruned searches give the first k of a full search, and skip blocks."""

import random

import numpy as np
import pytest

from quarry.operators import pruned, retrieval


def first(df, score):
    return sorted((r["query_id"], r["rank"], r["chunk_pos"], round(r[score], 8)) for r in df.collect())


def full(df, score, k):
    return first(df.select("query_id", "chunk_pos", score, retrieval.ranked(score)).where(f"rank <= {k}"), score)


@pytest.mark.parametrize("block", [4, 512])
def test_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(pruned, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6))
    rows = [(k, (centres[k % 8] + rng.normal(size=6) * 0.05).tolist()) for k in range(300)]
    rows += [(300 + k, rows[3][1]) for k in range(40)] + [(400, [0.0] * 6), (401, None), (402, [1.0, 2.0]), (403, []), (404, [-c for c in rows[0][1]])]
    asked = [(k, rows[k][1]) for k in range(0, 40, 5)] + [(90, [0.0] * 6), (91, None), (92, [1.0, 2.0]), (93, (-centres[0]).tolist())]
    chunks, queries = spark.createDataFrame(rows, "chunk_pos long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    for k in (1, 7, 500):
        found, taken = pruned.dense(chunks, queries, k)
        assert first(found, "semantic") == full(retrieval.dense(chunks, queries, k), "semantic", k)
        share = np.mean([r["taken"] for r in taken.where("query_id < 90").collect()])
        assert share == 1 if k == 500 else share < 0.6
    found, taken = pruned.dense(chunks.limit(0), queries, 3)
    assert found.isEmpty() and taken.isEmpty()
    assert pruned.dense(chunks.where("chunk_pos in (400, 401)"), queries, 3)[0].count() == 11


@pytest.mark.parametrize("block", [5, 512])
def test_terms(spark, block):
    r = random.Random(2)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(300)]
    texts = [" ".join(r.choice(common) for _ in range(r.choice([3, 30]))) + " " + r.choice(rare) * (k % 3 > 0) for k in range(200)] + [None, "", "c1 " * 4000]
    texts += [f"needle{k} needle{k} x" for k in range(3)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_pos long, text string")
    asked = [(1, "c1 c2 c3"), (2, "needle1 c5"), (3, None), (4, "nothing"), (5, "c1 " * 200), (6, " ".join(rare[:40]) + " c0")]
    queries = spark.createDataFrame(asked, "query_id long, text string")
    for k in (1, 10):
        found, taken = pruned.bm25(chunks, queries, k, block=block)
        assert first(found, "bm25") == full(retrieval.bm25(chunks, queries), "bm25", k)
        if block == 5 and k == 1:
            assert not all(r["taken"] for r in taken.collect())
    assert pruned.bm25(chunks.limit(0), queries, 3)[0].isEmpty()


def test_only_asked_terms_are_kept_and_pairs_stay_in_tasks(spark):
    """What is read for a query leaves a block as its first few, not as a row a pair, and words of no query are not kept."""
    chunks = spark.createDataFrame([(k, f"common word{k} also{k} more{k}") for k in range(400)], "chunk_pos long, text string")
    queries = spark.createDataFrame([(1, "common"), (2, "common word7")], "query_id long, text string")
    asked = retrieval.materialise(retrieval.asked_terms(queries), "asked")
    posted, lex = pruned.term_blocks(chunks, asked, 100)
    assert posted.selectExpr("sum(size(ids))").first()[0] == 401 and posted.select("block").distinct().count() == 4 and lex.n == 400
    found, _ = pruned.bm25(chunks, queries, 2, block=100)
    assert first(found, "bm25") == full(retrieval.bm25(chunks, queries), "bm25", 2)


def test_vectors_of_another_size_in_many_blocks(spark, monkeypatch):
    """A query of the rarer size is held against all chunks of that size; no table of all queries and blocks is written."""
    written, write = [], pruned.materialise
    monkeypatch.setattr(pruned, "materialise", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(pruned, "BLOCK", 4)
    rng = np.random.default_rng(7)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(200)] + [(200 + k, rng.normal(size=2).tolist()) for k in range(120)]
    asked = [(k, rng.normal(size=2).tolist()) for k in range(30)] + [(50 + k, rng.normal(size=3).tolist()) for k in range(30)]
    chunks, queries = spark.createDataFrame(rows, "chunk_pos long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")
    found, taken = pruned.dense(chunks, queries, 2)
    assert first(found, "semantic") == full(retrieval.dense(chunks, queries, 2), "semantic", 2)
    every = taken.count()
    assert every == 60 * taken.select("block").distinct().count() and max(t.count() for t in written) < every / 2


def test_all_terms_of_a_long_query_count(spark):
    """A question's words beyond the first hundred and more find their chunk, and count in every score."""
    texts = [f"filler{k % 10} other{k}" for k in range(60)] + ["needle filler3"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_pos long, text string")
    queries = spark.createDataFrame([(1, "filler3 " * 130 + "needle " * 200), (2, "nothing " * 128 + "other7")], "query_id long, text string")
    found = first(pruned.bm25(chunks, queries, 1, block=8, terms=None)[0], "bm25")
    assert [(q, pos) for q, _, pos, _ in found] == [(1, 60), (2, 7)]
    every = [r["qf"] for r in retrieval.asked_terms(queries, None).where("query_id = 1").orderBy("term").collect()]
    assert every == [130, 200] and retrieval.asked_terms(queries).where("query_id = 1").count() == 1
