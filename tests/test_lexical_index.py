"""The index of runs against scores over the corpus as it is."""

import random

import pytest

from quarry import runs
from quarry.operators import lexical_index, retrieval
from quarry.storage import scratch

WORDS = "alpha beta gamma delta v1.2 人工智能 学习 omega zeta eta theta iota".split()
ASKED = [(1, "alpha beta 人工"), (2, "zeta zeta unknown"), (3, None), (4, "iota 学习 v1.2 gamma")]


def made(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) if n else None


def scores(df):
    return {(r["query_id"], r["chunk_pos"]): round(r["bm25"], 9) for r in df.collect()}


@pytest.fixture
def frames(spark):
    chunks = lambda held: spark.createDataFrame(list(held.items()), "chunk_pos long, text string")
    ids = lambda some: spark.createDataFrame([(i,) for i in some], "chunk_pos long")
    return chunks, ids, spark.createDataFrame(ASKED, "query_id long, text string")


def test_runs_of_changes_equal_a_rebuild(spark, frames):
    chunks, ids, asked = frames
    r, path = random.Random(1), scratch(spark, "index")
    held = {i: made(r, i % 7) for i in range(40)}
    lexical_index.create(chunks(held), path, buckets=4)

    def same():
        found = lexical_index.stats(spark, path).first()
        rebuilt = retrieval.corpus_stats(chunks(held)).first()
        assert (found["n"], round(found["avgdl"], 9)) == (rebuilt["n"], round(rebuilt["avgdl"], 9))
        assert scores(lexical_index.bm25(spark, path, asked)) == scores(retrieval.bm25(chunks(held), asked))

    same()
    steps = [
        ({3: "alpha alpha", 50: "beta 人工智能", 7: "zeta"}, [5, 6, 7, 999]),  # 7 is both: gone
        ({5: "iota again", 3: None}, []),  # comes back; loses its terms
        ({}, [50, 51]),
    ]
    for change, gone in steps:
        for _ in range(2):  # a repeated run leaves the same state
            lexical_index.update(spark, path, chunks(change), ids(gone)) if change else lexical_index.update(spark, path, gone=ids(gone))
        held.update(change)
        for i in gone:
            held.pop(i, None)
        same()
    run = lexical_index.compact(spark, path)
    assert runs.committed(spark, path) == [run]
    same()
    lexical_index.update(spark, path, chunks({60: "omega alpha"}))
    held[60] = "omega alpha"
    same()


def test_a_run_without_commit_has_no_effect(spark, frames, monkeypatch):
    chunks, ids, asked = frames
    path = scratch(spark, "index")
    lexical_index.create(chunks({1: "alpha", 2: "beta"}), path, buckets=2)
    before = scores(lexical_index.bm25(spark, path, asked))

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "commit", lost)
        with pytest.raises(RuntimeError):
            lexical_index.update(spark, path, chunks({1: "zeta", 9: "zeta"}), ids([2]))
    assert scores(lexical_index.bm25(spark, path, asked)) == before
    assert lexical_index.update(spark, path, chunks({3: "beta"})) == 1
    assert scores(lexical_index.bm25(spark, path, asked)) == scores(retrieval.bm25(chunks({1: "alpha", 2: "beta", 3: "beta"}), asked))


def test_a_search_reads_its_terms_buckets_only(spark, frames):
    chunks, _, _ = frames
    path = scratch(spark, "index")
    lexical_index.create(chunks({i: w for i, w in enumerate(WORDS)}), path, buckets=8)
    one = spark.createDataFrame([("alpha",)], "term string")
    read = lexical_index.postings(spark, path, one)
    folders = {f.rsplit("/", 2)[-2] for f in spark.read.parquet(f"{path}/postings/run=0").inputFiles()}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert len(folders) > 3 and "bucket" in plan.split("PartitionFilters", 1)[1].split("]", 1)[0] and read.count() == 1


def test_errors_and_empty_corpora(spark, frames):
    chunks, ids, asked = frames
    path = scratch(spark, "index")
    with pytest.raises(ValueError, match="no index"):
        lexical_index.stats(spark, path)
    lexical_index.create(chunks({1: "alpha"}).limit(0), path)
    assert tuple(lexical_index.stats(spark, path).first()) == (0, 0.0) and not scores(lexical_index.bm25(spark, path, asked))
    with pytest.raises(ValueError, match="there is an index"):
        lexical_index.create(chunks({1: "alpha"}), path)
    lexical_index.update(spark, path, chunks({1: "alpha"}))
    assert set(scores(lexical_index.bm25(spark, path, asked))) == {(1, 1)}
    lexical_index.update(spark, path, gone=ids([1]))
    assert tuple(lexical_index.stats(spark, path).first()) == (0, 0.0)
