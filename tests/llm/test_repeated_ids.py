"""Rows that share an id, null as well, but not the text are decided each for itself."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from quarry.llm import decontaminate, near_duplicates

LEAK = " ".join(f"leak{k}" for k in range(12))
PROSE = [" ".join(f"w{n}x{k}" for k in range(40)) for n in range(8)]
ROWS = [(None, PROSE[0]), (None, PROSE[1] + " " + LEAK), (None, PROSE[2]), (7, PROSE[3]), (7, LEAK + " " + PROSE[4]), (7, PROSE[5]), (7, PROSE[5]), (8, PROSE[6]), (9, "too short"), (None, "short too")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


def test_decontamination_of_each_row(spark, docs):
    items = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"]) for r in decontaminate.decontaminate(docs, items).collect())
    assert got == Counter((i, len(t.split()), 12 * (LEAK in t)) for i, t in ROWS)


def test_stages_of_each_row(spark, docs, tmp_path):
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(8, 1)], "doc_id long, quality int").where(F.lit(False)).write.parquet(f"{tmp_path}/labels.parquet")
    rows = lambda stage: Counter(tuple(r) for r in stage(spark, docs, str(tmp_path)).collect())
    assert rows(corpus_pipeline.decontamination) == Counter(r for r in ROWS if LEAK not in r[1])
    assert rows(corpus_pipeline.quality_rules) == Counter(r for r in ROWS if "short" not in r[1])
    assert rows(corpus_pipeline.near_duplicate_join) == Counter(set(ROWS))


def test_links_of_each_text(spark):
    a, b = PROSE[0], PROSE[1]
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " y"), (None, b + " z"), (None, PROSE[2]), (None, PROSE[2] + " z"), (1, a)]
    links = {a: 1, a + " x": 1, b: 2, b + " y": 2, b + " z": 2, PROSE[2]: 1, PROSE[2] + " z": 1}
    first = {a: 1, a + " x": 1, b: 1, b + " y": 1, b + " z": 1, PROSE[2]: None, PROSE[2] + " z": None}
    want = Counter((i, first[t], links[t]) for i, t in rows)
    got = near_duplicates.link_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in got) == want
    named = near_duplicates.link_duplicates(spark.createDataFrame([(f"id{i}" if i else None, t) for i, t in rows], "doc_id string, text string")).collect()
    assert Counter((r["doc_id"], r["class_id"]) for r in named) == Counter((f"id{i}" if i else None, first[t] and "id1") for i, t in rows)


def test_many_rows_of_one_text(spark):
    rows = [(None, PROSE[0])] * 2500 + [(5, PROSE[0]), (6, PROSE[1] + " " + LEAK)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, LEAK)], "item_id long, text string")).groupBy("doc_id", "n_hit").count().collect()
    assert {tuple(r) for r in got} == {(None, 0, 2500), (5, 0, 1), (6, 12, 1)}
    linked = near_duplicates.link_duplicates(docs).groupBy("doc_id", "class_id", "n_copies").count().collect()
    assert {tuple(r) for r in linked} == {(None, 5, 2501, 2500), (5, 5, 2501, 1), (6, 6, 1, 1)}


def test_items_of_many_words(spark):
    r = random.Random(3)
    long = [f"v{r.randrange(3000)}" for _ in range(8000)]
    docs = spark.createDataFrame([(1, " ".join(long[4000:4030])), (2, " ".join(long)), (3, " ".join(long[7990:] + long[:5])), (4, PROSE[0])], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long))], "item_id long, text string")
    want = {(1, 30, 30), (2, 8000, 8000), (3, 15, 10), (4, 40, 0)}
    for bound in (decontaminate.BOUND, 1000):
        assert {(x["doc_id"], x["n_words"], x["n_hit"]) for x in decontaminate.decontaminate(docs, items, bound=bound).collect()} == want
    found = decontaminate.anchors(docs, items).agg(F.sum(F.size("iw"))).first()[0]
    assert found < 2 * decontaminate.WINDOW * 8000


def test_stages_of_odd_tables(spark, tmp_path):
    """Empty tables and labels, a very long text and columns whose names clash."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    columns = "doc_id long, text string, lang string, score string, __r string, n string, part string"
    long = " ".join(f"w{k % 997}x{k // 997}" for k in range(150_000))
    rows = [(1, PROSE[0], "aa"), (2, long, "aa"), (None, None, None), (3, "", "aa"), (4, PROSE[1], None)]
    docs = spark.createDataFrame([(*r, *"zzzz") for r in rows], columns)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).isEmpty(), name
        found = stage(spark, docs, str(tmp_path))
        ids = {r["doc_id"] for r in found.select("doc_id").collect()}
        assert ids >= {1, 2, 4}, name
        if name != "packing":
            assert found.columns == docs.columns and {r["__r"] for r in found.collect()} == {"z"}, name


def test_of_rows_that_differ_elsewhere_one_is_kept_always(spark):
    rows = [(1, PROSE[0], "aa"), (1, PROSE[0], "bb"), (1, PROSE[0], None), (1, PROSE[0], None), (None, PROSE[0], "null"), (2, PROSE[1], "aa"), (None, None, "aa"), (None, None, None), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = [sorted(map(str, near_duplicates.representatives(docs.repartition(n), docs.columns).collect())) for n in (1, 5)]
    assert found[0] == found[1] and len(found[0]) == 4
