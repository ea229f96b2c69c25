"""The quality rules' counters keep many distinct n-grams apart."""

import random

import pytest

from quarry.llm import quality
from test_operators import plain_scores


def test_counters_of_many_ngrams(spark):
    r = random.Random(1)
    common = [f"w{k}" for k in range(50)]
    texts = [(k, " ".join(r.choice(common) if r.random() < 0.3 else f"{r.randrange(1 << 40):x}" for _ in range(120))) for k in range(2000)]
    labels = spark.createDataFrame([(k, 1) for k in range(500)], "doc_id long, quality int")
    scored, _ = quality.score(spark.createDataFrame(texts, "doc_id long, text string"), labels)
    got = {x["doc_id"]: x["score"] for x in scored.collect()}
    by_fold = {x["doc_id"] for x in labels.where("pmod(xxhash64(5, doc_id), 5) <> 0").collect()}
    want = plain_scores(texts, by_fold)
    for k in range(0, 2000, 47):
        assert got[k] == pytest.approx(want[k], abs=0.05)  # 170,000 words in 2^20 counters: some share one
