"""All labelled rows count, and the threshold's percentiles are exact."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality


def test_percentiles_from_counts(spark):
    r = random.Random(1)
    rows = [(t, c, int(r.gauss(0, 1) * 10 ** r.randint(0, 10))) for t, c, n in ((1, True, 501), (1, False, 2), (0, True, 1), (0, False, 900)) for _ in range(n)] + [(1, True, 7)] * 300
    frame = spark.createDataFrame(rows, "trusted int, calibrates boolean, v long")
    want = frame.groupBy("trusted", "calibrates").agg(F.percentile(F.col("v") / quality.PLACES, [0.005, 0.5]).alias("q")).collect()
    got = quality._percentiles(frame, [0.005, 0.5])
    assert {(x["trusted"], x["calibrates"]) for x in want} == set(got)
    assert all(got[x["trusted"], x["calibrates"]] == pytest.approx(x["q"], abs=1e-12) for x in want)


@pytest.mark.parametrize("most", [10, 2_000_000])
def test_more_labels_than_a_sample_all_count(spark, monkeypatch, most):
    """More than 30,000 labelled rows: each trusted one is in the counts, by broadcast as by shuffle."""
    monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
    n, seen = 40_000, {}
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("same few words").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))

    def sums(marked, blocks, share):
        seen["t"] = marked.agg(F.sum("t")).first()[0]
        raise InterruptedError

    monkeypatch.setattr(quality, "_sums", sums)
    with pytest.raises(InterruptedError):
        quality.score(docs, labels)
    assert seen["t"] == labels.where("pmod(xxhash64(5, doc_id), 5) <> 0").count()
