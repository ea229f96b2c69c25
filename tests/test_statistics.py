import math
import random

import pytest

from quarry.operators import statistics


@pytest.mark.parametrize("rows", [10, 100_000])
def test_percentiles(spark, monkeypatch, rows):
    monkeypatch.setattr(statistics, "ROWS", rows)
    r = random.Random(1)
    for values in ([r.gauss(0, 1) for _ in range(500)], [1.0] * 50 + [2.0] * 30 + [1.0 + 1e-16], [5.0], [None, 3.0, None, 1.0, float("nan")], [0.0, 1e-300, 1e300] * 20):
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
        known = sorted(v for v in values if v is not None and v == v)
        for p in (0, 50, 85, 100):
            assert statistics.discrete_percentile(df, "v", p) == known[math.floor((len(known) - 1) * p / 100)]
    assert statistics.discrete_percentile(df.limit(0), "v", 50) is None


def test_the_next_row_in_order(spark):
    """Neighbours by order, wherever ids have gaps and ranges end."""
    ids = [3, 4, 9, 100, 101, 5000, -7, 12, 13]
    rows = spark.createDataFrame([(i, f"v{i}" if i != 12 else None) for i in ids], "i long, v string").repartition(3)
    order = sorted(ids)
    want = {(a, f"v{b}" if b != 12 else None) for a, b in zip(order, order[1:])}
    got = {(r["i"], r["next"]) for r in statistics.with_next(rows, "i", "v").collect()}
    assert got == want
    assert statistics.with_next(rows.limit(0), "i", "v").isEmpty()
