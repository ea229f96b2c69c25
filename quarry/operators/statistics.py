"""Exact order statistics without a sort of the whole table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.storage import materialise

#: Steps of a histogram, and rows that are sorted in the end at most (more only where they are all equal).
STEPS, ROWS = 10_000, 100_000


def with_next(rows: DataFrame, order: str, column: str, name: str = "next") -> DataFrame:
    """``rows`` (of columns ``order``, unique, and ``column``) but the last in order, with ``name``: the ``column`` of the row that follows.

    The order is dealt into ranges; a range's last row meets the first one of the next range, of which there is a row each.
    """
    ranged = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("__range", F.spark_partition_id())
    ranged = materialise(ranged, "ranges")
    own = Window.partitionBy("__range").orderBy(order)
    ends = ranged.groupBy("__range").agg(F.min_by(F.col(column), F.col(order)).alias("__first"), F.max(order).alias("__last"))
    # a range each: few rows, so their order is one task's work
    beyond = ends.select(F.col("__last").alias(order), F.lead("__first").over(Window.orderBy("__range")).alias("__beyond"))
    both = ranged.withColumn(name, F.lead(column).over(own)).join(F.broadcast(beyond), order, "left")
    last = both.groupBy().agg(F.max(order).alias("__end"))
    return both.crossJoin(F.broadcast(last)).where(F.col(order) < F.col("__end")).select(order, column, F.coalesce(name, "__beyond").alias(name))


def discrete_percentile(df: DataFrame, column: str, p: float) -> float | None:
    """The value at place floor((n - 1) p / 100) of ``column`` in ascending order; null values don't count, no values give None.

    Histograms narrow the range around the place down; only what is left of it is sorted.
    """
    values = materialise(df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)"), "values")  # read by each pass
    n, lo, hi = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return None
    place = math.floor((n - 1) * min(100, max(0, p)) / 100)
    while n > ROWS and lo < hi:
        width = (hi - lo) / STEPS
        if not lo + width > lo:
            break
        step = F.least(F.lit(STEPS - 1), F.floor((F.col("x") - lo) / width)).alias("step")
        inside = values.where(F.col("x").between(lo, hi))
        counts = inside.groupBy(step).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("step").collect()  # STEPS rows at most
        for r in counts:
            if place < r["n"]:
                break
            place -= r["n"]
        if r["n"] == n:
            break
        n, lo, hi = r["n"], r["lo"], r["hi"]
    if lo == hi:
        return lo
    return values.where(F.col("x").between(lo, hi)).orderBy("x").offset(place).limit(1).first()["x"]
