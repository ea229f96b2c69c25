"""Connected components of edge tables, and joins with a table of unique keys that bear frequent ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.storage import forget, materialise

#: A key is frequent above this number of rows, and above this share of all rows; so at most SHARE keys are.
FREQUENT, SHARE = 1000, 1000


def join_unique(rows: DataFrame, side: DataFrame, key: list[str], total: int) -> DataFrame:
    """``rows`` joined with ``side``, whose ``key`` is unique and whose ``m`` says how many rows have it (less m).

    ``total``: an upper bound of the rows, up to a constant factor. Frequent keys, of
    which there are a constant number at most, are broadcast, so that no task gets all rows of one.
    """
    bound = max(FREQUENT, total // SHARE)
    side = materialise(side, "side")
    often = F.col("m") > bound
    if side.where(often).isEmpty():
        return rows.join(side.drop("m"), key)
    hot, cold = F.broadcast(side.where(often).drop("m")), side.where(~often).drop("m")
    return rows.join(hot.select(key), key, "left_anti").join(cold, key).unionByName(rows.join(hot, key))


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (a, b; longs).

    Alternates two steps until nothing changes: each node's larger neighbours, then
    its smaller ones, are tied to its least neighbour. Rounds grow with the logarithm
    of the component's size; each round's edges are a written table.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = materialise(now, "components"), None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark["n"]:
            break
        before, total = mark, mark["n"]
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).union(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("t"), F.count("*").alias("m")).withColumn("t", F.least("t", "v"))
        large = join_unique(both.where("u > v"), least, ["v"], total).select(F.col("u").alias("a"), F.col("t").alias("b")).distinct()
        large = materialise(large, "components")
        least = large.groupBy("a").agg(F.min("b").alias("t"), F.count("*").alias("m"))
        tied = join_unique(large, least, ["a"], total).select(F.explode(F.array(F.struct("a", F.col("t").alias("b")), F.struct(F.col("b").alias("a"), F.col("t").alias("b")))).alias("e")).select("e.*")
        after = materialise(tied.where("a <> b").distinct(), "components")
        forget(edges.sparkSession, now, large)
        now = after
    return now.groupBy("a").agg(F.min("b").alias("label")).select(F.col("a").alias("node"), "label").union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
