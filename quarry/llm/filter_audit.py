"""Operator 12, filter interaction audit: what each filter removes in every order of filters.

Orders of filters form a trie. Its nodes with equal sets of filters applied have equal
survivors, so each set is one state. The trie is walked depth first: a state's survivors
are its parent's, persisted, less what one filter rejects; a state that is known
already is not entered again. At a state, one aggregation counts by part what each
filter not yet applied removes from the survivors: the edges of the trie. Survivors of
one path only are held at a time, as narrow rows (part, verdicts, labels) that are
worked out of the texts once and written; a lost executor's share is worked out again.

Every order and step then reads its edge. Results are by part and in bounded rows: the
orders of five filters are 120.

Documents: doc_id, text (null: empty), source (the part; null: empty string). Labels of
one doc_id count if any of its rows says 1. A null doc_id has no label, is no earlier copy and none of another.
Equal rows aren't copies of each other: a copy's doc_id is larger. Very long texts are
measured whole; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.graph import join_unique
from quarry.llm.keys import KEY, keyed
from quarry.storage import forget, materialise, scratch

BLANK = r"[\x20\x09-\x0D]+"


def conditions(text: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text: too few words, too few distinct ones, capitals, symbols."""
    return {
        "A": F.col("n_words") < 50,
        "B": 100 * F.col("n_distinct") < 65 * F.col("n_words"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, a boolean for each filter (true: the document fails it), good, toxic of every document."""
    text = F.coalesce("text", F.lit(""))
    whole = keyed(docs.select("doc_id", text.alias("text"), F.coalesce("source", F.lit("")).alias("part")))
    words = F.filter(F.split("text", BLANK), lambda w: w != "")
    counted = whole.withColumn("w", words).select("*", F.size("w").alias("n_words"), F.size(F.array_distinct("w")).alias("n_distinct"))
    measured = materialise(counted.select("doc_id", "part", *KEY, *[c.alias(k) for k, c in conditions(F.col("text")).items()]), "measured")
    firsts = measured.groupBy(*KEY).agg(F.min("doc_id").alias("least"), F.count("*").alias("m"))
    copied = join_unique(measured, firsts, KEY, measured.count()).withColumn("E", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)))
    one = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    said = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    # rows without an id meet no label: they don't go through the join by id
    named = copied.where("doc_id is not null").join(known, "doc_id", "left").select("part", *"ABCDE", said("quality", "good"), said("toxic", "toxic"))
    nameless = copied.where("doc_id is null").select("part", *"ABCDE", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    found = materialise(named.union(nameless), "verdicts")
    forget(docs.sparkSession, measured)
    return found


def edges(marked: DataFrame, filters: str) -> DataFrame:
    """part, state, filter, held, removed, good_lost, toxic_lost for each set of filters applied
    (``state``, bits in order of ``filters``) with survivors in the part and each filter after it.
    """
    spark = marked.sparkSession
    path = scratch(spark, "edges")
    bit = {f: 1 << k for k, f in enumerate(filters)}
    seen: set[int] = set()

    def visit(survivors: DataFrame, state: int) -> None:
        seen.add(state)
        left = [f for f in filters if not state & bit[f]]
        counts = [F.struct(F.count_if(F.col(f)).alias("removed"), F.count_if(F.col(f) & F.col("good")).alias("good_lost"), F.count_if(F.col(f) & F.col("toxic")).alias("toxic_lost"), F.lit(f).alias("filter")).alias(f) for f in left]
        at = survivors.groupBy("part").agg(F.count("*").alias("held"), *counts)
        at.select("part", F.lit(state).alias("state"), "held", F.inline(F.array(*left))).write.mode("append").parquet(path)
        for f in left:
            after = state | bit[f]
            if after in seen or after == (1 << len(filters)) - 1:  # nothing leaves the last state
                continue
            child = survivors.where(~F.col(f)).persist()
            visit(child, after)
            child.unpersist()

    start = marked.persist()
    visit(start, 0)
    start.unpersist()
    return spark.read.schema("part string, state int, held long, removed long, good_lost long, toxic_lost long, filter string").parquet(path)


def audit(docs: DataFrame, labels: DataFrame, filters: str = "ABCDE") -> DataFrame:
    """part, filter_order, step and the counts of each step of each order; zeros included.

    kept: documents left after the step. removed: by it. redundant: failing its filter but
    removed before. unique_fails: failing its filter alone (the edge after all others).
    good_lost, toxic_lost: of those removed, labelled so. shapley: its filter's removed over all orders.
    """
    marked = verdicts(docs, labels)
    found = materialise(edges(marked, filters), "trie")
    bit, size = {f: 1 << k for k, f in enumerate(filters)}, len(filters)
    every = (1 << size) - 1
    steps = []
    for order in itertools.permutations(filters):
        state = 0
        for k, f in enumerate(order):
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(f).alias("filter"), F.lit(state).alias("state")))
            state |= bit[f]
    parts = found.where("state = 0").select("part").distinct()
    fails = F.sum(F.when(F.col("state") == 0, F.col("removed"))).alias("fails")
    alone = F.sum(F.when(F.expr("bit_count(state)") == size - 1, F.col("removed"))).alias("alone")
    orders = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(size - 1 - k)) for k in range(size)]), F.expr("bit_count(state)") + 1)
    whole = found.groupBy("part", "filter").agg(fails, alone, F.sum(F.col("removed") * orders).alias("shapley"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    each = parts.select("part", F.inline(F.array(*steps))).join(found, ["part", "state", "filter"], "left").join(whole, ["part", "filter"])
    return each.select(
        "part", "filter_order", "step", (zero("held") - zero("removed")).alias("kept"), zero("removed").alias("removed"), (F.col("fails") - zero("removed")).alias("redundant"),
        zero("alone").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )
