"""Answers held against the passages they were given: support by sentence, citations.

Terms are the distinct index terms of a text. The support of a sentence by a passage is the share of the
sentence's terms that the passage has; sentences without terms count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import index_terms, sentences

#: A sentence is supported from this share of its terms on.
SUPPORTED = 0.5


def _terms(c: Column) -> Column:
    return F.array_distinct(index_terms(c))


def aligned(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, i, ref, support of each sentence of an answer (query_id, answer) that has terms: the passage (query_id,
    ref, text) that supports it best, of equal ones the first; ref null and support 0 where none has any of its terms.
    """
    said = answers.select("query_id", F.posexplode(sentences(F.coalesce("answer", F.lit("")))).alias("i", "s")).select("query_id", "i", _terms(F.col("s")).alias("terms")).where("size(terms) > 0")
    given = passages.select("query_id", "ref", _terms(F.col("text")).alias("held"))
    share = F.size(F.array_intersect("terms", "held")) / F.size("terms")
    both = said.join(given, "query_id", "left").withColumn("support", F.coalesce(share, F.lit(0.0)))
    best = F.max(F.when(F.col("support") > 0, F.struct("support", (-F.col("ref")).alias("back")))).alias("b")
    found = both.groupBy("query_id", "i").agg(best)
    return found.select("query_id", "i", (-F.col("b.back")).alias("ref"), F.coalesce("b.support", F.lit(0.0)).alias("support"))


def by_sentence(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, n_sentences, n_supported, faithfulness (mean support), relevancy (share of the question's terms that the answer
    has) of every answer (query_id, question, answer); 0 where there is nothing to count.
    """
    found = aligned(answers, passages).groupBy("query_id").agg(F.count("*").alias("n"), F.count_if(F.col("support") >= SUPPORTED).alias("good"), F.avg("support").alias("mean"))
    q, a = _terms(F.col("question")), _terms(F.col("answer"))
    own = answers.select("query_id", F.when(F.size(q) > 0, F.size(F.array_intersect(q, a)) / F.size(q)).otherwise(0.0).alias("relevancy"))
    none = F.lit(0).cast("long")
    return own.join(found, "query_id", "left").select("query_id", F.coalesce("n", none).alias("n_sentences"), F.coalesce("good", none).alias("n_supported"), F.coalesce("mean", F.lit(0.0)).alias("faithfulness"), "relevancy")


def averages(scores: DataFrame) -> DataFrame:
    """One row: cases and the mean of each score over the case set."""
    return scores.agg(F.count("*").alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("faithfulness", "relevancy")])


def escaped(c: Column) -> Column:
    """Text that markup shows as it is."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(mark), F.lit(name))
    return c


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """query_id, cited (numbers [n] of an answer that name a passage, ascending), dangling (numbers that don't), n_citations, n_unused
    (passages that none names) and shown (the answer as markup, its citations marked) of answers (query_id, answer) with passages (query_id, ref).

    Numbers beyond an int dangle with others as -1.
    """
    found = F.transform(F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit("\\[([0-9]+)\\]"), F.lit(1)), lambda n: F.coalesce(n.try_cast("int"), F.lit(-1)))
    given = passages.groupBy("query_id").agg(F.collect_set("ref").alias("refs"))
    both = answers.select("query_id", "answer", found.alias("n")).join(given, "query_id", "left").withColumn("refs", F.coalesce("refs", F.array().cast("array<int>")))
    shown = F.regexp_replace(escaped(F.coalesce("answer", F.lit(""))), "\\[([0-9]+)\\]", "<span class=\"ref\">[$1]</span>")
    return both.select(
        "query_id", F.sort_array(F.array_intersect("n", "refs")).alias("cited"), F.sort_array(F.array_except("n", "refs")).alias("dangling"),
        F.size("n").cast("long").alias("n_citations"), F.size(F.array_except("refs", "n")).cast("long").alias("n_unused"), shown.alias("shown"),
    )
