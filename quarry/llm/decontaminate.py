"""Operator 7, benchmark decontamination: a prefix-filtered set join of word windows.

Words: A-Z in lower case, then runs of digits, letters and characters beyond ASCII.
A window is ten words in a row of a benchmark item; an item of fewer is one window.

A window can only occur where its rarest word does, so that word alone (the prefix
of a containment join at 1.0) is joined: words are ordered by how often they occur
in all documents. Neighbouring windows share their rarest word, so an item is a few
anchors, each with the range of windows that rest on it and the words of these alone
(2 * window - 1 at most), so anchors grow in proportion to the items. Words of
documents meet the anchors in a broadcast join while these are ``BOUND`` bytes at
most; beyond, both sides are shuffled by word, a document's word with the words
around it. Either way documents are read once. Position bounds (the window must begin
and end inside the text) and one neighbouring word are tested in the join itself; the
windows left are compared word by word. An item of any length is taken whole.

Null texts have no words; null items have no windows. Every row is decided by its
own text: rows are merged only where id and text are equal, and counted. Rows that
share an item_id are one item. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.keys import KEY, keyed
from quarry.storage import materialise

WINDOW = 10
#: Bytes that one broadcast holds at most, as estimated; rows with equal id and text that one task repeats.
BOUND = 64 << 20
REPEATS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    # lower() gives the same as translate() for ASCII, and is faster
    low = F.when(text.rlike("[^\\x00-\\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _fits(table: DataFrame, size: Column, bound: int) -> bool:
    """Whether a table's estimated bytes are ``bound`` at most; ``size``: bytes of a row's strings and 16 for each."""
    return (table.agg(F.sum(size + 64)).first()[0] or 0) <= bound


def anchors(docs: DataFrame, items: DataFrame, window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """item_id, word, o (its place in the item), lo, hi (first and last window start that rest on it), k (words of a window), iw (the item's words from lo to the last window's end)."""
    listed = items.select("item_id", words(F.col("text")).alias("iw")).where(F.size("iw") > 0).withColumn("row", F.monotonically_increasing_id())
    listed = materialise(listed.withColumn("k", F.least(F.lit(window), F.size("iw"))), "items")
    vocabulary = listed.select(F.explode("iw").alias("word")).distinct()
    if _fits(vocabulary, F.octet_length("word") + 16, bound):
        vocabulary = F.broadcast(vocabulary)
    # outer: no filter on the array's size is inferred, which would split every text twice
    seen = docs.select(F.explode_outer(words(F.col("text"))).alias("word")).join(vocabulary, "word")
    counts = seen.groupBy("word").agg(F.count("*").alias("n"))
    placed = listed.select("row", "k", F.size("iw").alias("m"), F.posexplode("iw").alias("o", "word")).join(counts, "word", "left")
    starts = F.sequence(F.greatest(F.lit(0), F.col("o") - F.col("k") + 1), F.least(F.col("o"), F.col("m") - F.col("k")))
    resting = placed.select("row", F.explode(starts).alias("s"), F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "o").alias("key"))
    rarest = resting.groupBy("row", "s").agg(F.min("key").alias("key"))
    spans = rarest.groupBy("row", F.col("key.o").alias("o"), F.col("key.word").alias("word")).agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    reach = F.slice("iw", F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("k"))
    return materialise(spans.join(listed, "row").select("item_id", "word", "o", "lo", "hi", "k", reach.alias("iw")), "anchors")


def occurrences(docs: DataFrame, found: DataFrame, window: int, bound: int) -> DataFrame:
    """doc_id, KEY, item_id, spans (start and end of each occurring window, may be none).

    Empty spans aren't filtered here: Catalyst would move that test into the join, which
    then leaves generated code and copies a whole text for every word.
    """
    p, o, w, iw = F.col("p"), F.col("o"), F.col("w"), F.col("iw")
    each = docs.select("doc_id", *KEY, words(F.col("text")).alias("w")).select("doc_id", *KEY, "w", F.size("w").alias("m"), F.lit(0).alias("begin"), F.posexplode_outer("w").alias("p", "word"))
    size = F.octet_length(F.array_join("iw", "")) + 16 * F.size("iw") + F.octet_length("word") + 16
    if _fits(found, size, bound):
        found = F.broadcast(found)
    else:  # a word goes through the exchange with those around it that a window can reach
        asked = found.select("word").distinct()
        asked = F.broadcast(asked) if _fits(asked, F.octet_length("word") + 16, bound) else asked
        begin = F.greatest(F.lit(0), p - window + 1)
        each = each.join(asked, "word").select("doc_id", *KEY, F.slice(w, begin + 1, F.least(F.col("m"), p + window) - begin).alias("w"), "m", begin.alias("begin"), "p", "word")
    at = p - F.col("begin")
    in_item = o - F.col("lo")
    beside = (F.get(w, at - 1) == F.get(iw, in_item - 1)) | (F.get(w, at + 1) == F.get(iw, in_item + 1)) | (F.col("k") == 1)
    first = F.greatest(F.col("lo"), o - p)  # the window begins in the text
    last = F.least(F.col("hi"), F.col("m") - F.col("k") - p + o)  # and ends there
    met = each.join(found, "word").where(beside & (first <= last))
    more = last - first
    small = met.select(
        "doc_id", *KEY, "item_id", "k", (p - o + first).alias("at"), more.alias("more"),
        F.slice(w, at - o + first + 1, more + F.col("k")).alias("a"), F.slice(iw, first - F.col("lo") + 1, more + F.col("k")).alias("b"),
    )
    # "a" and "b" are used twice, so that Catalyst keeps cutting them out in the join's generated code: rows that leave it hold no whole text
    same = small.withColumn("eq", F.when(F.size("a") == F.size("b"), F.zip_with("a", "b", lambda x, y: x == y)))
    whole = F.filter(F.sequence(F.lit(0), F.col("more")), lambda j: F.forall(F.slice(F.col("eq"), j + 1, F.col("k")), lambda x: x))
    spans = F.transform(whole, lambda j: F.struct((F.col("at") + j).alias("start"), (F.col("at") + j + F.col("k")).alias("end")))
    return same.select("doc_id", *KEY, "item_id", spans.alias("spans"))


def decide(docs: DataFrame, items: DataFrame, window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """doc_id, KEY, copies (rows with this id and text), n_words, n_hit (words inside occurring windows), spans (where), items (ascending as strings) of every id and text."""
    docs = keyed(docs.select("doc_id", "text"))
    hits = occurrences(docs, anchors(docs, items, window, bound), window, bound)
    kind = "array<struct<start:int,end:int>>"
    none = docs.select("doc_id", *KEY, F.lit(1).cast("long").alias("copies"), F.size(words(F.col("text"))).cast("long").alias("n_words"), F.lit(None).cast("string").alias("item"), F.lit(None).cast(kind).alias("spans"))
    both = none.union(hits.select("doc_id", *KEY, F.lit(0).cast("long"), F.lit(0).cast("long"), F.when(F.size("spans") > 0, F.col("item_id").cast("string")), F.col("spans").cast(kind)))
    merged = both.groupBy("doc_id", *KEY).agg(F.sum("copies").alias("copies"), F.max("n_words").alias("n_words"), F.collect_set("item").alias("items"), F.flatten(F.collect_set("spans")).alias("spans"))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, x: F.struct(F.greatest(a["end"], x["end"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(a["end"], x["start"]))).alias("n"))
    sorted_spans = F.array_sort("spans")
    return merged.select("doc_id", *KEY, "copies", "n_words", F.aggregate(sorted_spans, start, step, lambda a: a["n"]).cast("long").alias("n_hit"), sorted_spans.alias("spans"), F.sort_array("items").alias("items"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, bound: int = BOUND) -> DataFrame:
    """doc_id, n_words, n_hit, spans, items of every row of ``docs``, as in ``decide``."""
    found = materialise(decide(docs, items, window, bound).select("doc_id", "n_words", "n_hit", "spans", "items", "copies"), "decided")
    result = ["doc_id", "n_words", "n_hit", "spans", "items"]
    # one for each REPEATS rows of an id and text; these are dealt to tasks where they are many
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / REPEATS))).alias("part")
    often = found.where(F.col("copies") > REPEATS).select(*result, "copies", part)
    dealt = often.repartition(F.col("part"), F.xxhash64("n_words"))
    rest = F.least(F.lit(REPEATS).cast("long"), F.col("copies") - F.col("part") * REPEATS)
    few = found.where(F.col("copies") <= REPEATS)
    again = lambda rows, n: rows.select(*result, F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("__copy")).drop("__copy")
    return again(few, F.col("copies")).union(again(dealt, rest))
