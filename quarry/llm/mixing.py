"""Operator 13, mixing sources to target weights [native]: a low-discrepancy source schedule.

Each source has a target, its share of the mix by weight, at most ``MOST`` times its own
words (the excess is shared among the others again). The mix is a sequence of slots, each
of one block of ``BLOCK`` words:

1. Slot k has the point frac((k + 1) golden ratio). A source owns an interval of the unit
   line in proportion to the blocks it needs, and with that the slots whose points fall in it,
   spread evenly over the mix. Points meet the intervals by equal cells of the line.
2. Slots are ranked within their source: counted by stretches of the sequence, so that a
   source with most of the slots is ranked in many tasks. Slots are laid out until every
   source has all it needs; those beyond its need are left out.
3. A source's documents are shuffled by hash and joined to one circle of words, which blocks
   cut from its start on: the block of rank r is words r BLOCK to (r + 1) BLOCK, the last
   one is cut at the target. At most ``MOST`` turns are taken, so no document is repeated more often.
4. Pieces of documents meet slots on source and rank.

Sources are in order of code points, null last, with the weights ``WEIGHTS`` in turn. Sizes
are numbers of words (null text: 0). Ties in the shuffle are rows with equal id and text of
one source, which are alike. Documents of no words take no part and have 0 words taken; a table
without words has targets of 0, an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.graph import join_unique
from quarry.storage import forget, materialise

BLANK_FREE = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, BLOCK = (5, 2, 1), 1.5, 2, 1024
#: Rows of a table that is broadcast at most. Parts of a circle and stretches of the sequence are as many as each holds rows: both grow with the root of the input.
SMALL = 200_000
#: The golden ratio's fraction, and that of its multiples by 2^12 and 2^24.
GOLDEN = (0.6180339887498949, 0.46721791956929826, 0.7245985558456156)


def _small(df: DataFrame) -> DataFrame:
    """A written table, broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source; sorts by code point, null last), size, shuffle of every document."""
    key = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    return docs.select("doc_id", key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(BLANK_FREE)), F.lit(0)).cast("long").alias("size"), mark.alias("shuffle"))


def _before(rows: DataFrame, pid: str, order: str, value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over those before, in order of ``pid`` and in each of ``order``."""
    totals = rows.groupBy(pid).agg(F.sum(value).alias("__t"))
    lead = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    ahead = totals.select(pid, F.coalesce(F.sum("__t").over(lead), F.lit(0)).alias("__ahead"))
    within = Window.partitionBy(pid).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    held = rows.withColumn("__own", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return held.join(F.broadcast(ahead), pid).withColumn(name, F.col("__ahead") + F.col("__own")).drop("__ahead", "__own")


def targets(found: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """key, pid, m (documents), source_size, target, words (the target in whole words) of every source of ``measured`` documents.

    The level, words of target a unit of weight, rises until no source above its bound is left: a few passes over the sources.
    """
    sums = materialise(found.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("m")), "sources")
    sorted_ = materialise(sums.repartitionByRange("key").sortWithinPartitions("key").withColumn("pid", F.spark_partition_id()), "sorted")
    ranked = _before(sorted_, "pid", "key", F.lit(1), "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    own = materialise(ranked.withColumn("weight", weight).withColumn("bound", most * F.col("source_size")), "weighed")
    level, before, total = 0.0, None, None
    while before is None or level != before:
        full = F.col("bound") <= level * F.col("weight")
        r = own.agg(F.sum("source_size"), F.sum(F.when(full, F.col("bound")).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        total = share * (r[0] or 0)
        before, level = level, max(level, (total - r[1]) / r[2]) if r[2] else level
    target = F.least(F.col("bound").cast("double"), F.lit(level) * F.col("weight"))
    return own.select("key", "pid", "m", "source_size", target.alias("target"), F.least("bound", F.round(target).cast("long")).alias("words"))


def _point(k: Column) -> Column:
    """frac((k + 1) golden ratio), by three digits of twelve bits so that large k stay exact enough."""
    n, low = k + 1, 4095
    digits = (n.bitwiseAND(low), F.shiftright(n, 12).bitwiseAND(low), F.shiftright(n, 24))
    return sum((d * g % 1.0 for d, g in zip(digits, GOLDEN)), F.lit(0.0)) % 1.0


def schedule(needs: DataFrame) -> DataFrame:
    """slot, key, rank: the slots of each source (key, pid, blocks), ``blocks`` of each."""
    spark = needs.sparkSession
    some = materialise(_before(needs.where("blocks > 0"), "pid", "key", F.col("blocks"), "first"), "intervals")
    total, n = some.agg(F.sum("blocks"), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], f"slot long, key {needs.schema['key'].dataType.simpleString()}, rank long")
    wide, stretch = -(-total // max(1024, 4 * n)), math.isqrt(total) + 1
    cells = some.select("key", "first", "blocks", F.explode(F.sequence(F.floor(F.col("first") / wide), F.floor((F.col("first") + F.col("blocks") - 1) / wide))).alias("cell"))
    cells = _small(materialise(cells, "cells"))
    need = _small(materialise(some.select("key", "blocks"), "need"))
    spare = 64 + 4 * n
    while True:
        slots = spark.range(total + spare).select(F.col("id").alias("slot"), F.least(F.floor(_point(F.col("id")) * total), F.lit(total - 1)).alias("at"))
        placed = slots.withColumn("cell", F.floor(F.col("at") / wide)).join(cells, "cell").where("at >= first and at < first + blocks")
        placed = placed.select("slot", "key", F.floor(F.col("slot") / stretch).alias("stretch"))
        counts = materialise(placed.groupBy("key", "stretch").agg(F.count("*").alias("n")), "stretches")
        short = need.join(counts.groupBy("key").agg(F.sum("n").alias("got")), "key", "left").where(F.coalesce("got", F.lit(0)) < F.col("blocks"))
        if short.isEmpty():
            break
        forget(spark, counts)
        spare *= 4
    lead = Window.partitionBy("key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("key", "stretch", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("ahead"))
    within = F.row_number().over(Window.partitionBy("key", "stretch").orderBy("slot"))
    ranked = placed.withColumn("own", within).join(ahead, ["key", "stretch"]).withColumn("rank", F.col("ahead") + F.col("own") - 1)
    return ranked.join(need, "key").where("rank < blocks").select("slot", "key", "rank")


def placed(found: DataFrame, sources: DataFrame) -> DataFrame:
    """``measured`` documents with source_size, target, words of their source and their begin on its circle."""
    total = found.count()
    parts = F.ceil(F.sqrt("m")).cast("long")
    sized = materialise(sources.select("key", "source_size", "target", "words", "m", parts.alias("parts")), "sized")
    # the shuffle's first 32 bits say the part, so that parts are in its order
    joined = join_unique(found, sized, ["key"], total)
    part = F.floor(F.conv(F.substring("shuffle", 1, 8), 16, 10).cast("long") * F.col("parts") / 4294967296).alias("part")
    dealt = materialise(joined.select("*", part), "dealt")
    sums = dealt.groupBy("key", "part").agg(F.sum("size").alias("n"))
    lead = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("key", "part", F.coalesce(F.sum("n").over(lead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("key", "part").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return own.join(ahead, ["key", "part"]).select("doc_id", "key", "size", "source_size", "target", "words", (F.col("ahead") + F.col("own")).alias("begin"))


def pieces(docs: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The mix with the documents that it leaves out: a row for each piece of a document in a block, its ``slot`` and ``offset``
    in it, its begin (``start``) and ``length`` in words of the document; slot null and length 0 for a document that isn't taken.
    """
    found = materialise(measured(docs), "measured")
    sources = materialise(targets(found, most=most), "targets")
    own = placed(found, sources)

    def turn(lo: Column) -> Column:
        """Pieces by block of the words from ``lo`` on that lie before the target."""
        hi = F.least(lo + F.col("size"), F.col("words"))
        ranks = F.sequence(F.floor(lo / block), F.floor((hi - 1) / block))
        cut = F.transform(ranks, lambda r: F.struct(r.alias("rank"), F.greatest(lo, r * block).alias("at"), F.least(hi, (r + 1) * block).alias("end"), lo.alias("lo")))
        return F.when(hi > lo, cut).otherwise(F.array().cast("array<struct<rank:bigint,at:bigint,end:bigint,lo:bigint>>"))

    turns = [turn(F.col("begin") + k * F.col("source_size")) for k in range(most)]
    each = own.withColumn("p", F.explode_outer(F.concat(*turns)))
    # a document that isn't taken has a rank of its own below 0, which no slot has: so they are dealt evenly
    cut = each.select("doc_id", "key", "size", "source_size", "target", "begin", F.coalesce("p.rank", -1 - F.col("begin")).alias("rank"), (F.col("p.at") - F.col("p.lo")).alias("start"), F.coalesce(F.col("p.end") - F.col("p.at"), F.lit(0)).alias("length"), F.pmod("p.at", F.lit(block)).alias("offset"))
    slots = materialise(schedule(sources.select("key", "pid", F.ceil(F.col("words") / block).cast("long").alias("blocks"))), "slots")
    return cut.join(slots, ["key", "rank"], "left")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken (words that the mix takes of it) of every document."""
    rows = pieces(docs, block)
    taken = F.sum(F.when(F.col("slot").isNotNull(), F.col("length")).otherwise(0)).alias("taken")
    worded = rows.where("size > 0").groupBy("key", "begin", "doc_id", "size", "source_size", "target").agg(taken)
    wordless = rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return worded.select("doc_id", "size", "source_size", "target", "taken").unionAll(wordless)
