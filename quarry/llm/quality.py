"""Operator 4, quality rules: hashed n-gram log-likelihood ratio, after a few base rules.

Words are runs of other characters than blanks and line ends. The method compares
two multinomials over hashed n-grams, each word and each word with its follower (or
the text's end), one of trusted texts and one of the raw corpus: a text's score is the
mean log-ratio of its n-grams. It is kept from a threshold on, and every text is
decided. The threshold is calibrated on labelled rows that are left out of the trusted
counts. All of it is DataFrame expressions.

A word's hash names a block and one of 2^16 counters in it; its followers have 2^16
counters each. Blocks grow with the root of the input, as vocabularies do. Each
text's words are sorted and cut into pieces by block, so an exchange has four bytes a
word; a block is counted in PARTS parts, each by a task that sums the ratios up a text.
Ratios are whole multiples of 1 / UNIT, so equal runs give equal sums in any order.

Null and empty texts have no words, fail the base rules and have a null score.
Repeated rows are repeated in the result; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.keys import KEY, keyed
from quarry.storage import materialise

BLANKS = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[^#*$%&|<>]+"
WINDOW = 8
#: Least number of blocks, and the root of the characters that one block is taken for.
BLOCKS, MASS = 8, 2200
#: Parts of a block's counters that are counted by themselves, so that a task's sort stays small.
PARTS = 3
#: Occurrences that each counter starts with, in the corpus's share of trusted ones; parts that ratios are rounded to; ids of trusted rows that are broadcast at most.
PRIOR, UNIT = 4.0, 1 << 10
BROADCAST_ROWS = 2_000_000
#: Scores are multiples of 1 / PLACES.
PLACES = 1_000_000_000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def hashed_words(docs: DataFrame) -> DataFrame:
    """``docs`` with ``words`` and ``wh``, their hashes."""
    text = F.coalesce("text", F.lit(""))
    split = docs.withColumn("words", F.array_remove(F.split(text, BLANKS), ""))
    return split.withColumn("wh", F.transform("words", lambda w: F.xxhash64(w)))


def base_measures(docs: DataFrame) -> DataFrame:
    """``docs`` with the words' hashes ``wh`` and the columns of BASE."""
    wh = F.col("wh")
    text = F.coalesce("text", F.lit(""))
    out = hashed_words(docs).withColumn("n_words", F.size("words").cast("long"))
    out = out.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    out = out.withColumn("n_symbols", F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines", "words")
    out = out.withColumn("__h", wh)
    for k in (1, 2, 4):  # hashes of 2, 4 and 8 words, each of two of those before
        out = out.withColumn("__h", F.zip_with("__h", F.slice("__h", k + 1, F.size("__h")), lambda a, b: F.xxhash64(a, b)))
    out = out.withColumn("__h", F.when(F.col("n_words") >= WINDOW, F.slice("__h", 1, F.col("n_words").cast("int") - (WINDOW - 1))))
    repeats = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.arrays_zip(F.col("__h").alias("h"), F.sequence(F.lit(0), F.size("__h") - 1).alias("i"))
    out = out.withColumn("__s", F.when(repeats, F.sort_array(placed))).drop("__h")
    s, m = F.col("__s"), F.size("__s")
    twice = lambda j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["h"] == s[j]["h"])) | ((j < m - 1) & (s[F.least(j + 1, m - 1)]["h"] == s[j]["h"]))
    places = F.transform(F.filter(F.sequence(F.lit(0), m - 1), twice), lambda j: s[j]["i"])
    out = out.withColumn("__p", F.when(s.isNotNull(), F.sort_array(places))).drop("__s")
    p = F.col("__p")
    covered = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda n, j: n + F.when(j == 0, WINDOW).otherwise(F.least(F.lit(WINDOW), p[j] - p[F.greatest(j - 1, F.lit(0))])))
    return out.withColumn("n_repeat_words", F.when(p.isNotNull(), covered).otherwise(0).cast("long")).drop("__p")


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def ngrams(wh: Column, blocks: int) -> Column:
    """block << 32 | word's counter << 16 | follower's counter of each word, given the words' hashes; ascending."""
    low = F.lit((1 << 16) - 1)

    def one(word: Column, follower: Column) -> Column:
        block = F.shiftleft(F.shiftright(F.shiftrightunsigned(word, 32) * blocks, 32), 32)
        after = F.shiftrightunsigned(F.coalesce(follower, F.lit(0).cast("long")), 16).bitwiseAND(low)
        return F.coalesce(block.bitwiseOR(F.shiftleft(word.bitwiseAND(low), 16)).bitwiseOR(after), F.lit(0).cast("long"))  # never null: so sorted as longs

    return F.sort_array(F.zip_with(wh, F.slice(wh, 2, F.size(wh)), one))


def _sums(docs: DataFrame, blocks: int, share: float) -> DataFrame:
    """__even (key of each text with words), sum (of its n-grams' log-ratios, in UNITs, over all rows with it) from rows of text, __k1, t.

    ``share``: the part of the corpus that is trusted. The key is __k1 without its
    lowest bit, which carries ``t`` through the exchange.
    """
    key = F.col("__k1").bitwiseAND(F.lit(-2)).bitwiseOR(F.col("t").cast("long"))
    g = hashed_words(docs).select(key.alias("key"), ngrams(F.col("wh"), blocks).alias("g"))
    other = lambda x, i: (i == 0) | (F.shiftright(x, 32) != F.shiftright(F.col("g")[F.greatest(i - 1, F.lit(0))], 32))
    g = g.withColumn("first", F.transform(F.filter("g", other), lambda x: (F.array_position("g", x) - 1).cast("int")))  # where blocks begin
    low = lambda x: (x.bitwiseAND(F.lit((1 << 32) - 1)) - F.lit(1 << 31)).cast("int")
    block = lambda i: F.shiftright(F.col("g")[i], 32)
    size = lambda j: F.coalesce(F.get("first", j + 1), F.size("g")) - F.col("first")[j]
    piece = lambda x, j: F.struct(block(x).cast("int").alias("block"), F.transform(F.slice("g", x + 1, size(j)), low).alias("v"))
    pieces = g.select("key", F.explode_outer(F.transform("first", piece)).alias("p"))  # outer: no filter on the array is inferred, which would work it out twice
    dealt = pieces.where("p is not null").select("key", "p.block", "p.v").repartitionById(blocks, F.col("block"))
    each = dealt.select("key", "block", F.explode("v").alias("v"))
    trusted = F.sum(F.col("key").bitwiseAND(1))
    ratio = lambda t, n: F.round((F.log((t + PRIOR * share) / (n + PRIOR)) - math.log(share)) * UNIT).cast("long")
    # all read the one exchange by block: words are aggregated, as a frequent one would be a long window; pairs are sorted
    word = F.shiftright("v", 16).alias("word")
    w = Window.partitionBy("v", "block")

    def counted(part: DataFrame) -> DataFrame:
        words = part.groupBy("block", word).agg(ratio(trusted, F.count("*")).alias("of_word"))
        paired = part.select("key", "block", "v", ratio(trusted.over(w), F.count("*").over(w)).alias("of_pair"))
        return paired.select("key", "block", word, "of_pair").join(words.hint("shuffle_hash"), ["block", "word"]).select("key", (F.col("of_pair") + F.col("of_word")).alias("ratio"))

    cuts = [((1 << 16) * k // PARTS << 16) - (1 << 31) for k in range(PARTS + 1)]  # all of a word's in one part
    both = reduce(DataFrame.union, [counted(each.where(F.col("v").between(lo, hi - 1))) for lo, hi in zip(cuts, cuts[1:])])
    return both.groupBy(F.col("key").bitwiseAND(F.lit(-2)).alias("__even")).agg(F.sum("ratio").alias("sum"))


def _labelled(labels: DataFrame) -> DataFrame:
    """doc_id, trusted (label 1 or 0) of every labelled id."""
    return labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("trusted"))


def _sample(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` rows of doc_id, trusted (label 1 or 0), dealt by a hash of the id: the same ones in every run."""
    known = _labelled(labels)
    every = max(1, known.count() // rows)
    h = F.xxhash64("doc_id")
    return known.where(F.pmod(h, F.lit(every)) == 0).orderBy(h, "doc_id").limit(rows)  # of fewer than about 2 * rows


def _percentiles(rows: DataFrame, shares: list[float]) -> dict[tuple[int, bool], list[float]]:
    """Exact percentiles of ``v`` by trusted and calibrates, between neighbours by distance: ten bits a round, from counts alone."""
    wanted: dict[tuple, list[int]] = {}
    for shift in (20, 10, 0):
        above = sorted({cell for cell, _ in wanted.values()})
        some = rows if shift == 20 else rows.where(F.shiftright("v", shift + 10).isin(above))
        counts: dict[tuple, list] = {}
        for r in some.groupBy("trusted", "calibrates", F.shiftright("v", shift).alias("cell")).count().collect():
            counts.setdefault((r["trusted"], r["calibrates"]), []).append((r["cell"], r["count"]))
        if shift == 20:
            sizes = {g: sum(n for _, n in c) for g, c in counts.items()}
            wanted = {(g, k): [None, k] for g, n in sizes.items() for p in shares for k in {math.floor(p * (n - 1)), math.ceil(p * (n - 1))}}
        for (g, _), found in wanted.items():
            before, left = found
            for cell, n in sorted(c for c in counts[g] if before is None or c[0] >> 10 == before):
                if left < n:
                    found[:] = [cell, left]
                    break
                left -= n
    at = lambda g, x: wanted[g, x][0] / PLACES

    def one(g: tuple, place: float) -> float:
        lo, hi = math.floor(place), math.ceil(place)
        return at(g, lo) if lo == hi else (hi - place) * at(g, lo) + (place - lo) * at(g, hi)

    return {g: [one(g, p * (n - 1)) for p in shares] for g, n in sizes.items()}


def score(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None) -> tuple[DataFrame, float]:
    """doc_id, KEY, the BASE columns and ``score`` of every document; and the threshold.

    ``labels``: doc_id, quality; texts of quality 1 are trusted, all of them unless ``trusted_rows`` bounds the
    labelled rows; one in five calibrates the threshold and isn't counted as trusted. The raw counts are over all
    documents. Up to BROADCAST_ROWS trusted ids are broadcast to the texts, beyond that both are shuffled by id.
    """
    own = _labelled(labels) if trusted_rows is None else _sample(labels, trusted_rows)
    known = materialise(own.withColumn("calibrates", F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0), "labelled")
    counted = known.where("trusted = 1 and not calibrates").select("doc_id", F.lit(1).alias("t"))
    counted = F.broadcast(counted) if counted.count() <= BROADCAST_ROWS else counted.hint("merge")
    slim = keyed(docs.select("doc_id", "text"))
    marked = slim.join(counted, "doc_id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    chars = marked.agg(F.sum(F.length("text")).alias("all"), F.sum(F.length("text") * F.col("t")).alias("trusted")).first()
    mass, trusted = chars["all"] or 0, chars["trusted"] or 0
    blocks = max(BLOCKS, int(math.sqrt(mass) / MASS))
    sums = materialise(_sums(marked, blocks, max(trusted, 1) / max(mass, 1)), "ngram-sums")
    # written: a filter on the measures would be pushed below the join, and work their arrays out again for every word
    measures = materialise(base_measures(slim).select("doc_id", *KEY, *BASE), "measures")
    even = F.col("__k1").bitwiseAND(F.lit(-2))
    words = measures.groupBy(even.alias("__even")).agg(F.sum("n_words").alias("words"))
    means = sums.join(words.hint("merge"), "__even").select("__even", F.round(F.col("sum") / (2 * F.col("words") * UNIT), 9).alias("score"))
    scored = measures.join(means.hint("merge"), even == F.col("__even"), "left").drop("__even")

    learned = scored.where("score is not null").select("doc_id", F.round(F.col("score") * PLACES).cast("long").alias("v")).join(known, "doc_id")
    q = _percentiles(materialise(learned.select("trusted", "calibrates", "v"), "learned"), [0.005, 0.5])
    good, bad = (q.get((k, True), q.get((k, False))) for k in (1, 0))  # rows that were counted only where there are no others
    if not trusted or not good:
        threshold = float("-inf")
    else:  # nearly all trusted texts stay, and nothing that lies closer to the others' middle than to theirs
        threshold = round(min(good[0], (good[1] + bad[1]) / 2) if bad else good[0], 9)
    return scored, threshold


def judge(docs: DataFrame, labels: DataFrame, trusted_rows: int | None = None) -> DataFrame:
    """doc_id, KEY, BASE columns, score, base_failed, kept of every document."""
    scored, threshold = score(docs, labels, trusted_rows)
    judged = scored.withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.coalesce("score", F.lit(float("-inf"))) >= threshold))
