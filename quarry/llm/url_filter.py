"""Operator 3, URL filters: rules first, then a ratio of two character language models.

Two smoothed variable-order Markov models over bytes, one of accepted and one of
rejected URLs, are counted over every labelled URL. A URL's score is the difference of
its log-likelihoods divided by its length; it is allowed from a threshold on, which is
calibrated on labelled URLs that were left out of the counts.

A model of order k mixes with that of order k-1: p(c | context) = (n(context c) +
PRIOR p(c | shorter context)) / (n(context) + PRIOR), where n(context) counts what
follows the context, the padding before a URL included. Counts are exact and in tables:
a gram of ORDERS bytes is a long, shorter ones are its low bytes, and every distinct
gram's log-ratio is worked out once and joined to the URLs' grams. Grams that most
URLs have are broadcast, others shuffled; nothing of the model passes the driver.

Null URLs and URLs without ``://`` have an empty host and path; the models see
the whole URL, of any length; a null or empty one scores 0. Without labelled URLs of
both kinds all scores are 0 and the threshold is 0. Every row, repeated or with a null
page_id, gets the verdict of its URL; equal scores get equal verdicts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.batches import slices, texts
from quarry.llm.graph import join_unique
from quarry.storage import materialise

#: Bytes of the longest gram (seven at most fit a long); occurrences that each context starts with.
ORDERS = 5
PRIOR = 4.0
ALPHABET = 256
#: Parts of a log-ratio that sums are made of, so that they don't depend on their order; places that scores are rounded to.
UNIT, PLACES = 1 << 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule (host and path, such as ``net/``) that fits, or null.

    ``rules`` is a parameter of bounded size, tested in one expression, longest first.
    """
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(urls: DataFrame) -> DataFrame:
    """uh, y, g: the gram that ends at each byte and at the end of each URL, from rows of url, uh, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "url"):
            raw = [b"\x01" * (ORDERS - 1) + u.encode() + b"\x02" for u in texts(b, "url")]
            data = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            size = np.array([len(r) for r in raw], np.int64)
            within = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            at = np.flatnonzero(within >= ORDERS - 1)
            g = np.zeros(len(at), np.int64)
            for k in range(ORDERS):
                g |= data[at - k] << 8 * k
            edges = np.concatenate(([0], np.cumsum(size - (ORDERS - 1)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("uh"), b.column("y"), pa.ListArray.from_arrays(pa.array(edges), pa.array(g))], ["uh", "y", "g"])

    return urls.select("url", "uh", "y").mapInArrow(run, "uh long, y int, g array<long>").select("uh", "y", F.explode("g").alias("g"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """g, ratio (log-probability of its last byte after the others, accepted less rejected, in UNITs), m, from rows of g, n0, n1, m."""
    below = None
    for k in range(1, ORDERS + 1):
        key = F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1))
        own = counts.groupBy(key.alias("s")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("m").alias("m"))
        w = Window.partitionBy(F.shiftright("s", 8))  # 256 rows at most
        own = own.select("s", "m", *[F.col(f"n{y}") for y in (0, 1)], *[F.sum(f"n{y}").over(w).alias(f"c{y}") for y in (0, 1)])
        if below is None:
            shorter = own.select("*", *[F.lit(1.0 / ALPHABET).alias(f"q{y}") for y in (0, 1)])
        else:
            shorter = own.withColumn("t", F.col("s").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1))).join(below, "t").drop("t")
        p = [(F.col(f"n{y}") + PRIOR * F.col(f"q{y}")) / (F.col(f"c{y}") + PRIOR) for y in (0, 1)]
        found = shorter.select("s", "m", p[0].alias("p0"), p[1].alias("p1"))
        below = found.select(F.col("s").alias("t"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    return found.select(F.col("s").alias("g"), F.round((F.log("p1") - F.log("p0")) * UNIT).cast("long").alias("ratio"), "m")


def scores(labelled: DataFrame) -> DataFrame:
    """uh, score from rows of url, uh, y (1 accepted, 0 rejected, null where not counted), one a URL."""
    urls = materialise(labelled, "urls")
    each = grams(urls)
    counts = each.groupBy("g").agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), F.count("*").alias("m"))
    ratios = materialise(log_ratios(materialise(counts, "grams")), "ratios")
    total = urls.count()
    met = join_unique(each.select("uh", "g"), ratios, ["g"], total)
    return met.groupBy("uh").agg(F.round(F.sum("ratio") / UNIT / F.count("*"), PLACES).alias("score"))


def filter_urls(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """page_id, url, host, path, rule, score and verdict of every page.

    ``rules``: rule -> allow or block. URLs under a rule are the models' labels; one
    in five, by a hash of the URL, is kept for calibration: the threshold lies midway
    between the accepted ones' 5 % and the rejected ones' 95 % quantile.
    """
    url = F.col("url")
    parsed = pages.select("page_id", "url").withColumn("host", host(url)).withColumn("path", path(url))
    ruled = parsed.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("uh", F.xxhash64("url"))
    allowed = F.col("rule").isin([r for r, v in rules.items() if v == "allow"])
    calibrates = F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0
    some = ruled.where("url <> ''")
    found = some.groupBy("url", "uh").agg(F.first(allowed).cast("int").alias("label"), F.count("*").alias("m"))
    labelled = materialise(found.select("url", "uh", "label", calibrates.alias("calibrates"), "m"), "labelled")
    known = {r["label"] for r in labelled.where("label is not null and not calibrates").select("label").distinct().collect()}
    by_rule = F.when(allowed, "allow").when(F.col("rule").isNotNull(), "block")
    result = ["page_id", "url", "host", "path", "rule"]
    if known != {0, 1}:
        return ruled.select(*result, F.lit(0.0).alias("score"), F.coalesce(by_rule, F.lit("allow")).alias("verdict"))
    made = materialise(scores(labelled.select("url", "uh", F.when(~F.col("calibrates"), F.col("label")).alias("y"))), "scores")
    # rounded scores: their distinct values, which the quantiles are held in, are few at every size
    of_label = made.join(labelled.where("label is not null and calibrates").select("uh", "label"), "uh")
    q = {r["label"]: r["q"] for r in of_label.groupBy("label").agg(F.percentile("score", [0.05, 0.95]).alias("q")).collect()}
    threshold = round((q[1][0] + q[0][1]) / 2, PLACES + 1) if len(q) == 2 else 0.0
    scored = join_unique(some, made.join(labelled.select("uh", "m"), "uh"), ["uh"], some.count())
    both = scored.select(*result, "score").union(ruled.where("url is null or url = ''").select(*result, F.lit(0.0)))
    return both.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("score") >= threshold, "allow").otherwise("block")))
