"""Components of many texts of which few share a band: sets meet by band hash, in traffic that grows with the sets."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_duplicates as near


def chain(texts: int, seed: int) -> list[str]:
    """Windows over one long text: neighbours are tied, some of them linked; ends far apart have nothing in common."""
    r, at, out = random.Random(seed), 0, []
    words = [f"c{seed}x{k}" for k in range(12 * texts + 60)]
    for _ in range(texts):
        out.append(" ".join(words[at : at + 60]))
        at += r.choice([3, 5, 11, 12])
    return out


def links(texts: dict[int, str]) -> collections.Counter:
    """Links at 0.8 between different sets, by the n-grams they share."""
    posted, both = collections.defaultdict(list), collections.Counter()
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    for i, s in sets.items():
        for g in s:
            posted[g].append(i)
    for ids in posted.values():
        both.update((a, b) for a in ids for b in ids if a < b)
    return collections.Counter(i for p, n in both.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) for i in p)


@pytest.mark.parametrize("block", [near.BLOCK, 700])
def test_links_of_chains_and_a_group(spark, block):
    r, base = random.Random(5), [f"g{k}" for k in range(90)]
    group = [" ".join(w if r.random() > 0.01 else f"n{r.randrange(10**6)}" for w in base) for _ in range(80)]
    texts = dict(enumerate(sorted(set(chain(400, 1) + chain(150, 2) + group))))
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x["n_links"] for x in near.link_duplicates(rows, block=block).collect()}
    want = links(texts)
    assert got == {i: want[i] for i in texts}


def traffic(spark, texts: int, block: int) -> tuple[int, int]:
    """Rows that leave for meetings, and the components routed by band, for one chain."""
    rows = near.keyed(spark.createDataFrame(list(enumerate(chain(texts, 3))), "doc_id long, text string"))
    sig = near.signatures(rows, near.bands(), near.ROWS, near.NGRAM)
    copies = near.materialise(sig.withColumn("node", F.col("doc_id")), "copies")
    total = copies.agg(F.sum("n")).first()[0]
    members = copies.select("node", F.lit(0).cast("long").alias("comp"), F.lit(-(-total // block)).cast("int").alias("blocks"), "n", "r")
    sets = near.routed(members, copies, block, texts).withColumn("set", F.lit(b""))
    return near.dealt(sets).count(), sets.where("size(bands) > 0").select("comp").distinct().count()


def test_traffic_of_a_chain_grows_with_its_sets(spark):
    for texts in (200, 2000):
        n, by_band = traffic(spark, texts, 700)
        assert by_band == 1 and n <= texts * near.bands()
    assert traffic(spark, 200, near.BLOCK) == (200, 0)
