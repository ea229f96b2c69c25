"""Operator 2, n-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

Words are what stands between white space, in lower case; a text's n-grams are its
runs of five words (a shorter text is one n-gram). Two texts are linked when the
Jaccard similarity of their n-gram sets is 0.8 or more.

1. Each text becomes its set's hash and one hash per band; band and row numbers are
   chosen so that a pair at the threshold shares a band with probability ``RECALL``.
2. Texts with equal sets are one class of copies; one row, that with the least id,
   stands for all. Sets and rows are known by hashes of 128 bits, a row's over id and text, so
   ids may be null or repeated with other texts, and of any type that has an order.
3. Texts that share a band hash are tied to the least of them, in a star, never as
   all pairs; components of these ties hold every candidate pair.
4. Each component's sets meet in tasks of bounded size: a large one is dealt into
   blocks, and every two blocks meet once. Where that sends more n-grams than meeting by band
   hash does (a component of many texts of which few share a band), the sets of each band hash
   meet instead, and two sets are compared where they first share one. There a rarest-first
   prefix filter and a length filter leave the pairs to verify on the full sets. Only counts
   and a spanning tree of the links leave a task.
5. Components of the links are the classes.

Result: one row per document. Null ids are compared like others and come last in
order: a class has the id null only where no row of it has an id. Texts without words
(null, empty) are a class each, without links. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, texts
from quarry.llm.graph import components, join_unique
from quarry.llm.words import Words
from quarry.storage import materialise

NGRAM, THRESHOLD = 5, 0.8
RECALL, ROWS = 0.9999, 4
#: n-grams of the sets in one block; candidates (about 30 bytes each) that are broadcast to the texts at most.
BLOCK = 1 << 17
CANDIDATES = 2_000_000
#: What names a meeting of two parts: their component, the band and its hash (-1 and 0: the whole component), the parts.
MEETING = ["comp", "band", "h", "lo", "hi"]


def bands(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` minima each so that a pair at ``threshold`` shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(batch: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct n-grams of each text, and the n-grams' hashes, ascending in each text."""
    words = Words(batch, plain=True)
    if not len(words.hash):
        return np.zeros(len(batch), np.int64), np.zeros(0, np.uint64)
    count = np.bincount(words.text, minlength=len(batch))
    end = np.cumsum(count)[words.text]
    at = np.arange(len(end))
    begins = at == end - count[words.text]
    h = np.zeros(len(end), np.uint64)
    padded = np.concatenate((_mix(words.hash), np.zeros(n, np.uint64)))
    for k in range(n):
        h += np.where(at + k < end, padded[k : k + len(at)], np.uint64(0)) * np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64))
    keep = (at + n <= end) | begins & (count[words.text] < n)
    h, text = _mix(h[keep]), words.text[keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return np.bincount(text[fresh], minlength=len(batch)), h[fresh]


def row_key(columns: list[str]) -> Column:
    """A 128-bit hash of a row's ``columns``; null is a value of its own."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-"))
    sizes = [F.length(known(c)).cast("string") for c in columns]  # so that no two rows run together alike
    return F.unhex(F.md5(F.concat_ws(":", *sizes, *map(known, columns)).cast("binary")))


def keyed(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """doc_id, text, r: a hash of ``columns``, by which rows are known."""
    return docs.select("doc_id", "text", row_key(list(columns)).alias("r"))


def signatures(docs: DataFrame, n_bands: int, rows: int, n: int) -> DataFrame:
    """doc_id, r, n (its n-grams), k1, k2 (two hashes of the set) and its bands' hashes; no bands without words."""
    rng = np.random.Generator(np.random.PCG64(11))
    xor, times = rng.integers(0, 1 << 63, (2, n_bands * rows), dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            size, h = shingles(texts(b), n)
            some = np.flatnonzero(size)
            start = (np.cumsum(size) - size)[some]
            out = np.zeros((n_bands, len(some)), np.uint64)
            keys = np.zeros((2, len(size)), np.int64)
            if len(some):
                for k in range(n_bands * rows):
                    least = np.minimum.reduceat((h ^ xor[k]) * times[k], start)
                    out[k // rows] = _mix(out[k // rows] + least + np.uint64(1))
                keys[0, some] = np.add.reduceat(_mix(h), start).view(np.int64)
                keys[1, some] = np.add.reduceat(_mix(h + np.uint64(77)), start).view(np.int64)
            edges = np.concatenate(([0], np.cumsum(np.where(size > 0, n_bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(out.T).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("r"), pa.array(size.astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), lists], ["doc_id", "r", "n", "k1", "k2", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, r binary, n long, k1 long, k2 long, bands array<long>")


class Block:
    """Sets that meet in one task."""

    def __init__(self) -> None:
        self.ids: list[int] = []
        self.side: list[int] = []
        self.seen: list[list[int]] = []
        self.sets: list[np.ndarray] = []

    def links(self, threshold: float, own: bool) -> list[tuple[int, int, int]]:
        """(id, links found here, root of its links) of each set that has a link; ``own``: one block by itself.

        Two sets that have a hash of ``seen`` in common at the same place are compared elsewhere.
        """
        order = sorted(range(len(self.sets)), key=lambda i: (len(self.sets[i]), self.ids[i]))
        size = np.array([len(self.sets[i]) for i in order])
        side = np.array(self.side)[order]
        seen = np.array(self.seen, np.int64).reshape(len(size), -1)[order]
        found, which, count = np.unique(np.concatenate([self.sets[i] for i in order]), return_inverse=True, return_counts=True)
        rank = np.empty(len(found), np.int64)
        rank[np.lexsort((found, count))] = np.arange(len(found))
        begin, owner = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        flat = rank[which]
        flat = flat[np.lexsort((flat, owner))]  # each set by rank, small sets first
        # the sets of each n-gram that lie before a set in this order are a stretch of ``posted``
        prefix = np.arange(len(flat)) - begin[owner] <= (size - np.ceil(threshold * size - 1e-9).astype(np.int64))[owner]
        prefix &= count[np.argsort(rank)][flat] > 1
        entry = np.flatnonzero(prefix)
        by_gram = entry[np.argsort(flat[entry], kind="stable")]
        posted, gram = owner[by_gram], flat[by_gram]
        place = np.zeros(len(flat), np.int64)
        place[by_gram] = np.arange(len(by_gram))
        first = np.searchsorted(gram, np.arange(len(found)))
        edge = np.searchsorted(entry, np.append(begin, len(flat)))
        links, parent = np.zeros(len(size), np.int64), list(range(len(size)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        mark, near = np.zeros(len(found), bool), np.zeros(len(size), bool)
        for x in range(1, len(size)):
            own_entries = entry[edge[x] : edge[x + 1]]
            for lo, hi in zip(first[flat[own_entries]].tolist(), place[own_entries].tolist()):
                near[posted[lo:hi]] = True
            cand = np.flatnonzero(near[:x])
            near[:x] = False
            cand = cand[(size[cand] >= threshold * size[x] - 1e-9) & (own | (side[cand] != side[x]))]
            cand = cand[~(seen[cand] == seen[x]).any(axis=1)]
            if not len(cand):
                continue
            mine = flat[begin[x] : begin[x] + size[x]]
            mark[mine] = True
            lo, each = int(cand[0]), size[cand]
            if 4 * each.sum() > begin[x] - begin[lo]:  # one pass over all sets from the first candidate on
                both = np.add.reduceat(mark[flat[begin[lo] : begin[x]]].astype(np.int64), begin[lo:x] - begin[lo])[cand - lo]
            else:
                both = np.add.reduceat(mark[np.concatenate([flat[begin[y] : begin[y] + size[y]] for y in cand])].astype(np.int64), np.cumsum(each) - each)
            mark[mine] = False
            good = cand[both >= threshold * (each + size[x] - both) - 1e-9]
            links[x] += len(good)
            links[good] += 1
            for y in good.tolist():
                a, b = root(x), root(y)
                if a != b:
                    parent[max(a, b, key=lambda i: self.ids[order[i]])] = min(a, b, key=lambda i: self.ids[order[i]])
        return [(self.ids[order[i]], int(links[i]), self.ids[order[root(i)]]) for i in np.flatnonzero(links).tolist()]


def verify(sets: DataFrame, threshold: float) -> DataFrame:
    """node, links, root from rows of MEETING, side, seen, node, set that are together and in order of MEETING."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block = None, Block()

        def done() -> pa.RecordBatch:
            out = block.links(threshold, key[3] == key[4]) if len(block.ids) > 1 else []
            cols = list(zip(*out)) or [[], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["node", "links", "root"])

        for b in batches:
            for *now, side, seen, node, raw in zip(*(b.column(c).to_pylist() for c in (*MEETING, "side", "seen", "node", "set"))):
                if tuple(now) != key:
                    if key:
                        yield done()
                    key, block = tuple(now), Block()
                if block.ids and block.ids[-1] == node:  # a repeated row
                    continue
                block.ids.append(node)
                block.side.append(side)
                block.seen.append(seen)
                block.sets.append(np.frombuffer(raw, np.uint64))
        if key:
            yield done()

    return sets.mapInArrow(run, "node long, links long, root long")


def routed(members: DataFrame, copies: DataFrame, block: int, total: int) -> DataFrame:
    """node, comp, r of ``members`` with meets, the places (band, h, parts) where each set meets others, and bands.

    A component of ``blocks`` blocks sends each of its sets to all of them, as one place of so many parts
    (band -1), unless its band hashes, each dealt into blocks of its own, take fewer n-grams in all.
    """
    whole = members.select("node", "comp", "r", F.expr("array(struct(-1 as band, 0L as h, blocks as parts))").alias("meets"), F.expr("cast(array() as array<bigint>)").alias("bands"))
    many = members.where("blocks > 1").join(copies.select("node", "bands"), "node")
    spread = many.select("node", "comp", "n", F.posexplode("bands").alias("band", "h"))
    places = spread.groupBy("comp", "band", "h").agg(F.sum("n").alias("w"), F.count("*").alias("m")).where("m > 1")
    places = materialise(places.withColumn("parts", F.ceil(F.col("w") / block).cast("int")), "places")
    cost = places.groupBy("comp").agg(F.sum(F.col("w") * F.col("parts")).alias("cost"))
    chosen = many.groupBy("comp").agg(F.sum(F.col("n") * F.col("blocks")).alias("all"), F.count("*").alias("m")).join(cost, "comp").where("cost < all")
    chosen = materialise(chosen.select("comp", "m"), "chosen")
    if chosen.isEmpty():
        return whole
    theirs = materialise(join_unique(many, chosen, ["comp"], total).select("node", "comp", "r", "bands"), "theirs")
    at = theirs.select("node", "comp", F.posexplode("bands").alias("band", "h"))
    met = join_unique(at, places.drop("w"), ["comp", "band", "h"], total)
    meets = met.groupBy("node").agg(F.collect_list(F.struct("band", "h", "parts")).alias("meets"))  # one a band at most
    return whole.join(theirs, "node", "left_anti").unionByName(theirs.join(meets, "node"))


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """node, comp, meets, bands, set (ascending hashes) of rows of node, comp, meets, bands, text."""
    columns = ["node", "comp", "meets", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes = b.column("node").to_numpy()
            b = b.take(pa.array(np.sort(np.unique(nodes, return_index=True)[1])))  # a row that is repeated many times is one set
            size, h = shingles(texts(b), n)
            stop = (8 * np.cumsum(size)).tolist()
            raw = h.tobytes()
            made = [raw[lo:hi] for lo, hi in zip([0, *stop], stop)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(made, pa.binary())], [*columns, "set"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, "text").mapInArrow(run, f"{kinds}, set binary")


def dealt(sets: DataFrame) -> DataFrame:
    """A row of MEETING, side, seen, node, set for each meeting of parts that a set takes part in."""
    placed = sets.select("node", "comp", "bands", "set", F.inline("meets"))
    placed = placed.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    seen = F.slice("bands", 1, F.greatest(F.col("band"), F.lit(0))).alias("seen")
    return placed.select("comp", "band", "h", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", seen, "node", "set")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows of ``keyed`` documents; and of every set k1, k2, n_copies, n_links, and
    own and whole: (unnamed, doc_id, r) of the row that stands for the set and for its linked class.
    """
    sig = materialise(signatures(docs, bands(threshold, recall, rows), rows, n), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "r")
    copies = sig.where("n > 0").groupBy("k1", "k2").agg(F.min(row).alias("own"), F.first("n").alias("n"), F.count("*").alias("n_copies"), F.first("bands").alias("bands"))
    copies = materialise(copies.withColumn("node", F.monotonically_increasing_id()), "copies")  # written once, so ids stay
    banded = copies.select("node", F.posexplode("bands").alias("band", "h"))
    met = banded.groupBy("band", "h").agg(F.min("node").alias("least"), F.count("*").alias("m")).where("m > 1")
    total = copies.count()
    ties = join_unique(banded, met, ["band", "h"], total).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    members = components(ties).select("node", F.col("label").alias("comp"))
    sized = members.join(copies.select("node", "n", "own.r"), "node")
    blocks = sized.groupBy("comp").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"), F.count("*").alias("m"))
    members = materialise(join_unique(sized, blocks, ["comp"], total).select("node", "comp", "blocks", "n", "r"), "members")
    members = routed(members, copies, block, total)
    # texts stay where they are while the candidates are few enough; beyond, both sides are shuffled by row
    sets = sets_of(docs.select("r", "text").join(F.broadcast(members) if members.count() <= CANDIDATES else members, "r"), n)
    together = dealt(sets).repartition(*MEETING).sortWithinPartitions(*MEETING, "node")
    links = materialise(verify(together, threshold), "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).join(copies.select("node", "own"), "node")
    firsts = labels.groupBy("label").agg(F.min("own").alias("whole"), F.count("*").alias("m"))
    labelled = join_unique(labels, firsts, ["label"], total).select("node", "whole")
    counted = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    described = copies.join(labelled, "node", "left").join(counted, "node", "left")
    none = F.lit(0).cast("long")
    return sig, described.select("k1", "k2", "n_copies", F.coalesce("n_links", none).alias("n_links"), "own", F.coalesce("whole", "own").alias("whole"))


def link_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """doc_id, copy_id (least id with an equal set), class_id (least id of its linked class),
    n_copies and n_links (linked texts with another set) of every document.

    The pairs between representatives aren't listed; n_links counts them in full.
    """
    sig, sets = classes(keyed(docs), threshold, n, recall, rows, block)
    sets = materialise(sets.select("k1", "k2", F.col("own.doc_id").alias("copy_id"), F.col("whole.doc_id").alias("class_id"), "n_copies", "n_links", F.col("n_copies").alias("m")), "sets")
    worded = join_unique(sig.where("n > 0"), sets, ["k1", "k2"], sig.count()).select("doc_id", "copy_id", "class_id", "n_copies", "n_links")
    own, one, none = F.col("doc_id"), F.lit(1).cast("long"), F.lit(0).cast("long")
    return worded.union(sig.where("n = 0").select("doc_id", own.alias("copy_id"), own.alias("class_id"), one, none))


def representatives(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of the row of ``docs`` with the least doc_id of each class, null ids last, of equal ids that
    with the least hash; rows that are equal in all columns are one. Texts without words stay.
    """
    own = next(n for k in range(len(columns) + 1) if (n := "__r" + "_" * k) not in columns)
    marked = docs.withColumn(own, row_key(columns))
    sig, sets = classes(keyed(docs, tuple(columns)))
    stay = materialise(sets.select(F.col("whole.r").alias(own)).union(sig.where("n = 0").select("r")).distinct(), "representatives")
    return marked.join(stay, own, "left_semi").dropDuplicates([own]).select(*[F.col(f"`{c}`") for c in columns])
