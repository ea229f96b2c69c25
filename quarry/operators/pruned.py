"""Exact top k with blocks of chunks that are skipped: by angle for vectors, by largest weight for terms.

Both searches go in two rounds. Each block of chunks has an upper bound for each query.
The blocks with the best bounds are read first and give each query's k-th score so far;
then those of the others whose bound reaches that score. A block is read for a
query or skipped as a whole; what is skipped can't hold one of the first k.

* Vectors: blocks are rings around pivots. A chunk's angle to its nearest pivot says its ring;
  by the triangle inequality no chunk of a ring is nearer to a query than the difference
  of the query's angle to the pivot and the ring's angles. Large rings are dealt into blocks.
* Terms: postings of the queries' terms are in blocks of chunks, each with its largest term frequency and least length for
  each term, which bound what the term can add there. A block's postings are one group, so no task holds a common term's whole list.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import index_terms
from quarry.operators import retrieval
from quarry.storage import materialise

#: Pivots at most, rings of a half circle, chunks of a block; full blocks at most, beyond which blocks grow; chunks that the first round reads for a query, as a multiple of k; what sums in another order may differ by.
PIVOTS, RINGS, BLOCK, BLOCKS, AHEAD, SLACK = 1024, 64, 512, 250_000, 8, 1e-8
#: Chunks and queries that a task of the second round holds, and bounds or scores that it works out at a time.
GROUP, ASKED, ENTRIES = 8192, 4096, 1 << 21


# -- vectors --------------------------------------------------------------------------------


def _matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of dimension ``d``, zeros for others and for those of no length; which are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    fit, m = lengths == d, np.zeros((len(column), d))
    if fit.any():
        m[fit] = column.filter(pa.array(fit)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    norm = np.linalg.norm(m, axis=1)
    sound = norm > 0
    m[sound] /= norm[sound, None]
    return m, sound


def _pivots(chunks: DataFrame, n: int) -> np.ndarray:
    """Some distinct vectors of the most frequent length, about the root of their number: a bounded sample by hash."""
    sizes = chunks.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), F.desc("d")).first()
    if not sizes:
        return np.zeros((0, 0))
    own = chunks.where(F.size("vector") == sizes["d"]).select("vector").distinct().orderBy(F.xxhash64("vector"), "vector")
    m, sound = _matrix(pa.array([r["vector"] for r in own.limit(min(PIVOTS, math.isqrt(n) + 1)).collect()], pa.list_(pa.float64())), sizes["d"])
    return m[sound]


def vector_blocks(chunks: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """chunk_pos, vector, block of the chunks that have a vector; block, pivot (-1: no direction), near, far
    (the ring's angles) and rows of every block; the pivots.
    """
    held = materialise(chunks.where("vector is not null").select("chunk_pos", "vector"), "vectors")
    n = held.count()
    pivots, block = _pivots(held, n), max(BLOCK, n // BLOCKS)  # so the blocks' table is bounded: BLOCKS and a part full one of each ring
    d = pivots.shape[1] if len(pivots) else 0

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, sound = _matrix(b.column("vector"), d)
            pivot, angle = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            if len(pivots):
                cos = m[sound] @ pivots.T
                pivot[sound] = cos.argmax(axis=1)
                angle[sound] = np.arccos(np.clip(cos.max(axis=1, initial=-1), -1, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(angle)], ["chunk_pos", "vector", "pivot", "angle"])

    kind = held.schema["vector"].dataType.simpleString()
    ringed = held.mapInArrow(ring, f"chunk_pos long, vector {kind}, pivot int, angle double").withColumn("ring", F.floor(F.col("angle") / math.pi * RINGS).cast("int"))
    ringed = materialise(ringed, "ringed")
    rings = ringed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("angle").alias("near"), F.max("angle").alias("far"))
    parts = F.ceil(F.col("n") / block).cast("int")
    listed = rings.select("pivot", "ring", "near", "far", parts.alias("parts"), (F.col("n") / parts).alias("rows"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    blocks = materialise(listed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    # a ring's rows are dealt over its blocks
    dealt = ringed.join(F.broadcast(blocks.where("part = 0").select("pivot", "ring", "parts")), ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("chunk_pos"), F.col("parts")).cast("int"))
    named = dealt.join(F.broadcast(blocks.select("pivot", "ring", "part", "block")), ["pivot", "ring", "part"])
    return materialise(named.select("chunk_pos", "vector", "block"), "dealt"), blocks, pivots


def _bounds(m: np.ndarray, sound: np.ndarray, pivots: np.ndarray, pivot: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """The largest cosine that a chunk of each block (columns) can have with each query (rows of ``m``)."""
    bound = np.zeros((len(m), len(pivot)))
    known = np.flatnonzero(pivot >= 0)
    if len(known) and sound.any():
        need, at = np.unique(pivot[known], return_inverse=True)
        own = np.arccos(np.clip(m[sound] @ pivots[need].T, -1, 1))[:, at]
        bound[np.ix_(sound, known)] = np.cos(np.maximum(np.maximum(own - far[known], near[known] - own), 0.0))
    # of a size that no pivot has, or of no length: 0 with a vector of the pivots' size, anything with another
    bound[np.ix_(~sound, pivot < 0)] = 1.0
    return bound


def _listed(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    edges = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(rows) if rows else [], kind))


def _cosines(chunks: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_pos, semantic: the first ``k`` of each block that is wanted (query_id, vector, block)."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found, ids = rows.column("chunk_pos").to_numpy(), asked.column("query_id").to_numpy()
        sims, _ = retrieval._similarities(rows, asked, np.arange(len(found)), len(found))
        best = [np.lexsort((found, -np.round(sims[:, j], 9)))[: k + retrieval.SPARE] for j in range(len(ids))]
        c = np.concatenate(best) if best else np.zeros(0, int)
        j = np.repeat(np.arange(len(best)), [len(x) for x in best])
        return pa.table({"query_id": ids[j], "chunk_pos": found[c], "semantic": sims[c, j]})

    return chunks.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(run, "query_id long, chunk_pos long, semantic double")


def _rounds(bounds: DataFrame, k: int, score, read) -> tuple[DataFrame, DataFrame]:
    """Scores of what was read (``read`` of wanted rows of ``bounds``), and query_id, block, taken of every block."""
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    ahead = F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ranked = materialise(bounds.withColumn("first", F.coalesce(ahead, F.lit(0)) < AHEAD * k), "bounds")
    early = materialise(read(ranked.where("first")), "early")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score)))
    last = early.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col(score).alias("least"))
    # fewer than k scores so far: everything is still wanted
    judged = ranked.join(last, "query_id", "left").withColumn("taken", F.col("first") | F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
    judged = materialise(judged, "judged")
    return early.unionByName(read(judged.where("taken and not first"))), judged.select("query_id", "block", "taken")


def dense(chunks: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """query_id, chunk_pos, semantic, rank of each query's first ``k`` chunks by cosine; and which blocks were read for it.

    As retrieval.dense: vectors of no length or of another size have the cosine 0. Both rounds judge blocks in tasks: a query
    is a row for each of its first few blocks and for each group of blocks, never for each block.
    """
    held, blocks, pivots = vector_blocks(chunks)
    spark, d = held.sparkSession, pivots.shape[1] if len(pivots) else 0
    # a few numbers a block, BLOCKS and a part full one of each ring at most
    t = blocks.select("block", "pivot", "near", "far", "rows").orderBy("block").toArrow()
    shared = spark.sparkContext.broadcast((pivots, *(t.column(c).to_numpy() for c in ("block", "pivot", "near", "far", "rows"))))
    kind = queries.schema["vector"].dataType.simpleString()
    asked = materialise(queries.where("vector is not null").select("query_id", "vector"), "asked-vectors")

    def judged(b: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
        """Begin and end of stretches of queries and the bounds of all blocks for them."""
        pivots, block, pivot, near, far, _ = shared.value
        m, sound = _matrix(b.column("vector"), d)
        step = max(1, ENTRIES // max(1, len(block)))
        for lo in range(0, len(m), step):
            yield lo, min(len(m), lo + step), _bounds(m[lo : lo + step], sound[lo : lo + step], pivots, pivot, near, far)

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, rows, firsts = shared.value[1], shared.value[5], []
            for _, _, bound in judged(b):
                for row in bound:
                    order = np.lexsort((block, -row))
                    before = np.cumsum(rows[order]) - rows[order]
                    firsts.append(block[order[before < AHEAD * k]])
            yield pa.RecordBatch.from_arrays([*b.columns, _listed(firsts, pa.int64())], ["query_id", "vector", "firsts"])

    begun = materialise(asked.mapInArrow(ahead, f"query_id long, vector {kind}, firsts array<long>"), "firsts")
    early = materialise(_cosines(held, begun.select("query_id", "vector", F.explode("firsts").alias("block")), k), "early")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("semantic")))
    last = early.withColumn("place", place).where(F.col("place") == k).select("query_id", F.col("semantic").alias("least"))
    # fewer than k so far: no least, everything is still wanted
    waiting = materialise(begun.join(last, "query_id", "left"), "waiting")
    groups, parts = max(1, math.ceil(held.count() / GROUP)), max(1, math.ceil(waiting.count() / ASKED))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    g, q = F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("g"), F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("q")

    def rest(rows: pa.Table, asked: pa.Table) -> pa.Table:
        pivots, block, pivot, near, far, _ = shared.value
        rows = rows.take(pa.array(np.argsort(rows.column("block").to_numpy(), kind="stable")))
        own, begins = np.unique(rows.column("block").to_numpy(), return_index=True)
        at, ends = np.searchsorted(block, own), np.append(begins[1:], rows.num_rows)
        (m, _), (x, sound) = _matrix(rows.column("vector"), d), _matrix(asked.column("vector"), d)
        ids, pos = asked.column("query_id").to_numpy(), rows.column("chunk_pos").to_numpy()
        least = asked.column("least").fill_null(-np.inf).to_numpy()
        out, fresh = [np.zeros(0, int), np.zeros(0, int), np.zeros(0)], 0
        if len(own) and len(ids):
            wanted = _bounds(x, sound, pivots, pivot[at], near[at], far[at]) + SLACK >= least[:, None]
            firsts = asked.column("firsts").combine_chunks()
            of, named = np.repeat(np.arange(len(ids)), firsts.value_lengths().to_numpy(zero_copy_only=False)), firsts.flatten().to_numpy()
            read = np.minimum(np.searchsorted(own, named), len(own) - 1)
            here = own[read] == named
            wanted[of[here], read[here]] = False
            for n, (lo, hi) in enumerate(zip(begins.tolist(), ends.tolist())):
                some = np.flatnonzero(wanted[:, n])
                if not len(some):
                    continue
                if pivot[at[n]] < 0 and not sound[some].all():
                    sims, _ = retrieval._similarities(rows.slice(lo, hi - lo), asked.take(pa.array(some)), np.arange(hi - lo), hi - lo)
                    sims = sims.T
                else:
                    sims = x[some] @ m[lo:hi].T
                i, j = np.nonzero(sims + SLACK >= least[some, None])
                out, fresh = [np.concatenate(c) for c in zip(out, (some[i], pos[lo + j], sims[i, j]))], fresh + len(i)
                if fresh > ENTRIES:
                    best = retrieval._best(*out, k + retrieval.SPARE)
                    out, fresh = [c[best] for c in out], 0
        best = retrieval._best(*out, k + retrieval.SPARE)
        return pa.table({"query_id": ids[out[0][best]], "chunk_pos": out[1][best], "semantic": out[2][best]})

    met = held.select(g, every(parts).alias("q"), "block", "chunk_pos", "vector").groupBy("g", "q")
    late = met.cogroup(waiting.select(every(groups).alias("g"), q, "query_id", "vector", "firsts", "least").groupBy("g", "q"))
    found = early.unionByName(late.applyInArrow(rest, "query_id long, chunk_pos long, semantic double"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, least = shared.value[1], b.column("least").fill_null(-np.inf).to_numpy()
            for lo, hi, bound in judged(b):
                taken = bound + SLACK >= least[lo:hi, None]
                for n, named in enumerate(b.column("firsts").slice(lo, hi - lo).to_pylist()):
                    taken[n, np.searchsorted(block, named)] = True
                yield pa.RecordBatch.from_arrays([b.column("query_id").slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), len(block)))), pa.array(np.tile(block, hi - lo)), pa.array(taken.ravel())], ["query_id", "block", "taken"])

    return found.select("*", retrieval.ranked("semantic")).where(F.col("rank") <= k), waiting.mapInArrow(told, "query_id long, block long, taken boolean")


# -- terms ----------------------------------------------------------------------------------


def term_blocks(chunks: DataFrame, asked: DataFrame, block: int = BLOCK, k1: float = retrieval.K1, b: float = retrieval.B) -> tuple[DataFrame, retrieval.Lexical]:
    """block, chunk_pos, dl, ids, tfs: the postings of the terms of ``asked`` (a written table), by block of chunks; and the search's weights."""
    # chunks of like length are together: a bound by the least length of a block is closer there
    kind = F.floor(2 * F.log2(F.col("dl") + 1)).cast("int")
    found = retrieval.postings_and_lengths(chunks, asked)
    whole = found.where("term = ''")
    n, avgdl = whole.agg(F.count("*"), F.avg("dl")).first()
    kinds = whole.groupBy(kind.alias("kind")).agg(F.ceil(F.count("*") / max(block, n // BLOCKS)).alias("parts"))  # some dozen
    lex = retrieval.lexical(found.where("term <> ''"), asked, n, avgdl, k1, b)
    own = F.concat_ws("-", "kind", F.pmod(F.xxhash64("chunk_pos"), "parts")).alias("block")
    placed = lex.postings.withColumn("kind", kind).join(F.broadcast(kinds), "kind")
    return placed.select(own, "chunk_pos", "dl", "ids", "tfs"), lex


def _flat(asked: pa.Table) -> pa.Table:
    """query_id, id, w: a row a term, from rows of query_id, ids, ws."""
    ids, ws = asked.column("ids").combine_chunks(), asked.column("ws").combine_chunks()
    at = np.repeat(np.arange(asked.num_rows), ids.value_lengths().to_numpy(zero_copy_only=False))
    return pa.table([asked.column("query_id").take(pa.array(at)), ids.flatten(), ws.flatten()], ["query_id", "id", "w"])


def bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = retrieval.K1, b: float = retrieval.B, block: int = BLOCK, terms: int | None = retrieval.QUERY_TERMS) -> tuple[DataFrame, DataFrame]:
    """query_id, chunk_pos, bm25, rank of each query's first ``k`` chunks that share a term; and which blocks were read for it.

    ``terms`` as ``most`` of ``asked_terms``. Only postings of the queries' terms are kept, where the text is. Bounds and scores live in a block's task; a query and block are a row, no pair of query and chunk is.
    """
    asked = materialise(retrieval.asked_terms(queries, terms), "asked")
    posted, lex = term_blocks(chunks, asked, block, k1, b)
    length = lex.length
    # a query's whole list, ``terms`` at most
    own = materialise(lex.weights.groupBy("query_id").agg(F.collect_list("id").alias("ids"), F.collect_list("w").alias("ws")), "own-terms")
    every = materialise(posted.select("block").distinct(), "blocks").crossJoin(retrieval.small(own))

    def bound(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        flat, terms = retrieval.unpacked(rows), _flat(asked)
        ids, at, df = np.unique(flat.column("id").to_numpy(), return_inverse=True, return_counts=True)
        tf, dl = np.zeros(len(ids)), np.full(len(ids), np.inf)
        np.maximum.at(tf, at, flat.column("tf").to_numpy())
        np.minimum.at(dl, at, flat.column("dl").to_numpy())
        place = np.searchsorted(ids, terms.column("id").to_numpy())
        here = np.flatnonzero((place < len(ids)) & (ids[np.minimum(place, len(ids) - 1)] == terms.column("id").to_numpy())) if len(ids) else np.zeros(0, int)
        place, w = place[here], terms.column("w").to_numpy()[here]
        found, q = np.unique(retrieval._ids(terms.column("query_id"))[here], return_inverse=True)
        most, rows_of = np.bincount(q, w * tf[place] * (k1 + 1) / (tf[place] + k1 * (1 - b + b * dl[place] / length)), len(found)), np.zeros(len(found), int)
        np.maximum.at(rows_of, q, df[place])
        return pa.table({"query_id": retrieval._known(found), "block": pa.array([key[0].as_py()] * len(found), pa.string()), "bound": most, "rows": rows_of})

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        return retrieval._first_scores(retrieval._term_scores(retrieval.unpacked(rows), _flat(asked), length, k1, b), k)

    def read(wanted: DataFrame) -> DataFrame:
        terms = wanted.select("query_id", "block").join(retrieval.small(own), "query_id").select("block", "query_id", "ids", "ws")
        return posted.groupBy("block").cogroup(terms.groupBy("block")).applyInArrow(score, "query_id long, chunk_pos long, bm25 double")

    bounds = posted.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(bound, "query_id long, block string, bound double, rows long")
    found, taken = _rounds(bounds, k, "bm25", read)
    return found.select("*", retrieval.ranked("bm25")).where(F.col("rank") <= k), taken
