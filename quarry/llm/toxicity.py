"""Operator 6, toxicity: a factorization machine over hashed terms.

A term is a lower-case word of a whole text, hashed; a text is the set of its
terms. The machine scores w0 + sum w_i + sum over pairs <v_i, v_j>, so two terms
together can count for more or less than each alone. It is fitted on a bounded
sample of labelled texts, over the terms that tell the labels apart best (chi-square) by
themselves or in a pair; a term of a pair needs no effect of its own. Then it scores every text.

The sample is the distinct texts with the least hashes, in that order, so equal rows in
any layout give the same machine. Null and empty texts have no terms and score
sigmoid(w0); texts of any length are scored whole; repeated rows get equal scores and
null ids are ids. Without labels of both kinds every score is the share of label 1 (0
without labels). Other columns, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.batches import slices, texts
from quarry.llm.words import Words
from quarry.storage import materialise

#: Labelled texts fitted on, their terms in all, and of one text (those with the least hashes); a term takes four bytes.
SAMPLE_ROWS = 20_000
SAMPLE_TERMS, TEXT_TERMS = 8 << 20, 1 << 14
#: Bits of a hashed term; terms kept for their own effect, its least chi-square, and least texts that hold one.
BITS = 22
TERMS, LEAST_CHI, LEAST_TEXTS = 1024, 15.0, 3
#: Pairs kept at most, a pair's least chi-square (of millions that are tried) and least texts; terms, the most frequent, whose pairs are counted as a matrix.
PAIRS, PAIR_CHI, PAIR_TEXTS, DENSE = 128, 40.0, 10, 2048
#: Rows of such a matrix at a time.
ROWS = 4096
FACTORS = 8
EPOCHS, BATCH, RATE, DECAY = 30, 512, 0.02, 1e-4


def terms(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term) of each distinct term of each text."""
    words = Words(batch, byte_level=False)
    both = np.unique(words.text.astype(np.int64) << BITS | (words.hash >> np.uint64(64 - BITS)).astype(np.int64))
    return both >> BITS, both & (1 << BITS) - 1


@dataclass
class Machine:
    terms: np.ndarray  # sorted
    bias: float
    weight: np.ndarray
    factors: np.ndarray

    def score(self, batch: list[str]) -> np.ndarray:
        row, term = terms(batch)
        z = np.full(len(batch), self.bias)
        if len(self.terms) and len(term):
            at = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            hit = self.terms[at] == term
            row, at = row[hit], at[hit]
            sums = np.zeros((len(batch), self.factors.shape[1]))
            squares = np.zeros_like(sums)
            np.add.at(sums, row, self.factors[at])
            np.add.at(squares, row, self.factors[at] ** 2)
            np.add.at(z, row, self.weight[at])
            z += 0.5 * (sums**2 - squares).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS) -> Machine:
    """A machine from rows of text, label; of texts with both labels the larger counts."""
    known = _hashed(labelled.where("label is not null"), "label")
    return _sampled(known.select("h", "label"), known.select("h", "text"), sample_rows, sample_terms)


def fit_by_id(docs: DataFrame, known: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_terms: int = SAMPLE_TERMS) -> Machine:
    """A machine from documents (doc_id, text) and labels by id (doc_id, label): ids meet labels without the texts, of which those of the sample alone are read again."""
    hashed = _hashed(docs, "doc_id")
    said = hashed.select("doc_id", "h").join(known.where("label is not null").select("doc_id", "label"), "doc_id")
    return _sampled(said.select("h", "label"), hashed.select("h", "text"), sample_rows, sample_terms)


def _hashed(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), *columns)


def _sampled(said: DataFrame, held: DataFrame, sample_rows: int, sample_terms: int) -> Machine:
    """A machine from the labels of texts (h, label) and the texts (h, text)."""
    chosen = said.groupBy("h").agg(F.max("label").alias("label")).orderBy("h").limit(sample_rows)
    drawn = held.join(F.broadcast(chosen), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            first = np.sort(np.unique(b.column("h").to_numpy(), return_index=True)[1])
            b = b.take(pa.array(first))
            row, term = terms(texts(b))
            n = np.bincount(row, minlength=b.num_rows)
            keep = np.arange(len(term)) - np.repeat(np.cumsum(n) - n, n) < TEXT_TERMS
            edges = np.concatenate(([0], np.cumsum(np.minimum(n, TEXT_TERMS)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.ListArray.from_arrays(pa.array(edges), pa.array(term[keep].astype(np.int32))), b.column("label").cast(pa.int32())], ["h", "terms", "label"])

    listed = drawn.mapInArrow(run, "h long, terms array<int>, label int").dropDuplicates(["h"])
    listed = materialise(listed, "sample")
    # sample_rows rows at most: the running sum is over sizes, the terms aren't sorted
    before = F.sum("n").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    within = listed.select("h", F.size("terms").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < sample_terms)
    rows = listed.join(F.broadcast(within.select("h")), "h").select("h", "terms", "label").toArrow().sort_by("h")
    y = rows.column("label").to_numpy().astype(np.float64)
    size = np.array([len(t) for t in rows.column("terms")], np.int64)
    flat = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in rows.column("terms").chunks if len(c)] or [np.zeros(0, np.int32)])
    return _fit(np.repeat(np.arange(len(y)), size), flat, y)


def _chi(both: np.ndarray, of_one: np.ndarray, n: int, share: float) -> np.ndarray:
    """Chi-square of pairs held by ``both`` texts, ``of_one`` of them with label 1."""
    return (of_one - both * share) ** 2 / np.maximum(both * share * (1 - share) * np.maximum(1 - both / n, 1e-9), 1e-9)


def _in_pairs(row: np.ndarray, which: np.ndarray, seen: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Terms of the pairs that tell the labels apart; neither needs an effect of its own.

    Every pair of terms with enough texts is tried: pairs of the ``DENSE`` most frequent terms as a
    matrix, those of a rarer one with any other from the texts that hold it. Of the latter, pairs
    with too few texts of label 1 to tell it are not counted in full.
    """
    n, share = len(y), y.mean()
    often = np.argsort(-seen, kind="stable")[:DENSE]
    often = often[seen[often] >= PAIR_TEXTS]
    place = np.full(len(seen), -1)
    place[often] = np.arange(len(often))
    both, of_one = np.zeros((2, len(often), len(often)))
    ends = np.searchsorted(row, np.arange(n + 1))
    for lo in range(0, n, ROWS):
        hi = min(n, lo + ROWS)
        at = slice(ends[lo], ends[hi])
        keep = place[which[at]] >= 0
        x = np.zeros((hi - lo, len(often)), np.float32)
        x[row[at][keep] - lo, place[which[at][keep]]] = 1
        ones = x[y[lo:hi] > 0]
        both += x.T @ x
        of_one += ones.T @ ones
    chi = np.triu(np.where(both >= PAIR_TEXTS, _chi(both, of_one, n, share), 0), 1)
    a, b = np.nonzero(chi >= PAIR_CHI)
    found = [(chi[a, b], often[a], often[b]), *_rare_pairs(row, which, seen, y, place, ends)]
    value, a, b = (np.concatenate(c) for c in zip(*found))
    best = np.lexsort((b, a, -value))[:PAIRS]
    return np.union1d(a[best], b[best])


def _rare_pairs(row: np.ndarray, which: np.ndarray, seen: np.ndarray, y: np.ndarray, place: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """chi, a, b of the pairs that tell label 1, of a term a beyond the most frequent and any term b."""
    n, share = len(y), y.mean()
    # a pair of PAIR_TEXTS texts or more needs so many of label 1 at least
    counts = np.arange(1, n + 1)
    enough = _chi(np.maximum(counts, PAIR_TEXTS).astype(float), counts.astype(float), n, share) >= PAIR_CHI
    least = int(counts[enough & (counts > share * np.maximum(counts, PAIR_TEXTS))].min(initial=n + 1))
    seen1 = np.bincount(which, weights=y[row], minlength=len(seen)).astype(int)
    able = np.flatnonzero((seen1 >= least) & (seen >= PAIR_TEXTS))
    slot = np.full(len(seen), -1)
    slot[able] = np.arange(len(able))
    kept = slot[which] >= 0
    row, which = row[kept], slot[which[kept]]  # only terms that can be in such a pair, by their place in able
    ends = np.searchsorted(row, np.arange(n + 1))
    order = np.argsort(which, kind="stable")
    holders, first = row[order], np.searchsorted(which[order], np.arange(len(able) + 1))
    frequent = place[able] >= 0

    def held(texts: np.ndarray) -> np.ndarray:
        """How many of ``texts`` hold each term."""
        size = ends[texts + 1] - ends[texts]
        at = np.repeat(ends[texts] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(which[at], minlength=len(able))

    for a in np.flatnonzero(~frequent).tolist():
        texts = holders[first[a] : first[a + 1]]
        of_one = held(texts[y[texts] > 0])
        b = np.flatnonzero((of_one >= least) & (frequent | (np.arange(len(able)) > a)))
        if len(b):
            both = held(texts)[b].astype(float)
            chi = np.where(both >= PAIR_TEXTS, _chi(both, of_one[b].astype(float), n, share), 0)
            good = chi >= PAIR_CHI
            yield chi[good], able[np.full(good.sum(), a)], able[b[good]]


def _fit(row: np.ndarray, term: np.ndarray, y: np.ndarray) -> Machine:
    n, positive = len(y), y.sum()
    if not 0 < positive < n:
        return Machine(np.zeros(0, int), 40.0 if n and positive else -40.0, np.zeros(0), np.zeros((0, FACTORS)))
    found, which = np.unique(term, return_inverse=True)
    seen, seen1 = np.bincount(which), np.bincount(which, weights=y[row])
    expected = seen * positive / n
    chi = (seen1 - expected) ** 2 / (expected * (1 - positive / n) * np.maximum(1 - seen / n, 1e-9))
    chi[seen < LEAST_TEXTS] = 0
    best = np.argsort(-chi, kind="stable")[: min(TERMS, int((chi >= LEAST_CHI).sum()))]
    best = np.union1d(best, _in_pairs(row, which, seen, y))
    place = np.full(len(found), -1)
    place[best] = np.arange(len(best))
    keep = place[which] >= 0
    x = np.zeros((n, len(best)), np.float32)
    x[row[keep], place[which[keep]]] = 1
    rng = np.random.Generator(np.random.PCG64(7))
    params = [np.array([np.log(positive / (n - positive))]), np.zeros(len(best)), rng.normal(0, 0.05, (len(best), FACTORS))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for _ in range(EPOCHS):
        for some in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            a, t = x[some], y[some]
            av = a @ params[2]
            z = params[0] + a @ params[1] + 0.5 * (av**2 - a @ params[2] ** 2).sum(axis=1)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - t) / len(some)
            gv = a.T @ (g[:, None] * av) - params[2] * (a.T @ g)[:, None]
            step += 1
            for j, grad in enumerate((np.array([g.sum()]), a.T @ g + DECAY * params[1], gv + DECAY * params[2])):
                first[j] = 0.9 * first[j] + 0.1 * grad
                second[j] = 0.999 * second[j] + 0.001 * grad**2
                params[j] -= RATE * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Machine(found[best], float(params[0][0]), params[1], params[2])


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(machine.score(texts(b)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
