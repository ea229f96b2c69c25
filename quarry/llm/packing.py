"""Operator 8, packing: concatenate and cut, with two passes of prefix sums.

Pass 1 encodes each partition once, writes its ids with their offset inside the
partition, and totals each partition. The totals (one row a partition) are summed
up to give every partition's place in the one stream of all documents. Pass 2
cuts the stream at multiples of ``seq_len``: a piece is the part of one document
in one sequence, and flags say whether the document goes on before or after it
(boundary records). Only the last sequence of all can hold padding.

Null and empty texts are the end id alone. Order of the stream: partitions as
scanned, rows as stored. Repeated rows are packed again; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.batches import slices, texts
from quarry.llm.encoding import encoder
from quarry.storage import materialise


def encode_partitions(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, doc_id, at (ids before it in its partition), n, ids (narrow little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, at, part = encoder(tokenizer), 0, TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        for b in slices(batches):
            n, flat = enc.texts(texts(b))
            stop = (np.cumsum(n) * enc.dtype.itemsize).tolist()
            raw = flat.tobytes()
            ids = [raw[lo:hi] + end for lo, hi in zip([0, *stop], stop)]
            n = n + 1
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), b.column("doc_id"), pa.array(starts), pa.array(n), pa.array(ids, pa.binary())],
                ["part", "doc_id", "at", "n", "ids"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"part int, doc_id {kind}, at long, n long, ids binary")


def pack(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset,
    begins, ends (the piece holds its document's first or last id) and ids
    (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    coded = materialise(encode_partitions(docs, tokenizer, end_id), "packing")
    totals = sorted(coded.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    before = [0, *accumulate(r["n"] for r in totals)]
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, before)], "part int, base long")
    placed = coded.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("place"), "n", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(tokenizer).dtype
        for b in slices(batches, "ids"):
            place, n = (b.column(c).to_numpy() for c in ("place", "n"))
            first, last = place // seq_len, (place + n - 1) // seq_len
            row = np.repeat(np.arange(len(n)), last - first + 1)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1)
            seq = first[row] + nth
            lo = np.maximum(seq * seq_len, place[row])
            hi = np.minimum((seq + 1) * seq_len, (place + n)[row])
            start = lo - place[row]
            wide = [np.frombuffer(i, dtype).astype("<u4").tobytes() for i in b.column("ids").to_pylist()]
            ids = [wide[r][4 * s : 4 * e] for r, s, e in zip(row.tolist(), start.tolist(), (hi - place[row]).tolist())]
            cols = [b.column("doc_id").take(pa.array(row)), start, hi - lo, n[row], seq, lo - seq * seq_len, start == 0, hi == (place + n)[row], pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "begins", "ends", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(run, f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, begins boolean, ends boolean, ids binary")
