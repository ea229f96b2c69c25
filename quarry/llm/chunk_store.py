"""Operator 9, token-ID output: a content-addressed store of id streams.

A gear hash over the last ids cuts every document's ids into chunks, so equal
passages give equal chunks wherever they stand. The store, a Parquet folder, holds

* ``kind=chunk``: SHA-256 and ids of every distinct chunk, once;
* ``kind=recipe``: per document its id count, the hashes and ends of its chunks
  and the Merkle root over them;
* ``manifest``: one row a document in ascending doc_id order with its start in the
  stream and its root, ``roots``: the Merkle root over the rows of each manifest segment,
  and ``seal``: documents, ids and the root over all segments.

Chunks and recipes leave the encoder together and share one exchange by key, where
equal chunks are merged before and after it; ids cross the network once.

Reading starts from the seal: segments are hashed again and held against their roots and these
against the seal; every document of the manifest must have a recipe of the same root, every recipe
must give its root, every chunk that it names must be there and match its hash, and the
ids must be as many as the manifest says. Whatever was lost or changed raises.

Null and empty texts are the end id alone. Rows that share a doc_id are documents
of their own, next to each other in the stream in an order fixed by their content;
a null doc_id comes first. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quarry.llm.batches import slices, texts
from quarry.llm.encoding import encoder
from quarry.storage import forget, materialise

#: Ids in a chunk: at least, about (a power of two beyond the least), at most.
LEAST, MASK_BITS, MOST = 64, 8, 1024
#: Ids that the rolling hash looks back on.
LOOK_BACK = 16


def gear(n: int) -> np.ndarray:
    """A fixed random number for each id."""
    return np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 63, n, dtype=np.uint64)


def cuts(ids: np.ndarray, table: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Chunk ends of each document; documents end at ``ends`` of ``ids``."""
    g, h = table[ids], np.zeros(len(ids), np.uint64)
    for k in range(LOOK_BACK):
        h[k:] += g[: len(g) - k] << np.uint64(4 * k)
    marks = np.flatnonzero(h >> np.uint64(64 - MASK_BITS) == 0) + 1
    out, lo = [], 0
    for hi in ends.tolist():
        own, at = [], lo
        # the hash has seen ids of this document alone only LOOK_BACK ids in; LEAST is more
        for m in [*marks[np.searchsorted(marks, lo) : np.searchsorted(marks, hi)].tolist(), hi]:
            while m - at > MOST:
                own.append(at := at + MOST)
            if m - at >= LEAST or m == hi and m > at:
                own.append(at := m)
        out.append(own)
        lo = hi
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary SHA-256 tree; an odd node goes up as it is."""
    level = leaves or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """kind, key, doc_id, n, content, hashes, ends: chunk rows and recipe rows of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        table = gear(1 << 16 if enc.dtype.itemsize == 2 else enc.tokenizer.get_vocab_size())
        for b in slices(batches):
            n, flat = enc.texts(texts(b))
            ends = np.cumsum(n)
            flat = np.insert(flat, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            raw, width = flat.tobytes(), flat.dtype.itemsize
            chunks, recipes = {}, []
            for doc, own, lo, hi in zip(b.column("doc_id").to_pylist(), cuts(flat, table, ends), [0, *ends.tolist()], ends.tolist()):
                edges = [lo, *own]
                leaves = []
                for x, y in zip(edges, edges[1:]):
                    content = raw[width * x : width * y]
                    leaves.append(d := hashlib.sha256(content).digest())
                    chunks[d] = content
                root = merkle(leaves)
                key = hashlib.sha256(root + repr(doc).encode()).digest()
                recipes.append((key, doc, hi - lo, root, leaves, [x - lo for x in own]))
            k, m = len(chunks), len(recipes)
            key, doc, size, root, leaves, stops = zip(*recipes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * k + ["recipe"] * m),
                    pa.array([*chunks, *key], pa.binary()),
                    pa.array([None] * k + list(doc), b.column("doc_id").type),
                    pa.array([len(c) // width for c in chunks.values()] + list(size), pa.int64()),
                    pa.array([*chunks.values(), *root], pa.binary()),
                    pa.array([None] * k + list(leaves), pa.list_(pa.binary())),
                    pa.array([None] * k + list(stops), pa.list_(pa.int64())),
                ],
                ["kind", "key", "doc_id", "n", "content", "hashes", "ends"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"kind string, key binary, doc_id {kind}, n long, content binary, hashes array<binary>, ends array<long>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the store of ``docs`` below ``path``."""
    spark = docs.sparkSession
    rows = _rows(docs, tokenizer, end_id)
    # equal documents under one doc_id: counted, so that each keeps its place in the stream
    merged = rows.groupBy("kind", "key").agg(
        *[F.first(c).alias(c) for c in ("doc_id", "n", "content", "hashes", "ends")], F.count("*").alias("copies")
    )
    merged.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/store")
    kind = docs.schema["doc_id"].dataType.simpleString()
    recipes = _store(spark, path, kind).where("kind = 'recipe'")
    order = [F.col("doc_id").asc_nulls_first(), F.col("key").asc(), F.col("copy").asc()]
    listed = (
        recipes.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select("doc_id", "key", "copy", "n", F.col("content").alias("root"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            n = b.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at + np.cumsum(n) - n), pa.array(np.full(len(n), part, np.int32))], [*b.schema.names, "at", "part"])
            at += int(n.sum())

    listed.mapInArrow(number, f"doc_id {kind}, key binary, copy int, n long, root binary, at long, part int").write.parquet(f"{path}/manifest")
    manifest = spark.read.parquet(f"{path}/manifest")

    segments = _segments(manifest)
    segments.write.parquet(f"{path}/roots")
    n, ids, root = _seal(manifest, spark.read.parquet(f"{path}/roots"))
    spark.createDataFrame([(n, ids, root)], "documents long, ids long, root binary").coalesce(1).write.parquet(f"{path}/seal")


@F.pandas_udf(BinaryType())
def _root_of(lists: pd.Series) -> pd.Series:
    return lists.map(lambda leaves: merkle([bytes(r["leaf"]) for r in leaves]))


def _segments(manifest: DataFrame) -> DataFrame:
    """part, segment, root of each run of 2^20 ids in a manifest partition; a leaf is the hash of a row."""
    row = [F.hex("key"), F.hex("root"), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in ("doc_id", "copy", "n", "at")]]
    leaf = F.unhex(F.sha2(F.concat_ws(":", *row), 256)).alias("leaf")
    rows = manifest.select("part", F.floor(F.col("at") / (1 << 20)).alias("segment"), "at", leaf)
    return rows.groupBy("part", "segment").agg(F.sort_array(F.collect_list(F.struct("at", "leaf"))).alias("l")).select("part", "segment", _root_of("l").alias("root"))


def _seal(manifest: DataFrame, segments: DataFrame) -> tuple[int, int, bytes]:
    """Documents, ids, and the root over the roots of the partitions, of which one row each reaches the driver."""
    parts = segments.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("segment", F.col("root").alias("leaf")))).alias("l")).select("part", _root_of("l").alias("root"))
    n, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return n, ids, merkle([bytes(r["root"]) for r in sorted(parts.collect())])


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raise where the manifest isn't what was written."""
    rows = spark.read.parquet(f"{path}/manifest")
    found = materialise(_segments(rows), "segments")
    kept = spark.read.schema("part int, segment long, root binary").parquet(f"{path}/roots").withColumnRenamed("root", "kept")
    both = found.join(kept, ["part", "segment"], "full_outer")
    if not both.where(~F.col("root").eqNullSafe(F.col("kept"))).isEmpty():
        raise ValueError("a manifest segment differs from its root")
    if tuple(spark.read.schema("documents long, ids long, root binary").parquet(f"{path}/seal").first() or ()) != _seal(rows, found):
        raise ValueError("the manifest differs from its seal")
    forget(spark, found)


def _store(spark: SparkSession, path: str, kind: str) -> DataFrame:
    # the schema is given: a partition column's type is then not guessed
    return spark.read.schema(f"key binary, doc_id {kind}, n long, content binary, hashes array<binary>, ends array<long>, copies long, kind string").parquet(f"{path}/store")


def _kind(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(f"{path}/manifest").schema["doc_id"].dataType.simpleString()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, key, copy, n, root, start: every document in the stream, of a manifest that was verified."""
    verify_manifest(spark, path)
    rows = spark.read.parquet(f"{path}/manifest")
    totals = sorted(rows.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a partition
    base = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, [0, *accumulate(r["n"] for r in totals)])], "part int, base long")
    return rows.join(F.broadcast(base), "part").select("doc_id", "key", "copy", "n", "root", (F.col("base") + F.col("at")).alias("start"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """hash, n, content of every distinct chunk; raises where the content doesn't match."""
    sound = F.when(F.unhex(F.sha2("content", 256)) == F.col("key"), True).otherwise(F.raise_error(F.lit("a chunk differs from its hash")).cast("boolean"))
    return _store(spark, path, _kind(spark, path)).where("kind = 'chunk'").where(sound).select(F.col("key").alias("hash"), "n", "content")


def uses(spark: SparkSession, path: str) -> DataFrame:
    """key, seq, hash, end, n, recipe_root (in the first row): the chunks of every document; raises where a recipe doesn't give its root."""

    @F.pandas_udf("boolean")
    def rooted(hashes: pd.Series, root: pd.Series) -> pd.Series:
        return pd.Series([merkle([bytes(h) for h in hs]) == bytes(r) for hs, r in zip(hashes, root)])

    good = F.when(rooted("hashes", "content"), True).otherwise(F.raise_error(F.lit("a recipe differs from its root")).cast("boolean"))
    recipes = _store(spark, path, _kind(spark, path)).where("kind = 'recipe'").where(good)
    each = recipes.select("key", "n", "content", F.posexplode(F.arrays_zip("hashes", "ends")).alias("seq", "part"))
    first = F.when(F.col("seq") == 0, F.col("content")).alias("recipe_root")
    return each.select("key", "seq", F.col("part.hashes").alias("hash"), F.col("part.ends").alias("end"), "n", first)


def _sound(condition: Column, message: str) -> Column:
    return F.when(condition, True).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def _found(column: str) -> Column:
    return _sound(F.col(column).isNotNull(), "a chunk is missing")


def _rebuilt(spark: SparkSession, path: str, made: DataFrame) -> DataFrame:
    """The verified manifest with what was made of the recipes (key, recipe_root, size and others) of each document."""
    both = manifest(spark, path).join(made, "key", "left")
    both = both.where(_sound(F.col("recipe_root").isNotNull(), "a recipe is missing"))
    return both.where(_sound((F.col("recipe_root") == F.col("root")) & (F.col("size") == F.col("n")), "a recipe differs from the manifest"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n, ids (as stored) of every document, rebuilt from its chunks."""
    made = (
        uses(spark, path)
        .join(chunks(spark, path).select("hash", F.col("n").alias("size"), "content"), "hash", "left")
        .where(_found("content"))
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("parts"), F.sum("size").alias("size"), F.max("recipe_root").alias("recipe_root"))
        .select("key", "size", "recipe_root", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["content"])), "")).alias("ids"))
    )
    return _rebuilt(spark, path, made).select("doc_id", "start", "n", "ids")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (over little-endian unsigned 32-bit ids) of every document, from the files.

    Each distinct chunk is read and summed once; a document's CRC is the exclusive or
    of its chunks' CRCs, each shifted past the ids behind it. Ids don't cross the network.
    """

    @F.pandas_udf("long")
    def crc(content: pd.Series, n: pd.Series) -> pd.Series:
        wide = (np.frombuffer(c, f"<u{len(c) // k}").astype("<u4") for c, k in zip(content, n))
        return pd.Series([zlib.crc32(w.tobytes()) for w in wide], dtype="int64")

    @F.pandas_udf("long")
    def shifted(crc: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series(crc_shift(crc.to_numpy(), 4 * after.to_numpy()).astype(np.int64))

    sums = chunks(spark, path).select("hash", F.col("n").alias("size"), crc("content", "n").alias("crc"))
    made = (
        uses(spark, path)
        .join(sums, "hash", "left")
        .where(_found("crc"))
        .select("key", "size", "recipe_root", shifted("crc", F.col("n") - F.col("end")).alias("crc"))
        .groupBy("key")
        .agg(F.sum("size").alias("size"), F.expr("bit_xor(crc)").alias("ids_crc32"), F.max("recipe_root").alias("recipe_root"))
    )
    return _rebuilt(spark, path, made).select("doc_id", "start", F.col("size").alias("n_tokens"), "ids_crc32")


# -- CRC-32 of a whole from the CRC-32 of its parts -----------------------------------------

#: Fixed value: the polynomial of zlib's CRC-32, low bit first.
POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over GF(2), bit-reversed, modulo POLYNOMIAL."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(k) & np.uint32(1), b, np.uint32(0))
        b = np.where(b & np.uint32(1), b >> np.uint32(1) ^ np.uint32(POLYNOMIAL), b >> np.uint32(1))
    return out


def crc_shift(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What ``crc`` adds to the CRC-32 of a whole in which ``n_bytes`` bytes follow."""
    out, left = crc.astype(np.uint32), n_bytes.astype(np.uint64)
    power = np.array([1 << 23], np.uint32)  # x**8
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        if odd.any():
            out[odd] = _times(out[odd], np.broadcast_to(power, odd.sum()))
        power = _times(power, power)
        left = left >> np.uint64(1)
    return out
