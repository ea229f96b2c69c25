"""Incremental indexing of a folder's files as chunks with vectors.

``index_folder`` is for folders where files only arrive: a stream whose batches write
their own partition of the target, replacing it if the batch runs again. A large file of
plain text is never a row there: its lines become pieces, and its windows are cut as the
pieces come by in order, so what a task holds doesn't grow with the file.

``sync_folder`` follows changes and deletions too. A manifest holds path, time, length and
content hash of every file that is indexed; each run joins it with the folder's listing.
New files and those whose time or length differ are read, and only where the content
differs are they cut and embedded again. A document's chunks are those of the run that its
manifest row names, so they are replaced or removed in the moment the run is committed; a
run that is lost before changes nothing and is repeated whole.

Chunk ids follow from document, place and text; so a restart gives the same ones.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry import runs
from quarry.functions.text import extension, supported
from quarry.operators import chunking, models, windows
from quarry.sources import files
from quarry.storage import forget, materialise, scratch

BINARY = "path string, modificationTime timestamp, length long, content binary"


def chunks_of(docs: DataFrame, cfg: chunking.ChunkConfig, dim: int = models.DIM) -> DataFrame:
    """chunk_id, doc_id, idx, text, tokens, vector of documents (doc_id, text)."""
    return _embedded(chunking.chunk(docs, cfg), dim)


def _embedded(made: DataFrame, dim: int) -> DataFrame:
    named = made.withColumn("chunk_id", F.sha2(F.to_json(F.struct("doc_id", "idx", "text")), 256))
    return models.with_vectors(named, dim).select("chunk_id", "doc_id", "idx", "text", "tokens", "vector")


#: Extensions of files whose text is their lines; bytes from which such a file is read in pieces; characters of a piece (one line at least), and of windows that leave a task at a time.
PLAIN, LONG, PIECE = ["txt", "md", "markdown"], 8 << 20, 1 << 18


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, start, no, text: some following lines of a file each, with their line ends; in order by start (of what a task read) and no."""
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text([_literal(p) for p in paths])
    placed = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.make_valid_utf8("value").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, chars, no = None, [], 0, 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([at[0]]), pa.array([at[1]], pa.int64()), pa.array([no], pa.int64()), pa.array(["\n".join(held) + "\n"])], ["file", "start", "no", "text"])
        for b in batches:
            for *own, line in zip(*(c.to_pylist() for c in b.columns)):
                if held and (own != at or chars >= PIECE):
                    yield row()
                    no, held, chars = no + 1, [], 0
                at = own
                held.append(line)
                chars += len(line) + 1
        if held:
            yield row()

    return placed.mapInArrow(run, "file string, start long, no long, text string")


def _long_windows(spark: SparkSession, paths: list[str], cfg: chunking.ChunkConfig) -> DataFrame:
    """file, idx, text, tokens: the fixed windows of the clean text of plain files, each file cut by one task as its pieces come by."""
    size, overlap = cfg.size or 512, cfg.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((b.column("file")[k].as_py(), b.column("text")[k].as_py()) for b in batches for k in range(b.num_rows))
        for file, own in itertools.groupby(rows, key=lambda r: r[0]):
            found, first, chars = [], 0, 0
            for text, _, _, tokens in itertools.chain(windows.streamed(files.normalised(t for _, t in own), size, overlap), [(None,) * 4]):
                if found and (text is None or chars >= PIECE):
                    cols = [pa.array([file] * len(found)), pa.array(range(first, first + len(found)), pa.int32()), *(pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64())))]
                    yield pa.RecordBatch.from_arrays(cols, ["file", "idx", "text", "tokens"])
                    found, first, chars = [], first + len(found), 0
                if text is not None:
                    found.append((text, tokens))
                    chars += len(text)

    ordered = _pieces(spark, paths).repartition("file").sortWithinPartitions("file", "start", "no")
    return ordered.select("file", "text").mapInArrow(run, "file string, idx int, text string, tokens long")


def index_folder(
    spark: SparkSession, source: str, target: str, checkpoint: str, cfg: chunking.ChunkConfig = chunking.ChunkConfig(), dim: int = models.DIM,
    files_per_batch: int = 1000, pdf_reader: Callable[[bytes], str] | None = None, max_bytes: int = files.MAX_BYTES,
) -> StreamingQuery:
    """Index the files of ``source`` that are new since the last run, then stop.

    ``target`` and ``checkpoint`` lie in folders that driver and executors share. Paths of a batch's files pass the
    driver, ``files_per_batch`` at most. Files that have to be parsed whole (not plain text, or cut otherwise than by the
    fixed windows alone) are a row each.
    """
    stream = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true").load(source)
    small = stream.select("path", "length").where((F.col("length") <= max_bytes) & supported(F.col("path")))

    def write(batch: DataFrame, batch_id: int) -> None:
        session, out = batch.sparkSession, f"{target}/batch={batch_id}"
        plain = F.lit(chunking.as_windows(cfg)) & extension(F.col("path")).isin(PLAIN) & (F.col("length") >= LONG)
        found = batch.select("path", plain.alias("long")).collect()
        whole, long = ([r["path"] for r in found if r["long"] == kind] for kind in (False, True))
        scan = session.read.format("binaryFile").option("recursiveFileLookup", "true").schema(BINARY)
        content = scan.load([_literal(p) for p in whole]) if whole else session.createDataFrame([], BINARY)
        made = chunking.chunk(files.describe(files.parse(content, pdf_reader)).select("doc_id", "text"), cfg)
        if not long:
            return _embedded(made, dim).write.mode("overwrite").parquet(out)
        # written, as a large file's windows are cut by one task and their vectors made by all
        cut = materialise(_long_windows(session, long, cfg), "windows")
        names = scan.load([_literal(p) for p in long]).select(F.col("_metadata.file_path").alias("file"), files.doc_id(F.col("path")).alias("doc_id"))
        own = cut.join(F.broadcast(names), "file").select("doc_id", "idx", "text", "tokens")
        _embedded(made.unionByName(own), dim).write.mode("overwrite").parquet(out)
        forget(session, cut)

    return small.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


_MANIFEST = "path string, doc_id string, modified timestamp, length long, hash string, chunk_run int, gone boolean"
_CHUNKS = "chunk_id string, doc_id string, idx int, text string, tokens long, vector array<double>"
_FACTS = "added long, changed long, touched long, removed long"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """path, doc_id, modified, length, hash, chunk_run of every file that is indexed."""
    found = runs.committed(spark, target)
    if not found:
        return spark.createDataFrame([], _MANIFEST).drop("gone")
    rows = runs.read(spark, target, "manifest", _MANIFEST, found)
    last = rows.groupBy("path").agg(F.max_by(F.struct("doc_id", "modified", "length", "hash", "chunk_run", "gone"), "run").alias("m")).select("path", "m.*")
    return last.where("not gone").drop("gone")


def indexed_chunks(spark: SparkSession, target: str) -> DataFrame:
    """chunk_id, doc_id, idx, text, tokens, vector of the files as they were at the last run."""
    found = runs.committed(spark, target)
    if not found:
        return spark.createDataFrame([], _CHUNKS)
    current = manifest(spark, target).select("doc_id", F.col("chunk_run").alias("run"))
    return runs.read(spark, target, "chunks", _CHUNKS, found).join(current, ["doc_id", "run"], "left_semi").drop("run")


def _literal(path: str) -> str:
    """A path whose characters stand for themselves where patterns are read."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def sync_folder(
    spark: SparkSession, source: str, target: str, cfg: chunking.ChunkConfig = chunking.ChunkConfig(), dim: int = models.DIM,
    files_per_read: int = 10_000, pdf_reader: Callable[[bytes], str] | None = None, max_bytes: int = files.MAX_BYTES,
) -> int | None:
    """Bring ``target`` to the state of the files below ``source``; the number of the run, None where nothing differs.

    Files of other extensions, above the size limit or of no bytes count as not there. Paths
    of differing files pass the driver, ``files_per_read`` at a time.
    """
    done = runs.committed(spark, target)
    run = done[-1] + 1 if done else 0
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    there = scan.load(source).select("path", F.col("modificationTime").alias("modified"), "length").where((F.col("length") <= max_bytes) & supported(F.col("path")))
    there, known = materialise(there, "listing"), materialise(manifest(spark, target), "manifest")
    before = known.select("path", F.col("modified").alias("m0"), F.col("length").alias("l0"), F.col("hash").alias("h0"), F.col("chunk_run").alias("r0"))
    differs = F.col("m0").isNull() | (F.col("m0") != F.col("modified")) | (F.col("l0") != F.col("length"))
    suspects = materialise(there.join(before, "path", "left").where(differs), "suspects")
    removed = materialise(known.join(there, "path", "left_anti"), "removed")
    if suspects.isEmpty() and removed.isEmpty():
        return None
    staged = scratch(spark, "texts")
    kinds = "doc_id string, path string, modified timestamp, length long, text string, hash string"
    spark.createDataFrame([], kinds).write.parquet(staged)
    paths = (_literal(r["path"]) for r in suspects.select("path").toLocalIterator())
    for some in iter(lambda: list(itertools.islice(paths, files_per_read)), []):
        content = spark.read.format("binaryFile").load(some).withColumn("hash", F.sha2("content", 256))
        parsed = files.describe(files.parse(content, pdf_reader), ("hash",))
        parsed.select("doc_id", F.col("file_path").alias("path"), F.col("created_at").alias("modified"), F.col("size").alias("length"), "text", "hash").write.mode("append").parquet(staged)
    texts = spark.read.schema(kinds).parquet(staged)
    same = F.col("h0").eqNullSafe(F.col("hash"))
    judged = texts.join(suspects.select("path", "h0", "r0"), "path").withColumn("same", same)
    judged = materialise(judged.withColumn("chunk_run", F.when(F.col("same"), F.col("r0")).otherwise(run)), "judged")
    chunks_of(judged.where("not same").select("doc_id", "text"), cfg, dim).write.mode("overwrite").parquet(f"{target}/chunks/run={run}")
    columns = ["path", "doc_id", "modified", "length", "hash", "chunk_run"]
    rows = judged.select(*columns, F.lit(False).alias("gone")).union(removed.select(*columns, F.lit(True)))
    rows.write.mode("overwrite").parquet(f"{target}/manifest/run={run}")
    counts = judged.agg(F.count_if(F.col("h0").isNull()).alias("added"), F.count_if(F.col("h0").isNotNull() & ~F.col("same")).alias("changed"), F.count_if("same").alias("touched")).first()
    runs.commit(spark.createDataFrame([(*counts, removed.count())], _FACTS), target, run)
    return run
