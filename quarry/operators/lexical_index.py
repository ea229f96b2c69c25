"""An inverted index that outlives a query: postings in tables by bucket of terms, with runs of changes.

``create`` writes run 0. Each ``update`` writes a run of its own: postings and lengths of
new and changed chunks, and tombstones of chunks that are changed or gone, which hide
their rows of earlier runs. Corpus size and lengths are sums over the commits, a term's
document frequency is counted over its visible postings; so both follow the changes.

A search reads only the buckets of its terms, and in them the row groups that can hold
these (files are sorted by term); no text of a chunk is split again. A bucket's rows
are spread over files by chunk, so a term that is in every chunk is many tasks' work.

Chunks: chunk_pos (unique, long), text (null: no terms). A chunk that is both changed and gone is
gone. Changing a chunk that isn't there adds it; removing one has no effect. A run that is
repeated after its commit leaves the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import runs
from quarry.functions.text import index_terms
from quarry.operators import retrieval
from quarry.storage import materialise

#: Buckets of terms, and files of a bucket that one run spreads its rows over at most.
BUCKETS, SPREAD = 64, 8
_POSTINGS = "term string, chunk_pos long, dl int, tf long, bucket int"
_LENGTHS, _GONE = "chunk_pos long, dl int", "chunk_pos long"
#: Of a run: whether it holds the whole index, its buckets, chunks and terms that it adds, and that it takes away.
_FACTS = "whole boolean, buckets int, n long, words long, n_gone long, words_gone long"


def _facts(spark: SparkSession, path: str) -> tuple[list[int], DataFrame]:
    """The runs that make up the index (from the last whole one on) and their facts."""
    found = runs.committed(spark, path)
    if not found:
        raise ValueError(f"no index at {path}")
    facts = runs.read(spark, path, "commits", _FACTS, found)
    base = facts.where("whole").agg(F.max("run")).first()[0]
    found = [k for k in found if k >= base]
    return found, facts.where(F.col("run") >= base)


def _visible(rows: DataFrame, spark: SparkSession, path: str, found: list[int]) -> DataFrame:
    """``rows`` (chunk_pos, run) that no tombstone of a later run hides."""
    if len(found) == 1:
        return rows.drop("run")
    hidden = runs.read(spark, path, "gone", _GONE, found[1:]).groupBy("chunk_pos").agg(F.max("run").alias("until"))
    hidden = retrieval.small(materialise(hidden, "hidden"))
    return rows.join(hidden, "chunk_pos", "left").where("until is null or run >= until").drop("run", "until")


def _write(listed: DataFrame, path: str, run: int, buckets: int) -> None:
    """Postings and lengths of ``listed`` (chunk_pos, terms), a written table."""
    size = F.size("terms").alias("dl")
    listed.select("chunk_pos", size).write.mode("overwrite").parquet(f"{path}/lengths/run={run}")
    each = listed.select("chunk_pos", size, F.explode("terms").alias("term")).groupBy("chunk_pos", "dl", "term").agg(F.count("*").alias("tf"))
    _write_postings(each.withColumn("bucket", _bucket(buckets)), path, run)


def _write_postings(postings: DataFrame, path: str, run: int) -> None:
    """The term stands in each file once sorted, so that a row group's least and largest say what it can hold."""
    spread = postings.repartition("bucket", F.pmod(F.xxhash64("chunk_pos"), F.lit(SPREAD)))
    spread.sortWithinPartitions("bucket", "term").select("term", "chunk_pos", "dl", "tf", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/run={run}")


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")


def _split(chunks: DataFrame) -> DataFrame:
    return materialise(chunks.select("chunk_pos", index_terms(F.col("text")).alias("terms")), "terms")


def _commit(spark: SparkSession, path: str, run: int, whole: bool, buckets: int, added: DataFrame, gone: DataFrame | None) -> None:
    """``added``, ``gone``: lengths (dl) of the chunks."""
    total = lambda rows: rows.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    n, words = total(added)
    n_gone, words_gone = total(gone) if gone is not None else (0, 0)
    runs.commit(spark.createDataFrame([(whole, buckets, n, words, n_gone, words_gone)], _FACTS), path, run)


def create(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of ``chunks`` (chunk_pos, text) to a new folder."""
    spark = chunks.sparkSession
    if runs.committed(spark, path):
        raise ValueError(f"there is an index at {path}")
    listed = _split(chunks)
    _write(listed, path, 0, buckets)
    _commit(spark, path, 0, True, buckets, listed.select(F.size("terms").alias("dl")), None)


def update(spark: SparkSession, path: str, changed: DataFrame | None = None, gone: DataFrame | None = None) -> int:
    """Add or replace ``changed`` (chunk_pos, text), remove ``gone`` (chunk_pos); the number of the run."""
    found, facts = _facts(spark, path)
    buckets, run = facts.agg(F.max("buckets")).first()[0], found[-1] + 1
    none = spark.createDataFrame([], "chunk_pos long, text string")
    out = gone.select("chunk_pos").distinct() if gone is not None else none.select("chunk_pos")
    listed = _split((changed if changed is not None else none).join(out, "chunk_pos", "left_anti"))
    touched = listed.select("chunk_pos").union(out)
    lengths = _visible(runs.read(spark, path, "lengths", _LENGTHS, found), spark, path, found)
    hidden = materialise(lengths.join(touched, "chunk_pos", "left_semi"), "touched")
    hidden.select("chunk_pos").write.mode("overwrite").parquet(f"{path}/gone/run={run}")
    _write(listed, path, run, buckets)
    _commit(spark, path, run, False, buckets, listed.select(F.size("terms").alias("dl")), hidden)
    return run


def compact(spark: SparkSession, path: str) -> int:
    """Write all that is visible as one whole run and delete the runs before it; the number of the run."""
    found, facts = _facts(spark, path)
    buckets, run = facts.agg(F.max("buckets")).first()[0], found[-1] + 1
    lengths = _visible(runs.read(spark, path, "lengths", _LENGTHS, found), spark, path, found)
    lengths.select("chunk_pos", "dl").write.mode("overwrite").parquet(f"{path}/lengths/run={run}")
    _write_postings(_visible(runs.read(spark, path, "postings", _POSTINGS, found), spark, path, found), path, run)
    _commit(spark, path, run, True, buckets, spark.read.schema(_LENGTHS).parquet(f"{path}/lengths/run={run}"), None)
    runs.drop(spark, path, ["postings", "lengths", "gone"], [k for k in runs.committed(spark, path) if k < run])
    return run


def stats(spark: SparkSession, path: str) -> DataFrame:
    """One row: n, avgdl, from the commits alone."""
    n, words = F.sum(F.col("n") - F.col("n_gone")), F.sum(F.col("words") - F.col("words_gone"))
    return _facts(spark, path)[1].agg(n.alias("n"), F.when(n > 0, words / n).otherwise(0.0).alias("avgdl"))


def postings(spark: SparkSession, path: str, terms: DataFrame) -> DataFrame:
    """term, chunk_pos, dl, tf of the visible postings of ``terms`` (term, distinct; a written table)."""
    found, facts = _facts(spark, path)
    buckets = facts.agg(F.max("buckets")).first()[0]
    own = [r[0] for r in terms.select(_bucket(buckets).alias("bucket")).distinct().collect()]  # buckets at most
    rows = runs.read(spark, path, "postings", _POSTINGS, found).where(F.col("bucket").isin(own)).drop("bucket")
    return _visible(rows.join(retrieval.small(terms), "term"), spark, path, found)


def bm25(spark: SparkSession, path: str, queries: DataFrame, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """query_id, chunk_pos, bm25 of every query (query_id, text) and chunk of the index that share a term."""
    asked = materialise(retrieval.asked_terms(queries), "asked")
    found = materialise(postings(spark, path, materialise(asked.select("term").distinct(), "asked-terms")), "postings")
    n, avgdl = stats(spark, path).first()
    return retrieval.weighed(found, asked, n, avgdl, k1, b)


def bm25_first(spark: SparkSession, path: str, queries: DataFrame, k: int, k1: float = retrieval.K1, b: float = retrieval.B) -> DataFrame:
    """query_id, chunk_pos, bm25, rank: the first ``k`` chunks of the index for every query (query_id, text)."""
    asked = materialise(retrieval.asked_terms(queries), "asked")
    found = materialise(postings(spark, path, materialise(asked.select("term").distinct(), "asked-terms")), "postings")
    n, avgdl = stats(spark, path).first()
    return retrieval.first_by_terms(retrieval.lexical(found, asked, n, avgdl, k1, b), k)
