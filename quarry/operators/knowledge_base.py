"""The knowledge base as two tables, documents and chunks; every change gives a new table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import count_tokens
from quarry.operators import chunking, models
from quarry.storage import materialise


def stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: docs, chunks, indexed, pending, dim (of the first vector), tokens."""
    has = F.col("vector").isNotNull()
    of_chunks = chunks.agg(
        F.count("*").alias("chunks"),
        F.count_if(has).alias("indexed"),
        F.count_if(~has).alias("pending"),
        F.coalesce(F.min_by(F.when(has, F.size("vector")), F.when(has, F.col("chunk_pos"))), F.lit(0)).cast("long").alias("dim"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    return docs.agg(F.count("*").alias("docs")).crossJoin(of_chunks)


def chunk_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return docs.join(n, "doc_id", "left").fillna(0, ["n_chunks"])


def _matching(chunks: DataFrame, keyword: str, doc_id: int | None) -> DataFrame:
    found = chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)
    return found.where(F.instr(F.lower("text"), F.lit(keyword.lower())) > 0) if keyword else found


def browse(chunks: DataFrame, keyword: str = "", doc_id: int | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of chunks that hold ``keyword`` in any case, literally."""
    found = _matching(chunks, keyword, doc_id)
    return found.withColumn("has_vector", F.col("vector").isNotNull()).orderBy("chunk_pos").offset(offset).limit(limit)


def browse_total(chunks: DataFrame, keyword: str = "", doc_id: int | None = None) -> DataFrame:
    """One row, total: how many chunks all pages of ``browse`` hold together."""
    return _matching(chunks, keyword, doc_id).agg(F.count("*").alias("total"))


def page_average(page: DataFrame) -> DataFrame:
    """One row, avg_tokens: the rounded average of a page's tokens, 0 for an empty page."""
    return page.agg(F.coalesce(F.floor(F.avg("tokens") + 0.5), F.lit(0)).cast("long").alias("avg_tokens"))


def add_documents(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``docs`` (doc_id, doc_name, status, tokens, ...) with ``new`` ones (doc_id, doc_name): parsed, not counted yet."""
    return docs.unionByName(new.withColumn("status", F.lit("parsed")).withColumn("tokens", F.lit(0).cast("long")), allowMissingColumns=True)


def clear(docs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Empty tables of the same columns."""
    return docs.where(F.lit(False)), chunks.where(F.lit(False))


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where("vector is null")


def update_chunks(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """New texts by chunk_id (chunk_id, new_text): tokens are counted again, the vector goes."""
    joined = chunks.join(changes, "chunk_id", "left")
    new = F.col("new_text").isNotNull()
    return joined.select(
        *[
            F.when(new, F.col("new_text")).otherwise(F.col("text")).alias("text") if c == "text"
            else F.when(new, count_tokens(F.col("new_text"))).otherwise(F.col("tokens")).alias("tokens") if c == "tokens"
            else F.when(~new, F.col("vector")).alias("vector") if c == "vector"
            else F.col(c)
            for c in chunks.columns
        ]
    )


def set_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors by chunk_id (chunk_id, new_vector)."""
    return chunks.join(vectors, "chunk_id", "left").withColumn("vector", F.coalesce("new_vector", "vector")).drop("new_vector").select(chunks.columns)


def delete_documents(docs: DataFrame, chunks: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks without those of ``gone`` (doc_id)."""
    return docs.join(gone, "doc_id", "left_anti"), chunks.join(gone, "doc_id", "left_anti")


def delete_chunks(chunks: DataFrame, gone: DataFrame) -> DataFrame:
    return chunks.join(gone, "chunk_id", "left_anti")


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` replaced; the new ones come last in order."""
    kept = chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(chunks.columns)
    last = kept.agg(F.coalesce(F.max("chunk_pos"), F.lit(-1)).alias("last"))
    moved = new.crossJoin(F.broadcast(last)).withColumn("chunk_pos", F.col("chunk_pos") + F.col("last") + 1).select(chunks.columns)
    return kept.union(moved)


def status(docs: DataFrame, chunks: DataFrame, rule: str = "any") -> DataFrame:
    """doc_id, status: parsed without chunks; indexed where any (after a build) or all (after a
    back-fill) chunks have vectors; else chunked."""
    has = F.col("vector").isNotNull()
    state = chunks.groupBy("doc_id").agg((F.bool_or(has) if rule == "any" else F.bool_and(has)).alias("ready"))
    return docs.select("doc_id").join(state, "doc_id", "left").select("doc_id", F.when(F.col("ready"), "indexed").when(F.col("ready").isNotNull(), "chunked").otherwise("parsed").alias("status"))


def add_chunks(chunks: DataFrame, texts: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks typed in by hand (chunk_id, doc_id, text): each numbered after its document's rows and those
    added with it, in order of chunk_id; after all other chunks in position; without vector.
    """
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("held"))
    last = chunks.agg(F.coalesce(F.max("chunk_pos"), F.lit(-1)).alias("last"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id"))
    named = texts.withColumn("place", place).join(counts, "doc_id", "left").join(docs.select("doc_id", "doc_name"), "doc_id", "left").crossJoin(F.broadcast(last))
    made = named.withColumns({
        "idx": (F.coalesce("held", F.lit(0)) + F.col("place") - 1).cast("int"), "doc_name": F.coalesce("doc_name", F.lit("手动新增")), "tokens": count_tokens(F.col("text")),
        "vector": F.lit(None).cast(chunks.schema["vector"].dataType), "chunk_pos": F.col("last") + 1 + F.monotonically_increasing_id(),
    })
    return chunks.unionByName(made.select(chunks.columns))


def build(docs: DataFrame, chunks: DataFrame, cfg: chunking.ChunkConfig, dim: int = models.DIM) -> DataFrame:
    """``chunks`` (chunk_id, chunk_pos, doc_id, idx, text, tokens, vector) with those of ``docs`` (doc_id, text) cut, embedded and put in place of the ones they had."""
    made = preview(docs, cfg).withColumn("chunk_id", F.sha2(F.to_json(F.struct("doc_id", "idx", "text")), 256).cast(chunks.schema["chunk_id"].dataType))
    whole = materialise(models.with_vectors(made, dim).withColumn("vector", F.col("vector").cast(chunks.schema["vector"].dataType)), "chunks")
    return replace_chunks(chunks, whole.withColumn("chunk_pos", F.monotonically_increasing_id()).select(chunks.columns))


def preview(docs: DataFrame, cfg: chunking.ChunkConfig, most: int | None = None) -> DataFrame:
    """doc_id, idx, text, tokens of the chunks that a build would make, the first ``most`` of each document; nothing is written."""
    made = chunking.chunk(docs, cfg)
    return made if most is None else made.where(F.col("idx") < most)


def index_pending(chunks: DataFrame, dim: int = models.DIM) -> DataFrame:
    """``chunks`` with offline vectors for those that have none, each worked out from its own row's text."""
    kind = chunks.schema["vector"].dataType
    made = models.with_vectors(pending(chunks).drop("vector"), dim).withColumn("vector", F.col("vector").cast(kind))
    return chunks.where("vector is not null").unionByName(made.select(chunks.columns))
