"""A training corpus from ``documents``: language, quality, near duplicates, decontamination, packing.

Each stage is one operator of quarry.llm over all that the stage before kept. All
but the last return the columns of documents; rows are only ever left out for the
operator's decision. A null doc_id is matched as a value of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate as contamination
from quarry.llm import language_id, near_duplicates, packing, quality
from quarry.llm.keys import KEY, keyed
from quarry.storage import materialise, table


def _matching(docs: DataFrame, decided: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` whose id and text are (``left_semi``) or aren't in ``decided`` (doc_id, KEY)."""
    own = keyed(docs)
    decided = decided.select(F.col("doc_id").alias("__id"), *[F.col(k).alias(f"{k}d") for k in KEY])
    same = own["doc_id"].eqNullSafe(decided["__id"])
    for k in KEY:
        same = same & (own[k] == decided[f"{k}d"])
    return own.join(decided, same, how).drop(*KEY)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with a narrow margin go."""
    # whole rows go through Python here: small batches keep its workers small
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    found = language_id.identify(docs, language_id.learn(docs), prefix="__", columns=docs.columns)
    return found.where("not __rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the log-likelihood ratio."""
    kept = quality.judge(docs, table(spark, sf_dir, "labels")).where("kept")
    return _matching(docs, kept, "left_semi")


def near_duplicate_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the least doc_id of each class, null ids last; rows equal in all columns are one."""
    return near_duplicates.representatives(docs, docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    found = contamination.decide(docs, table(spark, sf_dir, "benchmark"))
    return _matching(docs, found.where("n_hit > 0"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicate_join),
    ("benchmark decontamination", decontamination),
    ("packing", pack),
]

#: Compression sizes, hashes and tokenizers aren't SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
