"""Operator 10, language ID: the smallest encoding under per-language dictionaries.

Each language has a zstandard raw-content dictionary of whole training texts. Texts
are reduced to lower-case letters with single blanks first, so that case, digits and
marks don't stand between a text and its language. A text is compressed with every one; the language whose dictionary gives the fewest
bytes is predicted. The margin is what the runner-up needs more, as a share of the
runner-up. A margin below ``min_margin`` counts as rejected.

Null texts and texts without a letter are ``und`` with score 0 and rejected. Equal
sizes go to the language first in order, with score 0. Texts of any length are compressed
whole; repeated rows get equal answers; null ids are ids. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.batches import slices

#: Texts drawn per language for its dictionary, the dictionary's bytes, and those of all dictionaries, which share them where languages are many.
SAMPLE_TEXTS = 300
DICT_BYTES, LEAST_BYTES = 256 << 10, 64
MODEL_BYTES = 64 << 20
LEVEL = 6


def letters(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " "))


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, dict_bytes: int = DICT_BYTES, model_bytes: int = MODEL_BYTES) -> dict[str, bytes]:
    """language -> dictionary, from rows with a text and a lang.

    The ``sample_texts`` distinct texts of each language with the least hashes fill
    up to ``dict_bytes``; this is the bounded sample that the model is fitted on. It is
    cut to 2 * ``dict_bytes`` a language before it comes to the driver. Copies count
    once, so every language with a text has a dictionary; more than ``model_bytes`` /
    ``dict_bytes`` languages have smaller ones, of fewer texts.
    """
    known = docs.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", letters("text").alias("text"))
    known = known.withColumn("h", F.xxhash64("text"))
    distinct = known.select("lang", "h").distinct()
    n = max(1, distinct.select("lang").distinct().count())
    share = min(1.0, model_bytes / (n * dict_bytes))
    dict_bytes, sample_texts = max(LEAST_BYTES, int(dict_bytes * share)), max(1, int(sample_texts * share))
    least = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    sample = distinct.withColumn("k", least).where(F.col("k") <= sample_texts).drop("k")
    cut = F.left("text", F.lit(dict_bytes)).alias("text")  # more of a text has no room
    drawn = known.join(F.broadcast(sample), ["lang", "h"]).select("lang", "h", cut).distinct()
    before = F.sum(F.octet_length("text")).over(Window.partitionBy("lang").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, -1))
    drawn = drawn.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < dict_bytes)
    texts: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["h"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    out = {}
    for lang, found in sorted(texts.items()):
        raw = b"\n".join(t.encode() for t in found)[:dict_bytes]
        out[lang] = b"\n".join([raw] * -(-8 // len(raw)))  # of 8 bytes at least
    return out


_compressors: dict[tuple, list] = {}


def compressors(model: tuple[tuple[str, bytes], ...], level: int) -> list:
    import zstandard as zstd

    key = (hash(model), level)
    if key not in _compressors:
        made = []
        for _, raw in model:
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            made.append(zstd.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        _compressors[key] = made
    return _compressors[key]


def identify(docs: DataFrame, model: dict[str, bytes], min_margin: float = 0.005, level: int = LEVEL, prefix: str = "", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (doc_id alone if not given), lang_pred, score (the margin, 0 to 1) and
    rejected for every document. ``prefix`` goes before the three new names.
    """
    langs = tuple(sorted(model.items()))
    names = [k for k, _ in langs]
    cols = columns or ["doc_id"]
    tagged = docs.select(*[F.col(f"`{c}`") for c in cols], F.coalesce(letters(F.col("text")), F.lit("")).alias("__letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = compressors(langs, level)
        for b in slices(batches, "__letters"):
            raws = b.column("__letters").cast(pa.binary()).to_pylist()
            pred, score = ["und"] * len(raws), np.zeros(len(raws))
            for k, raw in enumerate(raws):
                if not raw or not made:
                    continue
                size = [len(c.compress(raw)) for c in made]
                best = size.index(low := min(size))
                rest = min((s for j, s in enumerate(size) if j != best), default=2 * low)
                pred[k], score[k] = names[best], (rest - low) / rest
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(pred), pa.array(score)], [*cols, "__pred", "__score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tagged.drop("__letters").schema)
    found = tagged.mapInArrow(run, f"{kinds}, __pred string, __score double")
    rejected = (F.col("__pred") == "und") | (F.col("__score") < min_margin)
    return found.select(*[F.col(f"`{c}`") for c in cols], F.col("__pred").alias(f"{prefix}lang_pred"), F.col("__score").alias(f"{prefix}score"), rejected.alias(f"{prefix}rejected"))
