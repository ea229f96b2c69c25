"""Cutting texts into chunks: four strategies with overlap, as array expressions over documents.

A text becomes an array of parts or sentences with their weights; one fold over
the weights finds where chunks begin and end (its state is a running weight that starts
anew with each chunk), and slices of the array are the chunks. Weights are whole
twentieths of a token, so a fold only adds numbers; the text itself is weighed again
only where its sum is a half token, as there rounding decides. Fixed windows over units are
found by search in running sums (windows.py), as array expressions have no running sum.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.text import SPACE, count_tokens, trim, twentieths
from quarry.operators.models import following_cosines
from quarry.operators.windows import recursive_blocks, windows
from quarry.storage import materialise

#: The separators of the recursive strategy, coarse to fine; tokens of a small last paragraph; least group of the semantic strategy.
SEPARATORS = ["\n\n", "\n", "。", "！", "？", ". ", "；", "，", " "]
SMALL, LEAST_GROUP = 60, 128
HEADING = f"^#{{1,6}}[{SPACE}]+"

Embed = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "fixed"
    size: int = 512
    overlap_enabled: bool = True
    overlap_mode: str = "percent"
    overlap_value: float = 15
    semantic_max: int = 700
    semantic_min: int = 80
    threshold: float = 0.55
    threshold_mode: str = "absolute"
    percentile: float = 85
    offline_vectors: bool = False
    paragraph_max: int = 800
    merge_small: bool = True
    overlap_paragraphs: int = 1
    markdown: bool = True

    @property
    def overlap(self) -> float:
        if not self.overlap_enabled:
            return 0
        if self.overlap_mode == "percent":
            return max(0, math.floor(self.size * self.overlap_value / 100 + 0.5))
        return max(0, self.overlap_value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_weight(u: Column) -> Column:
    """Weight of a unit as a double: quarters add up exactly, blanks one by one."""
    return F.when(u == " ", 0.2).when(u.rlike("^[A-Za-z0-9]"), 0.25 * F.length(u)).when(u.rlike(f"^[{SPACE}]"), T.weight(u)).when(u.rlike(f"^[{T.CJK}]"), 1.0).otherwise(0.25)


def _cuts(state: Column, a: Column, b: Column) -> Column:
    return F.array_append(state["cuts"], F.struct(a.alias("a"), b.alias("b")))


_NO_CUTS = "array<struct<a:int,b:int>>"


def _glued(parts: Column, lo: Column, hi: Column, glue: str) -> Column:
    """Parts lo to hi as one text."""
    return F.array_join(F.slice(parts, lo + 1, hi - lo + 1), glue)


def _tokens(q: Column, text: Column) -> Column:
    return F.when(q % 20 != 10, F.floor((q + 10) / 20)).otherwise(count_tokens(text))


def greedy(df: DataFrame, limit: float, glue: str) -> DataFrame:
    """``df`` with ``blocks``: its non-empty ``parts`` joined from the left while they stay within ``limit`` tokens."""
    parts, q = F.col("parts"), F.col("__q")
    df = df.withColumn("__q", F.transform("parts", twentieths))

    def state(lo: Column, n: Column, cuts: Column) -> Column:
        return F.struct(lo.alias("lo"), n.cast("long").alias("n"), cuts.alias("cuts"))

    def step(s: Column, i: Column) -> Column:
        def grown(n: Column) -> Column:
            return F.when(_tokens(n, _glued(parts, s["lo"], i, glue)) > limit, state(i, q[i], _cuts(s, s["lo"], i - 1))).otherwise(state(s["lo"], n, s["cuts"]))

        return F.when(i == 0, state(s["lo"], q[i], s["cuts"])).otherwise(let(s["n"] + 4 * len(glue) + q[i], grown))

    end = F.size("parts") - 1
    start = state(F.lit(0), F.lit(0), F.array().cast(_NO_CUTS))
    cuts = F.aggregate(F.sequence(F.lit(0), end), start, step, lambda s: _cuts(s, s["lo"], end))
    df = df.withColumn("__cuts", F.when(end >= 0, cuts).otherwise(F.array().cast(_NO_CUTS)))
    df = df.withColumn("__blocks", F.transform("__cuts", lambda c: trim(_glued(parts, c["a"], c["b"], glue))))
    blocks = F.col("__blocks")
    whole = F.when((F.size(blocks) > 0) & (F.element_at(blocks, -1) == ""), F.slice(blocks, 1, F.size(blocks) - 1)).otherwise(blocks)
    return df.withColumn("blocks", whole).drop("__q", "__cuts", "__blocks")


def merge_last(blocks: Column, least: float, glue: str) -> Column:
    """A last block of fewer than ``least`` tokens goes to the one before."""
    n = F.size(blocks)
    joined = F.concat(F.slice(blocks, 1, n - 2), F.array(F.concat(blocks[n - 2], F.lit(glue), blocks[n - 1])))
    return F.when((n > 1) & (count_tokens(F.get(blocks, n - 1)) < least), joined).otherwise(blocks)


def tail(c: Column, n: float) -> Column:
    """The last units of a text that are worth ``n``."""
    step = lambda a, u: F.when(a["w"] < n, F.struct((a["n"] + 1).alias("n"), (a["w"] + unit_weight(u)).alias("w"))).otherwise(a)
    count = lambda us: F.aggregate(F.reverse(us), F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("w")), step, lambda a: a["n"])
    return let(T.units(c), lambda us: let(count(us), lambda k: trim(F.array_join(F.slice(us, F.size(us) - k + 1, k), ""))))


def with_heads(df: DataFrame, head: Callable[[Column], Column], glue: str) -> DataFrame:
    """``df`` whose ``blocks`` begin with the head of the block before, as it was."""
    df = df.withColumn("__heads", F.when(F.size("blocks") > 1, F.transform("blocks", head)))
    h = F.col("__heads")
    named = lambda c, i: F.when((i > 0) & (h[F.greatest(i - 1, F.lit(0))] != ""), F.concat(h[F.greatest(i - 1, F.lit(0))], F.lit(glue), c)).otherwise(c)
    return df.withColumn("__named", F.when(h.isNull(), F.col("blocks")).otherwise(F.transform("blocks", lambda c, i: F.when(i > 0, trim(named(c, i))).otherwise(c)))).drop("blocks", "__heads").withColumnRenamed("__named", "blocks")


def move_headings(df: DataFrame) -> DataFrame:
    """``df`` with the heading that ends one of ``blocks`` at the head of the next; empty blocks go."""
    end = F.size("blocks") - 1

    def state(head: Column, out: Column) -> Column:
        return F.struct(head.cast("string").alias("head"), out.alias("out"))

    def placed(s: Column, c: Column, i: Column) -> Column:
        def split(lines: Column) -> Column:
            last = trim(F.element_at(lines, -1))
            moved = state(last, F.array_append(s["out"], trim(F.array_join(F.slice(lines, 1, F.size(lines) - 1), "\n"))))
            return F.when((F.size(lines) > 1) & last.rlike(HEADING), moved).otherwise(state(F.lit(None), F.array_append(s["out"], c)))

        return F.when((i < end) & c.contains("#"), let(F.split(c, "\n"), split)).otherwise(state(F.lit(None), F.array_append(s["out"], c)))

    def step(s: Column, i: Column) -> Column:
        c = F.col("blocks")[i]
        return let(F.when(s["head"].isNotNull(), trim(F.concat(s["head"], F.lit("\n"), c))).otherwise(c), lambda own: placed(s, own, i))

    fold = F.aggregate(F.sequence(F.lit(0), end), state(F.lit(None), F.array().cast("array<string>")), step, lambda s: s["out"])
    some = F.exists("blocks", lambda c: c.contains("#"))
    df = df.withColumn("__moved", F.when((end > 0) & some, fold).otherwise(F.col("blocks")))
    return df.drop("blocks").withColumn("blocks", F.filter("__moved", lambda c: c != "")).drop("__moved")


# -- the semantic strategy ------------------------------------------------------------------


def sentence_vectors(sentences: DataFrame, embed: Embed) -> DataFrame:
    """key, i, s, vector, error of every sentence (key, i, s); a batch whose ``embed`` fails has an error instead of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column("s").to_pylist()
            try:
                vectors, error = [list(map(float, v)) for v in embed(said)], None
                if len(vectors) != len(said):
                    raise ValueError(f"{len(vectors)} vectors for {len(said)} sentences")
            except Exception as e:  # a provider may raise anything; the row says what
                vectors, error = [None] * len(said), str(e) or type(e).__name__
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "i", "s")), pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * len(said), pa.string())], ["key", "i", "s", "vector", "error"])

    return materialise(sentences.mapInArrow(run, "key long, i int, s string, vector array<double>, error string"), "sentences")


def semantic_groups(df: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """``blocks`` of rows of ``parts`` (two sentences at least) and ``sims`` of neighbours: sentences grouped
    until neighbours differ or a group is full; then small groups are merged. ``threshold`` is what was used.
    """
    most = max(LEAST_GROUP, (cfg.semantic_max or 700) - cfg.overlap)
    if cfg.threshold_mode == "percentile":
        p = min(100, max(0, cfg.percentile or 85)) / 100
        limit = F.array_sort("sims")[F.floor((F.size("sims") - 1) * p).cast("int")]
    else:
        limit = F.lit(float(cfg.threshold or 0.55))
    df = df.withColumn("threshold", limit).withColumn("__n", F.transform("parts", count_tokens))
    n, end = F.col("__n"), F.size("parts") - 1

    def state(lo: Column, total: Column, cuts: Column) -> Column:
        return F.struct(lo.alias("lo"), total.alias("total"), cuts.alias("cuts"))

    def step(s: Column, i: Column) -> Column:
        apart = (F.col("sims")[i - 1] < F.col("threshold")) | (s["total"] + n[i] > most)
        return F.when(apart, state(i, n[i], _cuts(s, s["lo"], i - 1))).otherwise(state(s["lo"], s["total"] + n[i], s["cuts"]))

    start = state(F.lit(0), n[0], F.array().cast(_NO_CUTS))
    df = df.withColumn("__cuts", F.aggregate(F.sequence(F.lit(1), end), start, step, lambda s: _cuts(s, s["lo"], end)))
    df = df.withColumn("__groups", F.transform("__cuts", lambda c: _glued(F.col("parts"), c["a"], c["b"], "")))

    def merge(out: Column, g: Column) -> Column:
        k = F.size(out)
        last = lambda f: let(count_tokens(F.element_at(out, -1)), lambda a: let(count_tokens(g), lambda b: f(a, b)))
        fits = last(lambda a, b: (F.least(a, b) < (cfg.semantic_min or 80)) & (a + b <= most))
        joined = F.concat(F.slice(out, 1, k - 1), F.array(F.concat(F.element_at(out, -1), g)))
        return F.when(k == 0, F.array(g)).otherwise(F.when(fits, joined).otherwise(F.array_append(out, g)))

    merged = F.aggregate("__groups", F.array().cast("array<string>"), merge)
    return df.withColumn("blocks", F.filter(F.transform(merged, trim), lambda c: c != "")).drop("__n", "__cuts", "__groups")


def _fallback(df: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """Sentences joined up to a length, for texts without vectors."""
    return greedy(df, cfg.semantic_max or 700, "").withColumn("blocks", merge_last(F.col("blocks"), cfg.semantic_min or 80, ""))


def _semantic(df: DataFrame, cfg: ChunkConfig, embed: Embed | None) -> DataFrame:
    none = F.lit(None).cast("double").alias("threshold")
    if embed is None and cfg.offline_vectors:
        return _offline(df, cfg)
    df = df.withColumn("parts", T.sentences(F.col("text")))
    if embed is None:
        return _fallback(df, cfg).withColumn("degraded", F.lit("no-embedding")).withColumn("threshold", none)
    df = materialise(df.withColumn("key", F.monotonically_increasing_id()), "texts")
    many = F.size("parts") > 1
    named = sentence_vectors(df.where(many).select("key", F.posexplode("parts").alias("i", "s")), embed)
    after = F.lead("vector").over(Window.partitionBy("key").orderBy("i"))
    held = named.withColumn("sim", T.cosine(F.col("vector"), after)).groupBy("key").agg(
        F.max("error").alias("error"), F.array_sort(F.collect_list(F.struct("i", "sim"))).alias("l")
    )
    found = df.join(held, "key", "left").withColumn("sims", F.transform(F.slice("l", 1, F.size("l") - 1), lambda x: x["sim"])).drop("l")
    return _by_vectors(found, cfg)


_SENTENCES, _CJK = re.compile(T.SENTENCES), re.compile(f"[{T.CJK}]")
_BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def _said(text: str) -> list[str]:
    """As functions.text.sentences."""
    found = (s.strip(_BLANKS) for s in _SENTENCES.findall(text.replace("\r\n", "\n").replace("\r", "\n")))
    return [s for s in found if s]


def _counted(text: str) -> int:
    """As functions.text.count_tokens."""
    q = 5 * len(text) - text.count(" ") - text.count("\n") - text.count("\t") + (0 if text.isascii() else 15 * len(_CJK.findall(text)))
    if q % 20 != 10 and len(text) <= T.EXACT:
        return (q + 10) // 20
    total = 0.0
    for c in text:  # from the left, as doubles
        total += 0.2 if c in " \n\t" else 1.0 if _CJK.match(c) else 0.25
    return math.floor(total + 0.5)


def _grouped(parts: list[str], sims: list[float], threshold: float, most: int, least: int) -> list[str]:
    """As ``semantic_groups``, of one text."""
    groups, own, total = [], [parts[0]], _counted(parts[0])
    for part, sim in zip(parts[1:], sims):
        n = _counted(part)
        if sim < threshold or total + n > most:
            groups, own, total = [*groups, "".join(own)], [part], n
        else:
            own.append(part)
            total += n
    merged, last = [], 0
    for g in [*groups, "".join(own)]:
        n = _counted(g)
        if merged and min(last, n) < least and last + n <= most:
            merged[-1] += g
            last = _counted(merged[-1])
        else:
            merged.append(g)
            last = n
    return [c for c in (g.strip(_BLANKS) for g in merged) if c]


def _offline(df: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """Chunks of doc_id, text by the offline model's vectors, in one pass where the text is; a text of one sentence is cut by length."""
    most, least = max(LEAST_GROUP, (cfg.semantic_max or 700) - cfg.overlap), cfg.semantic_min or 80
    p = min(100, max(0, cfg.percentile or 85)) / 100 if cfg.threshold_mode == "percentile" else None
    fixed = float(cfg.threshold or 0.55)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = [_said(t) for t in b.column("text").to_pylist()]
            sims, lo, blocks, few, limits = following_cosines([s for parts in lists for s in parts]).tolist(), 0, [], [], []
            for parts in lists:
                own, lo, many = sims[lo : lo + len(parts) - 1] if parts else [], lo + len(parts), len(parts) > 1
                limits.append((fixed if p is None else sorted(own)[math.floor((len(own) - 1) * p)]) if many else None)
                blocks.append(_grouped(parts, own, limits[-1], most, least) if many else None)
                few.append(None if many else parts)
            strings = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(few, strings), pa.array(blocks, strings), pa.array(limits, pa.float64())], ["doc_id", "parts", "blocks", "threshold"])

    kind = df.schema["doc_id"].dataType.simpleString()
    found = materialise(df.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, parts array<string>, blocks array<string>, threshold double"), "groups")
    fine, none = found.where("parts is null").drop("parts"), F.lit(None)
    if cfg.overlap > 0:
        fine = with_heads(fine, lambda c: tail(c, cfg.overlap), "\n")
    rest = _fallback(found.where("parts is not null").select("doc_id", "parts"), cfg).withColumn("degraded", F.lit("too-few-sentences")).withColumn("threshold", none.cast("double"))
    kept = ["doc_id", "blocks", "degraded", "threshold"]
    return fine.withColumn("degraded", none.cast("string")).select(kept).unionByName(rest.select(kept))


def _by_vectors(found: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """Chunks of rows of doc_id, parts, sims and error; by length where there is one sentence or an error."""
    many, none = F.size("parts") > 1, F.lit(None).cast("double").alias("threshold")
    fine = semantic_groups(found.where(many & F.col("error").isNull()), cfg)
    if cfg.overlap > 0:
        fine = with_heads(fine, lambda c: tail(c, cfg.overlap), "\n")
    why = F.when(~many, "too-few-sentences").otherwise(F.concat(F.lit("embed-failed: "), "error"))
    rest = _fallback(found.where(~many | F.col("error").isNotNull()), cfg).withColumn("degraded", why).withColumn("threshold", none)
    kept = ["doc_id", "blocks", "degraded", "threshold"]
    return fine.withColumn("degraded", F.lit(None).cast("string")).select(kept).unionByName(rest.select(kept))


# -- chunks ---------------------------------------------------------------------------------


def cut(docs: DataFrame, cfg: ChunkConfig, embed: Embed | None = None) -> DataFrame:
    """doc_id, blocks (the chunks' texts), degraded, threshold of every document (doc_id, text) that has text.

    ``embed`` maps sentences to vectors (semantic); ``offline_vectors`` takes the offline model's
    instead. Without either, or where it fails or there is one sentence, sentences are joined
    by length and ``degraded`` says why.
    """
    df = docs.select("doc_id", "text").where(trim(F.col("text")) != "")
    if cfg.strategy == "semantic":
        df = _semantic(df, cfg, embed)
    else:
        if cfg.strategy == "recursive":
            df = recursive_blocks(df, cfg.size, cfg.overlap, SEPARATORS, ["doc_id"])
        elif cfg.strategy == "paragraph":
            df = greedy(df.withColumn("parts", T.paragraphs(F.col("text"))), cfg.paragraph_max or 800, "\n\n")
            if cfg.merge_small:
                df = df.withColumn("blocks", merge_last(F.col("blocks"), SMALL, "\n\n"))
            if cfg.overlap_paragraphs > 0:
                k = cfg.overlap_paragraphs
                df = with_heads(df, lambda c: let(T.paragraphs(c), lambda ps: F.array_join(F.slice(ps, F.greatest(F.size(ps) - k, F.lit(0)) + 1, k), "\n\n")), "\n\n")
        else:
            df = fixed_windows(df, cfg).withColumn("blocks", F.transform("windows", lambda w: w["text"]))
        df = df.withColumn("degraded", F.lit(None).cast("string")).withColumn("threshold", F.lit(None).cast("double"))
    df = df.select("doc_id", "blocks", "degraded", "threshold")
    if cfg.markdown:
        df = move_headings(df)
    return df.select("doc_id", F.transform("blocks", trim).alias("blocks"), "degraded", "threshold")


def fixed_windows(docs: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """doc_id, windows (text, begin, end, tokens; places in characters) of every document that has text, by the fixed strategy."""
    some = docs.select("doc_id", "text").where(trim(F.col("text")) != "")
    return windows(some, cfg.size or 512, cfg.overlap, ["doc_id"])


def as_windows(cfg: ChunkConfig) -> bool:
    """Whether chunks are the windows as they are: no heading moves."""
    return cfg.strategy not in ("recursive", "paragraph", "semantic") and not cfg.markdown


def chunk(docs: DataFrame, cfg: ChunkConfig, embed: Embed | None = None) -> DataFrame:
    """doc_id, idx, text, tokens of every chunk; an empty chunk goes, and leaves its place in ``idx`` free."""
    if as_windows(cfg):
        each = fixed_windows(docs, cfg).select("doc_id", F.posexplode("windows").alias("idx", "w"))
        return each.select("doc_id", "idx", "w.text", "w.tokens")
    # outer: no filter on the array is inferred, which would be pushed down and work every array out again
    each = cut(docs, cfg, embed).select("doc_id", F.posexplode_outer("blocks").alias("idx", "text"))
    return each.where("text <> ''").withColumn("tokens", count_tokens(F.col("text")))


def chunk_spans(docs: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """doc_id, idx, begin, end: which characters of its text each chunk of the fixed strategy is."""
    each = fixed_windows(docs, cfg).select("doc_id", F.posexplode("windows").alias("idx", "w"))
    return each.select("doc_id", "idx", "w.begin", "w.end")


def coverage(docs: DataFrame, cfg: ChunkConfig) -> DataFrame:
    """doc_id, n_chunks, covered (characters in some chunk) and shared (in two or more neighbours, with repeats), as chunks really
    lie; planned: the share of a chunk that the configured overlap is.
    """
    w = F.col("windows")
    before = lambda i: F.when(i > 0, F.get(w, i - 1)["end"]).otherwise(0)
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + x)
    fresh = F.transform(w, lambda x, i: x["end"] - F.greatest(x["begin"], before(i)))
    again = F.transform(w, lambda x, i: F.greatest(before(i) - x["begin"], F.lit(0)))
    planned = F.lit(math.floor(100 * cfg.overlap / (cfg.size or 512) + 0.5))
    return fixed_windows(docs, cfg).select("doc_id", F.size(w).cast("long").alias("n_chunks"), total(fresh).alias("covered"), total(again).alias("shared"), planned.alias("planned"))


def chunk_meta(docs: DataFrame, cfg: ChunkConfig, embed: Embed | None = None) -> DataFrame:
    """One row for each document with text: doc_id, strategy, degraded, threshold, n_chunks, the tokens' average, least and largest, overlap_tokens."""
    if as_windows(cfg):
        none = F.lit(None)
        found = fixed_windows(docs, cfg).select("doc_id", F.transform("windows", lambda w: w["tokens"]).alias("n"), none.cast("string").alias("degraded"), none.cast("double").alias("threshold"))
    else:
        found = cut(docs, cfg, embed).withColumn("n", F.transform(F.filter("blocks", lambda c: c != ""), count_tokens))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    none = F.lit(0).cast("long")
    return found.select(
        "doc_id", F.lit(cfg.strategy).alias("strategy"), "degraded", F.round("threshold", 4).alias("threshold"), F.size("n").cast("long").alias("n_chunks"),
        F.when(F.size("n") > 0, F.floor(total / F.size("n") + 0.5)).otherwise(none).alias("avg_tokens"),
        F.coalesce(F.array_min("n"), none).alias("min_tokens"), F.coalesce(F.array_max("n"), none).alias("max_tokens"),
        F.lit(float(cfg.overlap)).alias("overlap_tokens"),
    )
