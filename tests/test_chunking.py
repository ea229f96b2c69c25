"""The chunk strategies as array expressions against the plain ones, one text at a time."""

import math
import random

import plain_chunks as plain
import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, models
from quarry.operators.chunking import ChunkConfig

PIECES = ["word", "two words", "句子", "今天天气不错。", "我们去散步吧！", "x1.5", " ", "  ", "\n", "\n\n", "\r\n", "\t", "? ", ". ", "；", "，", "　", "é", "# Title\n", "\n## Sub", "!", '"', "a" * 70, "\n \n", "12", "end. "]
CONFIGS = [
    ChunkConfig(size=20, overlap_enabled=False, markdown=False), ChunkConfig(size=20, overlap_mode="absolute", overlap_value=8), ChunkConfig(size=4, overlap_mode="absolute", overlap_value=0.5, markdown=False),
    ChunkConfig(size=6, overlap_mode="absolute", overlap_value=30), ChunkConfig("recursive", size=16, overlap_enabled=False), ChunkConfig("recursive", size=30, markdown=False), ChunkConfig("paragraph", paragraph_max=40),
    ChunkConfig("paragraph", paragraph_max=100, overlap_paragraphs=2, merge_small=False, markdown=False), ChunkConfig("paragraph", paragraph_max=90, overlap_paragraphs=0), ChunkConfig("semantic", semantic_max=30, semantic_min=10), ChunkConfig("other", size=50),
]
r = random.Random(4)
TEXTS = ["".join(r.choice(PIECES) for _ in range(r.choice([1, 3, 20, 80, 300]))) for _ in range(60)]
TEXTS += ["一二三四", "text\n## Title\n\nbody", "# Only", " \n ", "", None, "word " * 5000, "。" * 300, "x" * 3000]


def _embedder():
    def embed(sentences):  # inside, so that it goes to the workers by value
        return [[float(sum(ord(c) % 8 == k for c in s)) for k in range(8)] for s in sentences]

    return embed


embed = _embedder()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "z") for k, t in enumerate(TEXTS)], "doc_id long, text string, tokens string").repartition(4).cache()


def of(rows):
    out = {}
    for x in rows:
        out.setdefault(x["doc_id"], []).append((x["idx"], x["text"], x["tokens"]))
    return {k: sorted(v) for k, v in out.items()}


def expected(cfg, embed=None):
    found = {k: plain.cut(t, cfg, embed) for k, t in enumerate(TEXTS)}
    return {k: [(c, plain.tokens(c)) for c in v] for k, v in found.items() if v}


@pytest.mark.parametrize("cfg", CONFIGS, ids=str)
def test_strategies_equal_the_plain_ones(docs, cfg):
    got = of(chunking.chunk(docs, cfg).collect())
    assert {k: [(t, n) for _, t, n in v] for k, v in got.items()} == expected(cfg)
    if cfg.markdown:
        assert all([i for i, _, _ in v] == list(range(len(v))) for v in got.values())


@pytest.mark.parametrize("mode", ["absolute", "percentile"])
def test_semantic_groups_equal_the_plain_ones(docs, mode):
    cfg = ChunkConfig("semantic", semantic_max=200, semantic_min=40, size=40, threshold=0.8, threshold_mode=mode)
    got = of(chunking.chunk(docs, cfg, embed).collect())
    assert {k: [(t, n) for _, t, n in v] for k, v in got.items()} == expected(cfg, embed)


def test_degraded_says_why(docs):
    def broken(sentences):
        raise RuntimeError("no service")

    cfg = ChunkConfig("semantic", semantic_max=30, semantic_min=10)
    why = lambda e: {x["doc_id"]: x["degraded"] for x in chunking.chunk_meta(docs, cfg, e).collect()}
    many = {k for k, t in enumerate(TEXTS) if t and t.strip() and len(plain.split_sentences(t)) > 1}
    assert set(why(None).values()) == {"no-embedding"}
    assert why(broken) == {k: "embed-failed: no service" if k in many else "too-few-sentences" for k in why(None)}
    assert why(embed) == {k: None if k in many else "too-few-sentences" for k in why(None)}
    assert of(chunking.chunk(docs, cfg, broken).collect()) == of(chunking.chunk(docs, cfg).collect())


def test_meta(docs):
    cfg = ChunkConfig("recursive", size=30)
    want = expected(cfg)
    for x in chunking.chunk_meta(docs, cfg).collect():
        n = [t for _, t in want.get(x["doc_id"], [])]
        assert (x["n_chunks"], x["avg_tokens"], x["min_tokens"], x["max_tokens"]) == ((len(n), math.floor(sum(n) / len(n) + 0.5), min(n), max(n)) if n else (0, 0, 0, 0))
        assert (x["strategy"], x["overlap_tokens"], x["threshold"]) == ("recursive", 5.0, None)


def test_empty_table_and_ends_on_a_boundary(spark, docs):
    for cfg in CONFIGS:
        assert chunking.chunk(docs.limit(0), cfg).isEmpty()
    one = spark.createDataFrame([(1, "一二三四")], "doc_id long, text string")
    cut = lambda size, lap: [x["text"] for x in chunking.chunk(one, ChunkConfig(size=size, overlap_mode="absolute", overlap_value=lap)).orderBy("idx").collect()]
    assert cut(4, 2) == ["一二三四", "三四"] and cut(2, 1) == ["一二", "二三", "三四", "四"]


def test_token_counts_near_a_half(spark):
    texts = [" " * a + "x" * b + "句" * c for a in range(0, 60) for b in range(0, 12, 3) for c in (0, 1)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunking.count_tokens(F.col("t")).alias("n")).collect()
    assert all(x["n"] == plain.tokens(x["t"]) for x in rows)


def test_neighbours_by_the_offline_model(spark):
    """Cosines of sentences in a task equal those of the model's vectors; blocks of sentences meet at their ends."""
    import numpy as np

    from quarry.operators import models

    texts = [["alpha beta gamma.", "Beta GAMMA, delta!", "", "人工智能 学习", "智能学习。", "x" * 70 + " alpha"], [], ["one"], ["same words", "same words"], None, ["a-b_c a-b_c", "... !", "a-b_c"]]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, parts array<string>")
    said = spark.createDataFrame([(100 * i + k, s) for i, t in enumerate(texts) for k, s in enumerate(t or [])], "key long, text string")
    v = {r["key"]: np.array(r["vector"]) for r in models.embed(said, "key", 64).collect()}
    for chars in (1, 40, 1 << 19):
        old, models.SENTENCE_CHARS = models.SENTENCE_CHARS, chars
        got = {r["doc_id"]: r["sims"] for r in models.neighbour_cosines(frame, "parts", dim=64).collect()}
        models.SENTENCE_CHARS = old
        for i, t in enumerate(texts):
            pairs = [(v[100 * i + k], v[100 * i + k + 1]) for k in range(len(t or []) - 1)]
            want = [float(a @ b / np.sqrt((a @ a) * (b @ b))) if (a @ a) * (b @ b) > 0 else 0.0 for a, b in pairs]
            assert got[i] == pytest.approx(want, abs=1e-9)


def test_spans_give_the_texts_back(spark):
    """A chunk is its span of the text; what no chunk covers is blank."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for cfg in CONFIGS[0], ChunkConfig(size=4, overlap_mode="absolute", overlap_value=2, markdown=False):
        texts = {(x["doc_id"], x["idx"]): x["text"] for x in chunking.chunk(docs, cfg).collect()}
        spans = chunking.chunk_spans(docs, cfg).collect()
        assert {(x["doc_id"], x["idx"]): TEXTS[x["doc_id"]][x["begin"] : x["end"]] for x in spans} == texts
        inside = {}
        for x in spans:
            inside.setdefault(x["doc_id"], []).extend(range(x["begin"], x["end"]))
        for x in chunking.coverage(docs, cfg).collect():
            own = inside[x["doc_id"]]
            rest = [c for k, c in enumerate(TEXTS[x["doc_id"]]) if k not in set(own)]
            assert x["covered"] == len(set(own)) and not plain._strip("".join(rest)) and x["shared"] >= len(own) - len(set(own))


def test_windows_of_odd_units():
    from quarry.operators import windows

    some = ["1.2.3.4", "1.2.3.4.", ".5 6.", "🙂12🙂", " 　\t ", "a" * 70 + "人", "x1.5y", "2.5" * 9]
    r = random.Random(8)
    for _ in range(400):
        text = "".join(r.choice(some + PIECES) for _ in range(r.choice([0, 1, 4, 25])))
        for size, overlap in ((4, 0), (4, 0.5), (6, 30), (1, 1), (2.5, 0.2), (0.25, 3)):
            assert [text[a:b] for a, b, _ in windows.spans(text, size, overlap)] == plain.slide(text, size, overlap)
            assert all(k == plain.tokens(text[a:b]) for a, b, k in windows.spans(text, size, overlap))


def test_vectors_are_made_where_the_rows_are(spark):
    """They equal the model's components, need no exchange, and stand by rows of one key as well."""
    import numpy as np

    from quarry.operators import models

    texts = ["alpha beta gamma.", None, "", "人工智能 学习 K", "x" * 70 + " alpha alpha", "... !", "a-b_c a-b_c İ", "one two " * 500] + [f"w{k} w{k * k}" for k in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    want = {k: np.zeros(64) for k in range(len(texts))}
    for r in models.components(frame, "key", 64).collect():
        want[r["key"]][r["idx"]] = r["value"]
    made = models.with_vectors(frame, 64)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    for chars in (1, 1 << 17):
        old, models.SENTENCE_CHARS = models.SENTENCE_CHARS, chars
        got = {r["key"]: r["vector"] for r in made.collect()}
        models.SENTENCE_CHARS = old
        assert all(got[k] == v.tolist() for k, v in want.items())
    twice = models.with_vectors(frame.limit(1).union(frame.where("key = 3").withColumn("key", F.lit(0).cast("long"))), 64).collect()
    assert [r["vector"] for r in twice] == [want[0].tolist(), want[3].tolist()]


def test_windows_of_long_texts_in_stretches(monkeypatch):
    """A text that is worked on in stretches has the windows of the whole one, and its time grows with its length."""
    from quarry.operators import windows

    r = random.Random(9)
    for _ in range(60):
        text = "".join(r.choice(PIECES + ["1.2.3.4", "12.", "x" * 90, " 　\n"]) for _ in range(120))
        for size, overlap in ((4, 0), (6, 30), (2.5, 0.2), (9, 3)):
            want = windows.spans(text, size, overlap)
            for part in (16, 100, 333):
                with monkeypatch.context() as m:
                    m.setattr(windows, "PART", part)
                    assert windows.spans(text, size, overlap) == want


def test_files_above_the_limit_are_indexed_where_all_are_asked_for(spark, tmp_path, monkeypatch):
    from quarry.streaming import indexing

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("word " * 100)
    for limit, n in ((400, 0), (1000, 1)):
        indexing.sync_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out{limit}", ChunkConfig(markdown=False), 16, max_bytes=limit)
        assert indexing.indexed_chunks(spark, f"file://{tmp_path}/out{limit}").count() == n


def test_offline_vectors_cut_in_one_pass(spark):
    """The helper a task cuts texts with gives what the columns give, by threshold and by percentile; no array is folded after it."""
    r = random.Random(11)
    words = ["alpha", "beta", "gamma 1.5", "人工智能", "　delta ", "e😀"]
    texts = ["".join(r.choice(words) + r.choice([" ", ".", "! ", "。", "\r\n", "\n\n", "？”", "\t"]) for _ in range(r.randint(1, 60))) for _ in range(60)] + ["one.", "!!!", "a\rb"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for more in ({"threshold": 0.3}, {"threshold_mode": "percentile", "percentile": 35}):
        cfg = chunking.ChunkConfig("semantic", semantic_max=200, semantic_min=20, overlap_enabled=False, markdown=False, offline_vectors=True, **more)
        made = chunking._offline(docs, cfg)
        parts = models.neighbour_cosines(docs.select("doc_id", T.sentences(F.col("text")).alias("parts")), "parts").withColumn("error", F.lit(None).cast("string"))
        rows = lambda df: sorted((x["doc_id"], x["blocks"], x["degraded"], x["threshold"]) for x in df.collect())
        got, want = [[(d, b, e, t if t is None else round(t, 9)) for d, b, e, t in rows(df)] for df in (made, chunking._by_vectors(parts, cfg))]
        assert got == want and len(got) == len(texts)
    counts = docs.select("text", T.count_tokens(F.col("text")).alias("n")).collect()
    assert [chunking._counted(x["text"]) for x in counts] == [x["n"] for x in counts]
