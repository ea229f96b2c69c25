"""Files, the stream over them, and the dialogue operators, on small cases."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversations, chunking, dialogue, retrieval
from quarry.sources import files
from quarry.streaming import indexing


@pytest.mark.parametrize(
    "x, want",
    [(1.0, "1"), (-0.0, "0"), (1.5, "1.5"), (-2.25, "-2.25"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (123e21, "1.23e+23"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (100.0, "100"), (0.1, "0.1"), (9007199254740993.0, "9007199254740992"), (float("inf"), "null")],
)
def test_number(x, want):
    assert files.number_text(x) == want


def test_json():
    assert files.json_text('{"b":[1.0,{}],"10":null,"2":[],"a":"x\\u00e9\\n"}') == '{\n  "2": [],\n  "10": null,\n  "b": [\n    1,\n    {}\n  ],\n  "a": "xé\\n"\n}'
    assert files.json_text('"plain"') == "plain"
    assert files.json_text("{bad") == "{bad" and files.json_text("NaN") == "NaN" and files.json_text("") == ""
    assert files.json_text('["\\ud800"]') == '[\n  "\\ud800"\n]'
    assert files.json_text("true") == "true"
    assert files.json_text("[" * 100000) == "[" * 100000


def word_file(body: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text: str) -> str:
    return f"<w:p><w:pPr><w:tabs><w:tab/></w:tabs></w:pPr><w:r><w:t>{text}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>"


def test_docx():
    assert files.docx_text(word_file(p("one") + p("two"))) == "one\tend\n\ntwo\tend\n\n"
    assert files.docx_text(b"no zip") is None
    assert files.docx_text(word_file("")) == ""


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.TXT").write_bytes("﻿第一段。\r\n\r\n\r\n\r\nsecond 😀 \x01\n".encode())
    (src / "b.json").write_text(json.dumps({"k": 1}))
    (src / "c.csv").write_text("h,i\n1,2\n")
    (src / "d.html").write_text("<p>one</p><script>x</script>two")
    (src / "e.docx").write_bytes(word_file(p("word")))
    (src / "f.docx").write_bytes(b"broken")
    (src / "g.pdf").write_bytes(b"%PDF")
    (src / "h.exe").write_bytes(b"no")
    (src / "i.md").write_bytes(b"bad \xff byte")
    (src / "j.txt").write_bytes(b"")
    return tmp_path


def test_ingest(spark, folder):
    rows = {r["name"]: r for r in files.ingest(spark, f"file://{folder}/in").collect()}
    assert "h.exe" not in rows and len(rows) == 8
    assert rows["a.TXT"]["text"] == "第一段。\n\nsecond 😀" and rows["a.TXT"]["chars"] == 15
    assert rows["b.json"]["text"] == '{\n  "k": 1\n}' and rows["c.csv"]["text"] == "h: 1 | i: 2" and rows["d.html"]["text"] == "one\n two"
    assert rows["e.docx"]["text"] == "word\tend" and rows["e.docx"]["error"] is None
    assert rows["f.docx"]["text"] is None and "docx" in rows["f.docx"]["error"]
    assert rows["g.pdf"]["error"] == "no PDF reader given" and rows["g.pdf"]["tokens"] == 0
    assert rows["i.md"]["text"] == "bad � byte" and "j.txt" not in rows
    read = {r["name"]: r for r in files.ingest(spark, f"file://{folder}/in", pdf_reader=lambda b: f"{len(b)} bytes").collect()}
    assert read["g.pdf"]["text"] == "4 bytes" and read["g.pdf"]["error"] is None


def test_fallback(spark, folder):
    raw = spark.read.format("binaryFile").load(f"file://{folder}/in")
    docs = files.describe(files.parse(raw)).where("name in ('b.json', 'c.csv')").select("doc_id", "file_path", "name")
    texts = docs.where("name = 'c.csv'").select("doc_id", F.lit("kept").alias("text"))
    assert {r["name"]: r["text"] for r in files.with_fallback(docs, texts, raw).collect()} == {"c.csv": "kept", "b.json": '{\n  "k": 1\n}'}


def test_stream(spark, folder):
    def run():
        indexing.index_folder(spark, f"file://{folder}/in", f"file://{folder}/out", f"file://{folder}/check", chunking.ChunkConfig(), 32).awaitTermination()
        return spark.read.parquet(f"file://{folder}/out").toPandas()

    first = run()
    assert first.chunk_id.is_unique and first.doc_id.nunique() == 6 and (first.vector.map(len) == 32).all()
    assert len(run()) == len(first)
    (folder / "in" / "new.txt").write_text("new words")
    assert sorted(set(run().text) - set(first.text)) == ["new words"]


def test_rewrite(spark):
    q = spark.createDataFrame([(1, "one"), (2, "two"), (3, "bad"), (4, "none")], "query_id long, text string")

    multi, hyding, asked = "检索查询生成专家", "假设性答案", dialogue.ASKED

    def model(prompts):
        return [{"one": 'so {"queries": ["a", "", "b", "c", "d"]}', "two": '{"queries": []}', "bad": "{"}.get(x.rsplit(asked, 1)[-1], '{"other": 1}') if multi in x else '"single"' for x in prompts]

    got = sorted(map(tuple, dialogue.rewrite(q, model, "multi").collect()))
    assert got == [(1, 0, "a", "multi"), (1, 1, "b", "multi"), (1, 2, "c", "multi"), (2, 0, "single", "single"), (3, 0, "bad", "error"), (4, 0, "single", "single")]
    hyde = dialogue.rewrite(q, lambda ps: [" " if "two" in x and hyding in x else " long " for x in ps], "hyde")
    assert sorted(map(tuple, hyde.where("query_id < 3").collect())) == [(1, 0, "one", "hyde"), (1, 1, "long", "hyde"), (2, 0, "long", "single")]
    assert {tuple(r) for r in dialogue.rewrite(q, lambda ps: 1 / 0, "single").select("text", "mode").collect()} == {(t, "error") for t in ("one", "two", "bad", "none")}


def test_prompts(spark):
    said = [(1, 0, "user", "first"), (1, 1, "assistant", "answer"), (1, 2, "user", "what now {q}?"), (2, 0, "user", "alone")]
    talk = spark.createDataFrame(said, "conv_id long, turn int, role string, text string")
    rows = conversations.last_user(talk).withColumnRenamed("question", "text").join(dialogue.histories(talk), "conv_id", "left").withColumn("history", F.coalesce("history", F.lit("")))
    got = {r["conv_id"]: r for r in rows.select("conv_id", dialogue.rewrite_prompt("single", "P").alias("s"), dialogue.rewrite_prompt("multi", "", 4).alias("m"), dialogue.rewrite_prompt("hyde").alias("h")).collect()}
    assert got[1]["s"] == dialogue.REWRITE_SYSTEM + "\nuser: first\nassistant: answer\nP\n\n" + dialogue.ASKED + "what now {q}?"
    assert got[2]["s"] == dialogue.REWRITE_SYSTEM + "\nP\n\n" + dialogue.ASKED + "alone"
    assert "生成 4 个" in got[2]["m"] and got[2]["m"].endswith(dialogue.ASKED + "alone") and got[1]["h"].endswith("问题：what now {q}?")
    one = spark.range(1).select(dialogue.retry_prompt(F.lit("q1"), F.array(F.lit("a"), F.lit("b"))).alias("r"), dialogue.score_prompt(F.lit("q1"), F.array(F.lit("x" * 2000), F.lit("y"))).alias("s")).first()
    assert one["r"].endswith("原始问题：q1\n已尝试的查询：a / b") and one["s"].endswith("[#0] " + "x" * 1200 + "\n\n[#1] y")


def test_rerank_responses_of_models(spark):
    rows = [(1, 'so {"scores": [{"index": 0, "score": 87}, {"index": 1}, {"score": 3}]} ok'), (2, "no json"), (3, None), (4, '{"data": [{"index": "2", "score": "50"}]}')]
    got = dialogue.response_items(spark.createDataFrame(rows, "query_id long, answer string"), percent=True).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0.87), (4, 2, 0.5)]
    nested = [(1, '{"documents": [{"document": {"index": 3}, "similarity": 0.25}]}'), (2, '{"results": "none"}')]
    assert [tuple(r) for r in dialogue.response_items(spark.createDataFrame(nested, "query_id long, answer string")).collect()] == [(1, 3, 0.25)]


def test_rerank(spark):
    c = spark.createDataFrame([(1, 10, 1, 0.5), (1, 11, 2, 0.4), (2, 10, 1, 0.3)], "query_id long, chunk_pos long, rank int, fused_norm double")
    items = spark.createDataFrame([(1, 1, 0.9), (1, 5, 0.8), (1, 0, None), (2, 0, float("nan"))], "query_id long, index int, score double")
    assert [(r["query_id"], r["chunk_pos"], r["rerank"]) for r in dialogue.rerank_items(c, items).collect()] == [(1, 11, 0.9)]
    chained = dialogue.rerank_chain(c, {"api": lambda x: dialogue.rerank_items(x, items), "llm": lambda x: x.where("false").withColumn("rerank", F.lit(0.0))})
    assert sorted((r["query_id"], r["chunk_pos"], r["rerank"], r["rerank_mode"]) for r in chained.collect()) == [(1, 11, 0.9, "api"), (2, 10, None, "none")]
    assert [r["score_from"] for r in retrieval.context(chained, 0.35).collect()] == ["rerank"]
    assert [r["final_score"] for r in retrieval.context(chained, 0.35, score_source="fusion").collect()] == [0.4]


def test_retries(spark):
    q = spark.createDataFrame([(1, "hit"), (2, "miss"), (3, "never"), (4, "same")], "query_id long, text string")
    search = lambda d: d.where("text like 'hit%'").select("query_id", F.lit(7).alias("chunk_pos"))
    propose = lambda d: d.select("query_id", F.expr("case query_id when 2 then '\"hit 2\"' when 4 then 'same' else concat(text, '+') end").alias("new_text"))
    got = sorted((r["query_id"], r["query"], r["iteration"]) for r in dialogue.with_retries(q, search, propose).collect())
    assert got == [(1, "hit", 0), (2, "hit 2", 1)]
