from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_token_estimate(spark):
    assert one(spark, "", T.count_tokens) == 0 and one(spark, None, T.count_tokens) == 0
    assert one(spark, "   \n\t ", T.count_tokens) > 0
    assert one(spark, "你好世界", T.count_tokens) >= 4
    assert one(spark, "人工智能", T.count_tokens) > one(spark, "artificial", T.count_tokens)


def test_index_terms(spark):
    terms = one(spark, "人工智能 AI 学习", T.index_terms)
    assert {"人", "人工", "ai"} <= set(terms) and "AI" not in terms
    assert one(spark, "für end. 3.5", T.index_terms) == ["f", "r", "end.", "3.5"]


def test_sentences_and_paragraphs(spark):
    assert one(spark, "今天天气不错。我们去散步吧！他说 hello? 好的。", T.sentences) == ["今天天气不错。", "我们去散步吧！", "他说 hello?", "好的。"]
    assert one(spark, "a\nb\n\n c \n \nd", T.paragraphs) == ["a\nb", "c", "d"]
    assert one(spark, "a\n\u3000b\u00a0\nc", T.paragraphs) == ["a", "b", "c"]


def test_html_entities_in_order(spark):
    assert one(spark, "<p>a&amp;lt;b</p><script>x</script><BR/>c", T.html_text) == "a<b\n \nc"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), (None, [1.0], 0.0), ([0.0], [1.0], 0.0)], "a array<double>, b array<double>, e double")
    assert all(abs(r["c"] - r["e"]) < 1e-12 for r in rows.select(T.cosine(F.col("a"), F.col("b")).alias("c"), "e").collect())


def test_overlap_sizes():
    assert chunking.ChunkConfig(size=512).overlap == 77
    assert chunking.ChunkConfig(overlap_enabled=False).overlap == 0
    assert chunking.ChunkConfig(overlap_mode="absolute", overlap_value=30).overlap == 30


def test_csv_of_many_lines_takes_time_by_line(spark):
    import time

    from pyspark.sql import functions as F

    from quarry.functions import text as T

    text = "a,b\n" + "\n".join(f'"{k}", x{k % 9}' for k in range(8000))
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(T.csv_lines(F.col("t")).alias("o")).first()["o"].split("\n")
    assert time.time() - began < 20 and len(got) == 8000 and got[10] == "a: 10 | b: x1"
