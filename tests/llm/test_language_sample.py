"""The dictionaries' sample counts copies once."""

from quarry.llm import language_id


def test_copies_leave_a_dictionary(spark):
    rows = [("aa", "the same words again and again")] * 6000 + [("aa", f"other text {chr(97 + k)}{chr(98 + k)} words") for k in range(5)] + [("bb", f"das ist {'x' * (k + 1)}") for k in range(5)] + [("cc", "é")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.learn(docs, sample_texts=300)
    assert sorted(model) == ["aa", "bb", "cc"]
    assert all(t.encode() in model["aa"] for lang, t in rows[6000:6005])
    few = language_id.learn(docs, sample_texts=3)
    assert few["aa"].count(b"\n") == 2 and few["bb"].count(b"\n") == 2
