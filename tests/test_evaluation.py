"""Support by sentence and citations, by hand."""

from quarry.operators import evaluation


def test_sentences_and_their_best_passage(spark):
    answers = spark.createDataFrame([(1, "red fox?", "The red fox ran! It slept! ... ! 你好。"), (2, "x", None), (3, None, "alone here."), (4, "red", "red red! blue")], "query_id long, question string, answer string")
    passages = spark.createDataFrame([(1, 1, "a red fox"), (1, 2, "the red fox ran off"), (1, 3, "THE RED FOX RAN"), (2, 1, "x"), (4, 2, "blue red"), (4, 1, None)], "query_id long, ref int, text string")
    got = {(r["query_id"], r["i"]): (r["ref"], round(r["support"], 4)) for r in evaluation.aligned(answers, passages).collect()}
    assert got == {(1, 0): (2, 1.0), (1, 1): (None, 0.0), (1, 3): (None, 0.0), (3, 0): (None, 0.0), (4, 0): (2, 1.0), (4, 1): (2, 1.0)}
    scores = evaluation.by_sentence(answers, passages)
    rows = {r["query_id"]: tuple(r)[1:] for r in scores.collect()}
    assert rows == {1: (3, 1, 1 / 3, 1.0), 2: (0, 0, 0.0, 0.0), 3: (1, 0, 0.0, 0.0), 4: (2, 2, 1.0, 1.0)}
    assert tuple(evaluation.averages(scores).first()) == (4, (1 / 3 + 1) / 4, 0.5)
    assert tuple(evaluation.averages(scores.limit(0)).first()) == (0, 0.0, 0.0)


def test_citations(spark):
    answers = spark.createDataFrame([(1, "a [1] <b> & [3][3] [x] [99999999999]"), (2, "none"), (3, None), (4, "[2]")], "query_id long, answer string")
    passages = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)], "query_id long, ref int")
    got = {r["query_id"]: (r["cited"], r["dangling"], r["n_citations"], r["n_unused"]) for r in evaluation.citations(answers, passages).collect()}
    assert got == {1: ([1, 3], [-1], 4, 1), 2: ([], [], 0, 1), 3: ([], [], 0, 1), 4: ([], [2], 1, 0)}
    shown = evaluation.citations(answers, passages).where("query_id = 1").first()["shown"]
    assert shown.startswith('a <span class="ref">[1]</span> &lt;b&gt; &amp; ')
