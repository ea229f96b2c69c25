"""Building, previewing and adding to the knowledge base."""

from quarry.operators import knowledge_base as kb
from quarry.operators.chunking import ChunkConfig

COLUMNS = "chunk_id string, chunk_pos long, doc_id long, idx int, text string, tokens long, vector array<double>"


def test_build_replaces_and_previews(spark):
    old = spark.createDataFrame([("a", 0, 1, 0, "old one", 2, None), ("b", 1, 2, 0, "stays", 1, None), ("c", 5, 1, 1, "old two", 2, None)], COLUMNS)
    docs = spark.createDataFrame([(1, "alpha beta gamma delta " * 20), (3, "new"), (4, None)], "doc_id long, text string")
    cfg = ChunkConfig(size=20, overlap_enabled=False)
    made = kb.build(docs, old, cfg, 16)
    rows = made.collect()
    shown = {(r["doc_id"], r["idx"], r["text"], r["tokens"]) for r in kb.preview(docs, cfg).collect()}
    assert made.columns == old.columns and {r["chunk_id"] for r in rows} >= {"b"} and not {"a", "c"} & {r["chunk_id"] for r in rows}
    assert {(r["doc_id"], r["idx"], r["text"], r["tokens"]) for r in rows if r["doc_id"] != 2} == shown and len(shown) > 3
    assert all(len(r["vector"]) == 16 and r["chunk_pos"] > 1 for r in rows if r["doc_id"] != 2) and len({r["chunk_pos"] for r in rows}) == len(rows)
    assert {r["idx"] for r in kb.preview(docs, cfg, 2).collect()} == {0, 1}
    assert {(r["doc_id"], r["status"]) for r in kb.status(docs, made).collect()} == {(1, "indexed"), (3, "indexed"), (4, "parsed")}


def test_added_chunks_have_places_of_their_own(spark):
    old = spark.createDataFrame([("a", 0, 1, 0, "x", 1, None, "n")], COLUMNS + ", doc_name string")
    new = spark.createDataFrame([("n1", 1, "one"), ("n2", 1, "two"), ("n3", 9, "three")], "chunk_id string, doc_id long, text string")
    got = {r["chunk_id"]: r for r in kb.add_chunks(old, new, spark.createDataFrame([(1, "n")], "doc_id long, doc_name string")).collect()}
    assert [got[k]["idx"] for k in ("a", "n1", "n2", "n3")] == [0, 1, 2, 0] and got["n3"]["doc_name"] == "手动新增" and got["n1"]["doc_name"] == "n"
    assert len({r["chunk_pos"] for r in got.values()}) == 4 and got["n2"]["vector"] is None and got["n3"]["tokens"] == 1
