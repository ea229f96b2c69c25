"""Large files of plain text are cut as their pieces come by; chunks are those of the whole text."""

import random

import pytest

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.sources import files
from quarry.streaming import indexing

CFG = chunking.ChunkConfig(size=16, overlap_mode="absolute", overlap_value=3, markdown=False)
PARTS = ["word", "3.14", "人工智能", " ", "  \t", "\n", "\n\n\n", "\r\n", "\r", " \n \n", "\x01", "\x0b", "　", ". ", "é", "\xa0\n", "﻿"]


def test_pieces_are_cleaned_as_the_whole(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 40))) + "\n" for _ in range(300)]
    want = [x["t"] for x in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string").coalesce(1).select("k", T.normalize("text").alias("t")).orderBy("k").collect()]
    for text, whole in zip(texts, want):
        lines = [line + "\n" for line in text[:-1].split("\n")]
        k = r.randint(0, len(lines))
        assert "".join(files.normalised(lines)) == whole == "".join(files.normalised(["".join(lines[:k]), "".join(lines[k:])]))


@pytest.mark.parametrize("split", [None, "400"])
def test_large_files_have_the_chunks_of_whole_ones(spark, tmp_path, monkeypatch, split):
    r = random.Random(6)
    (tmp_path / "in" / "part=a b").mkdir(parents=True)
    for name in ("part=a b/x.txt", "y[1] {z}*.md", "é %20.markdown", "blank.txt", "h.html"):
        text = "\n" * 3000 if name == "blank.txt" else "".join(r.choice(PARTS) for _ in range(2500))
        (tmp_path / "in" / name).write_bytes("﻿".encode() + text.encode() + b"cut \xe4\xb8\nand \xff end\n\n")
    (tmp_path / "in" / "small.txt").write_text("a few words")

    def run(out, long):
        monkeypatch.setattr(indexing, "LONG", long)
        monkeypatch.setattr(indexing, "PIECE", 200)
        indexing.index_folder(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/{out}", f"file://{tmp_path}/{out}-check", CFG, 16).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(f"file://{tmp_path}/{out}").collect()))

    want, read = run("whole", 1 << 40), []
    write = indexing.materialise
    monkeypatch.setattr(indexing, "materialise", lambda df, name: read.append(write(df, name)) or read[-1])
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = run("long", 100)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == want and len({x[1] for x in got}) == 6 and len(got) > 300 and len(read) == 1
