"""A folder's changes and deletions reach its chunks exactly once."""

import os

import pytest

from quarry import runs
from quarry.operators import chunking
from quarry.streaming import indexing

CFG = chunking.ChunkConfig(size=8, overlap_enabled=False)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)

    def put(name, text, at=None):
        p = tmp_path / "in" / name
        p.write_text(text)
        if at:
            os.utime(p, (at, at))
        return p

    return tmp_path, put


def state(spark, base):
    paths = {r["doc_id"]: r["path"].rsplit("/", 1)[-1] for r in indexing.manifest(spark, f"{base}/out").collect()}
    rows = indexing.indexed_chunks(spark, f"{base}/out").collect()
    assert all(len(r["vector"]) == 16 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)
    texts = {}
    for r in sorted(rows, key=lambda r: r["idx"]):
        texts[paths[r["doc_id"]]] = texts.get(paths[r["doc_id"]], "") + r["text"].replace(" ", "")
    return texts


def sync(spark, base, **options):
    return indexing.sync_folder(spark, f"file://{base}/in", f"file://{base}/out", CFG, 16, **options)


def test_change_deletion_and_nothing_new(spark, folder):
    base, put = folder
    long = " ".join(f"word{k}" for k in range(60))
    put("a.txt", long, 1000)
    put("b[1] {x}*.md", "second file", 1000)
    put("sub/c.txt", "third", 1000)
    put("no.bin", "not indexed")
    assert sync(spark, base, files_per_read=2) == 0
    first = {"a.txt": long.replace(" ", ""), "b[1] {x}*.md": "secondfile", "c.txt": "third"}
    assert state(spark, base) == first
    assert sync(spark, base) is None
    put("a.txt", "changed text", 2000)
    put("sub/c.txt", "third", 3000)  # touched only
    os.remove(base / "in" / "b[1] {x}*.md")
    put("d.txt", "new one")
    kept = {r["chunk_id"] for r in indexing.indexed_chunks(spark, f"{base}/out").collect() if r["text"] == "third"}
    assert sync(spark, base) == 1
    assert state(spark, base) == {"a.txt": "changedtext", "c.txt": "third", "d.txt": "newone"}
    assert kept == {r["chunk_id"] for r in indexing.indexed_chunks(spark, f"{base}/out").collect() if r["text"] == "third"}
    facts = spark.read.parquet(f"{base}/out/commits/run=1").first()
    assert (facts["added"], facts["changed"], facts["touched"], facts["removed"]) == (1, 1, 1, 1)
    assert sync(spark, base) is None
    put("b[1] {x}*.md", "back again", 4000)
    put("a.txt", "", 4000)  # a file of no bytes counts as gone
    assert sync(spark, base) == 2
    assert state(spark, base) == {"b[1] {x}*.md": "backagain", "c.txt": "third", "d.txt": "newone"}


def test_a_lost_run_is_repeated_whole(spark, folder, monkeypatch):
    base, put = folder
    put("a.txt", "one", 1000)
    put("b.txt", "two", 1000)
    sync(spark, base)
    put("a.txt", "three", 2000)
    os.remove(base / "in" / "b.txt")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(runs, "commit", lost)
        with pytest.raises(RuntimeError):
            sync(spark, base)
    assert state(spark, base) == {"a.txt": "one", "b.txt": "two"}
    put("c.txt", "four", 2000)
    assert sync(spark, base) == 1
    assert state(spark, base) == {"a.txt": "three", "c.txt": "four"}


def test_before_the_first_run(spark, folder):
    base, _ = folder
    assert indexing.manifest(spark, f"{base}/out").count() == 0 and indexing.indexed_chunks(spark, f"{base}/out").count() == 0
