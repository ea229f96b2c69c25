"""Pieces cut anywhere, over several batches and a restart, give the events of the whole text."""

import json
import random

import pytest

from quarry.streaming import deltas


def answer(words):
    lines = [": ping", "", "data: {broken", 'data: {"choices":[]}']
    for w in words:
        lines += ["data: " + json.dumps({"choices": [{"delta": {"content": w}}]}, ensure_ascii=False), ": ping"]
    return ("\r\n".join(lines) + "\ndata: [DONE]\ndata: " + json.dumps({"choices": [{"delta": {"content": "late"}}]}) + "\n").encode()


@pytest.mark.parametrize("seed", [1, 2])
def test_pieces_over_batches_and_a_restart(spark, tmp_path, seed):
    r = random.Random(seed)
    said = {1: ["人工", "智能 ", "é"], 2: ["one"], 3: [f"w{k}" for k in range(40)], 4: []}
    rows = []
    for k, words in said.items():
        raw, at, n = answer(words), 0, 0
        while at < len(raw):
            step = r.randint(1, 9)
            rows.append((k, n, raw[at : at + step]))
            at, n = at + step, n + 1
    rows.append((5, 0, b'data: {"choices":[{"delta":{"content":"unfinished"}}]}'))
    rows += r.sample(rows, 20)  # some come again
    parts = [[], [], [], []]
    for row in rows:
        parts[r.randrange(4)].append(row)
    source, kinds = f"file://{tmp_path}/in", "run_id long, seq long, piece binary"

    def run():
        stream = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(source)
        deltas.parse(stream).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()

    for part in parts[:2], parts[2:]:
        for some in part:
            spark.createDataFrame(some, kinds).coalesce(1).write.mode("append").parquet(source)
        run()
    got = {}
    for x in sorted(spark.read.parquet(f"file://{tmp_path}/out").collect()):
        got.setdefault(x["run_id"], []).append((x["seq"], x["delta"]))
    assert got == {k: list(enumerate(words)) for k, words in said.items() if words}
