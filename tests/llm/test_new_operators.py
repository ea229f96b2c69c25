"""Whitening, the filter audit and mixing, damaged stores and telling pairs: plain versions on small made tables."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest

from quarry.llm import filter_audit, mixing, queries, whitening

SF = "/root/testdata/sf0.001"


# -- op11 -----------------------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    """Rows of (place, component, n, deviation, whitened, share) by a full eigendecomposition."""
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return n, s, e, u, np.trace(centred.T @ centred / n), x


def check_whitening(rows, vectors):
    n, s, e, u, trace, x = plain_whitening(vectors)
    by = collections.defaultdict(dict)
    for r in rows:
        by[r["component"]][r["vec_id"]] = r
    for j, own in by.items():
        w = np.array([own[i]["whitened"] for i in range(len(x))])
        want = (x - s / n) @ u[:, j - 1] / math.sqrt(e[j - 1])
        assert np.allclose(w, want, atol=1e-8) or np.allclose(w, -want, atol=1e-8)
        assert all(own[i]["n"] == n and own[i]["deviation"] == int(((n * x[i] - s) ** 2).sum()) for i in own)
        assert all(abs(own[i]["explained"] / (e[j - 1] / trace) - 1) < 1e-9 and own[i]["identity_error"] < 1e-9 for i in own)
    return len(by)


def test_whitening_over_the_table(spark):
    vectors = [r[0] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()]
    assert check_whitening(queries.op11_embedding_whitening(spark, SF).collect(), vectors) == 4


def test_whitening_with_a_gap_needs_no_full_dimension(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 5)) * [9, 7, 5, 4, 0.02] @ rng.normal(size=(5, 40)) + rng.normal(size=(300, 40)) * 0.002
    vectors = [[float(c) for c in row] for row in v] + [[float(c) for c in v[0]]] * 200
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")
    grid = whitening.on_grid(rows)
    model = whitening.fit(grid)
    assert not model.full and model.n == 300
    assert check_whitening(whitening.whiten(grid, model).collect(), vectors) == 4
    flat = whitening.fit(grid, oversample=0, passes=2)
    assert flat.full and np.allclose(flat.values, model.values, rtol=1e-9)


def test_whitening_of_odd_rows(spark):
    kind = "vec_id long, embedding array<float>, component string, x int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "a", 1), (1, [1.0, 2.0], "a", 1), (None, [0.5, -1.0], None, 2), (3, None, "", 3), (4, [], "", 3), (5, [1.0, None], "", 3), (6, [nan, 1.0], "", 3), (7, [inf, 1.0], "", 3), (8, [1.0], "", 3), (9, [-0.001, 0.25], "", 3)]
    got = whitening.whiten_rows(spark.createDataFrame(rows, kind)).collect()
    assert collections.Counter(r["vec_id"] for r in got) == {1: 4, None: 2, 9: 2} and all(r["n"] == 3 for r in got)
    for some in ([], rows[:2], rows[3:8]):
        empty = whitening.whiten_rows(spark.createDataFrame(some, kind))
        assert empty.count() == 0 and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_a_deviation_beyond_a_long_is_null(spark):
    rows = spark.createDataFrame([(k, [1e9 * k, 1e9, float(k)]) for k in range(4)], "vec_id long, embedding array<double>")
    got = whitening.whiten_rows(rows).collect()
    assert {r["deviation"] for r in got} == {None}


# -- op12 -----------------------------------------------------------------------------------


def plain_audit(docs, labels):
    least = {}
    for d in docs:
        t = d["text"] or ""
        if d["doc_id"] is not None:
            least[t] = min(least.get(t, d["doc_id"]), d["doc_id"])
    marked = []
    for d in docs:
        t = d["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        fails += "E" * (d["doc_id"] is not None and d["doc_id"] > least[t])
        own = [x for x in labels if x[0] == d["doc_id"] and x[0] is not None]
        marked.append((d["source"] or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, shapley = {}, collections.Counter()
    for part, order in itertools.product({m[0] for m in marked}, itertools.permutations("ABCDE")):
        left = [m for m in marked if m[0] == part]
        gone = []
        for k, f in enumerate(order):
            here = [m for m in left if f in m[1]]
            left = [m for m in left if f not in m[1]]
            shapley[part, f] += len(here)
            out[part, "".join(order), k + 1] = [f, len(left), len(here), sum(f in m[1] for m in gone), sum(m[0] == part and m[1] == f for m in marked), sum(m[2] for m in here), sum(m[3] for m in here)]
            gone += here
    return {k: (*v[1:], shapley[k[0], v[0]]) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \t\n", long, long, long + " # x", long.upper(), "a " * 80, "a b " * 60, "B" * 300_000, long + " |", None]
    docs = [{"doc_id": k if k != 4 else 3, "text": t, "source": [None, "", "s", "hot"][k % 4], "n_words": "x", "part": 1.5} for k, t in enumerate(texts)]
    docs += [{"doc_id": None, "text": long, "source": "hot", "n_words": None, "part": None}] * 2
    labels = [(0, 1, 0), (3, 0, 1), (3, 1, None), (5, 1, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)]
    of_docs = spark.createDataFrame([tuple(d.values()) for d in docs], "doc_id long, text string, source string, n_words string, part double")
    of_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(of_docs, of_labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in COUNTS) for r in got} == plain_audit(docs, labels)
    assert len(got) == 600 * 3
    assert filter_audit.audit(of_docs.limit(0), of_labels).count() == 0
    alone = filter_audit.audit(of_docs, of_labels.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(alone) == (0, 0)


def test_each_state_is_entered_once(spark):
    marked = spark.createDataFrame([("p", True, False, True, True, False), ("p", False, False, False, False, True)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    found = filter_audit.edges(marked, "ABC").collect()
    states = collections.Counter(r["state"] for r in found)
    assert states == {0: 3, 1: 2, 2: 2, 4: 2, 3: 1, 5: 1, 6: 1}


# -- op13 -----------------------------------------------------------------------------------


def plain_levels(sizes, weights=(5, 2, 1)):
    """Targets: share by weight, fix those above their bound, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, fixed = 1.5 * sum(sizes.values()), {}
    while len(fixed) < len(names):
        open_ = [s for s in names if s not in fixed]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        for s in over:
            fixed[s] = 2.0 * sizes[s]
            left -= fixed[s]
    return fixed


def made_documents():
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        source = [None, "", "big", "big", "big", "é", "z", "one"][k % 8] if k != 399 else "lone"
        n = int(rng.integers(0, 90)) if source != "one" else 0
        rows.append((k, " ".join(["w"] * n) if n else [None, "", " \n"][k % 3], source))
    return [*rows, (400, "w\t" * 30_000, "big"), *[(None, "a b c", "z")] * 3, *[(7, "x y", "é")] * 2]


@pytest.mark.parametrize("block", [16, 1024])
def test_mixing_by_the_schedule(spark, block):
    rows = made_documents()
    docs = spark.createDataFrame([(*r, "k", 1, None) for r in rows], "doc_id long, text string, source string, key string, rank int, slot string")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    want = plain_levels(sizes)
    got = mixing.mix(docs, block).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(i), size(t)) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    total = collections.Counter()
    for r in got:
        total[r["source_size"], round(r["target"], 6)] += r["taken"]
    assert total == collections.Counter({(sizes[s], round(t, 6)): round(t) for s, t in want.items()})
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7), block).collect()))


def test_pieces_fill_their_slots(spark):
    """Slots of a source follow each other through its circle; slots of all sources interleave evenly."""
    docs = spark.createDataFrame(made_documents(), "doc_id long, text string, source string")
    rows = [r for r in mixing.pieces(docs, 64).collect() if r["slot"] is not None]
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["slot"]].append(r)
    held = {k: sum(r["length"] for r in own) for k, own in slots.items()}
    assert all(len({r["key"] for r in own}) == 1 for own in slots.values()) and max(held.values()) == 64
    assert sum(n < 64 for n in held.values()) <= 7  # the last of each source
    order = sorted(slots)
    share = collections.Counter(slots[k][0]["key"] for k in order)
    seen = collections.Counter()
    for at, k in enumerate(order, 1):
        seen[slots[k][0]["key"]] += 1
        assert all(abs(seen[s] - at * n / len(order)) < 6 for s, n in share.items())


def test_mixing_of_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert sorted(tuple(r) for r in mixing.mix(docs).collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.mix(docs.limit(0)).collect() == []


def test_the_shuffle_is_by_hash(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "s") for k in range(20)], "doc_id long, text string, source string")
    begin = {r["doc_id"]: r["begin"] for r in mixing.pieces(docs).collect()}
    assert sorted(begin, key=begin.get) == sorted(begin, key=lambda k: hashlib.md5(f"{k}:text {k}".encode()).hexdigest())


# -- op6 ------------------------------------------------------------------------------------


def test_pairs_are_all_tried(monkeypatch):
    """Telling pairs of rare terms and of a rare and a frequent one are found wherever the matrix ends."""
    rng = np.random.default_rng(2)
    n, m = 600, 60
    held = rng.random((n, m)) < np.linspace(0.7, 0.05, m)
    y = np.zeros(n)
    y[held[:, 2] & held[:, 40] | held[:, 45] & held[:, 30]] = 1
    row, which = np.nonzero(held)
    seen, both, of_one, share = held.sum(axis=0), held.T.astype(int) @ held, held[y > 0].T.astype(int) @ held[y > 0], y.mean()
    chi = (of_one - both * share) ** 2 / np.maximum(both * share * (1 - share) * np.maximum(1 - both / n, 1e-9), 1e-9)
    from quarry.llm import toxicity

    for dense in (m, 20, 3, 1):
        monkeypatch.setattr(toxicity, "DENSE", dense)
        often = np.argsort(-seen, kind="stable")[:dense]
        value = [(-chi[a, b], min(a, b), max(a, b)) for a in range(m) for b in range(a) if both[a, b] >= 10 and chi[a, b] >= 40 and (of_one[a, b] > share * both[a, b] or {a, b} <= set(often.tolist()))]
        want = {t for _, a, b in sorted(value)[: toxicity.PAIRS] for t in (a, b)}
        assert len(value) < toxicity.PAIRS and set(toxicity._in_pairs(row, which, seen, y).tolist()) == want and {40, 45} <= want


def test_op6_on_its_held_out_fold(spark):
    sf = "/root/testdata/sf0.1"
    said = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect()}
    got = [(said[r["doc_id"]], r["predicted"]) for r in queries.op6_toxicity(spark, sf).where("held_out").collect() if r["doc_id"] in said]
    toxic = [p for y, p in got if y]
    clean = [p for y, p in got if not y]
    assert len(toxic) > 50 and np.mean(toxic) > 0.8 and np.mean(clean) < 0.01


# -- op9 ------------------------------------------------------------------------------------


def changed(column, f):
    """A damage: one row's ``column`` in the first file of a table becomes ``f`` of it."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def run(files):
        t = pq.ParquetFile(files[0]).read()
        rows = t.to_pylist()
        rows[0][column] = f(rows[0][column])
        pq.write_table(pa.Table.from_pylist(rows, t.schema), files[0])
        (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)

    return run


def lost_row(files):
    import pyarrow.parquet as pq

    t = pq.ParquetFile(files[0]).read()
    pq.write_table(t.slice(1), files[0])
    (files[0].parent / f".{files[0].name}.crc").unlink(missing_ok=True)


def lost(files):
    for f in files:
        f.unlink()


DAMAGE = {
    "recipes": ("store/kind=recipe", lost), "chunks": ("store/kind=chunk", lost), "a chunk's content": ("store/kind=chunk", changed("content", lambda b: bytes([b[0] ^ 1]) + b[1:])),
    "a recipe's root": ("store/kind=recipe", changed("content", lambda b: bytes(32))), "a recipe": ("store/kind=recipe", lost_row), "a chunk": ("store/kind=chunk", lost_row),
    "a recipe's chunk list": ("store/kind=recipe", changed("hashes", lambda h: h[:-1])), "the manifest": ("manifest", lost), "a manifest row": ("manifest", lost_row), "a manifest root": ("manifest", changed("root", lambda b: bytes(32))),
    "a manifest id": ("manifest", changed("doc_id", lambda i: 77)), "a count": ("manifest", changed("n", lambda n: n + 1)), "roots": ("roots", lost), "a root": ("roots", changed("root", lambda b: bytes(32))), "the seal": ("seal", lost),
}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    import public_tokenizers

    from quarry.llm import chunk_store

    path = tmp_path_factory.mktemp("store") / "whole"
    docs = spark.createDataFrame([(k, f"text {k} " * (k * 40), 1) for k in range(12)], "doc_id long, text string, at int")
    chunk_store.write(docs, f"file://{path}", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert chunk_store.digests(spark, f"file://{path}").count() == chunk_store.read(spark, f"file://{path}").count() == 12
    return path


@pytest.mark.parametrize("what", DAMAGE)
def test_a_damaged_store_raises(spark, store, tmp_path, what):
    import shutil

    from quarry.llm import chunk_store

    table, damage = DAMAGE[what]
    path = tmp_path / "store"
    shutil.copytree(store, path)
    files = sorted((path / table).glob("*.parquet"), key=lambda f: -f.stat().st_size)
    damage(files)
    for reader in (chunk_store.digests, chunk_store.read) if table.startswith("store") else (chunk_store.digests,):
        with pytest.raises(Exception, match="differs|missing|infer schema"):
            reader(spark, f"file://{path}").collect()
