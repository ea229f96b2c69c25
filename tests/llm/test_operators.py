"""Operators against plain versions, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import chunk_store, decontaminate, language_id, near_duplicates, packing, quality, toxicity, url_filter, warc
from quarry.llm.encoding import Encoder
from quarry.llm.token_counts import Counter, count_tokens
from quarry.storage import scratch

BYTES, WORDS = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
COLUMNS = "doc_id long, text string, n_tokens string, score string, word string, bucket string, n string, key string, part string"
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [
    (0, BASE), (1, BASE), (2, BASE + " extra"), (3, BASE.replace(" ", "\n", 1)), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "ONE two"),
    (9, prose(300, 2)), (10, prose(60, 3) + " " + prose(40, 9) + " " + prose(30, 4)), (11, "x" * 70_000), (12, ("le mot " * 9000)), (13, "###$$$ % & a"),
    (14, "don't  we'll <|endoftext|> é 人工 ½ ١\u00a0\u3000end "), (15, prose(50, 6) + "\nline\nline\n\nline"), (7, "one two"), (None, "no id here"), (16, "12 34"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, *["z"] * 7) for i, t in TEXTS], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


def ids(path, text, *end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + list(end)


def crc(x):
    return zlib.crc32(np.array(x, "<u4").tobytes())


def test_words_give_the_library_s_ids():
    parts = ["a", "b", "'s", "'", "'re", "ll", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "é", "ß", "人", "1", "½", "!", "<|endoftext|>", "\x1c", "e\u0301", "Σ", "İ", "🙂", "\r", "the"]
    r = random.Random(3)
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(3000)] + ["a" * 300, ""]
    for path in (BYTES, WORDS):
        want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        n, flat = Encoder(path).texts(texts)
        stop = np.cumsum(n)
        assert [flat[a:b].tolist() for a, b in zip([0, *stop], stop)] == want
        if path == BYTES:
            assert Counter(path).texts(texts).tolist() == [len(w) for w in want]


def test_token_counts(docs, nothing):
    got = sorted(map(tuple, count_tokens(docs, BYTES).collect()), key=repr)
    want = sorted(((i, len((t or "").encode()), n := len(ids(BYTES, t)), n > 512) for i, t in TEXTS), key=repr)
    assert got == want and count_tokens(nothing, BYTES).isEmpty()


def test_packing(docs, nothing):
    rows = packing.pack(docs, BYTES, 1024, 0).collect()
    want = collections.Counter((i, tuple(ids(BYTES, t, 0))) for i, t in TEXTS)
    made, held = collections.Counter(), []
    seqs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        seqs[r["sequence_id"]].append(r)
        held += np.frombuffer(r["ids"], "<u4").tolist()
        if r["ends"]:
            made[r["doc_id"], tuple(held)] += 1
            assert r["doc_tokens"] == len(held)
            held = []
    assert made == want and not held
    full = sorted(seqs)
    assert full == list(range(len(full)))
    for s in full:
        at = 0
        for r in seqs[s]:
            assert r["offset"] == at and r["length"] * 4 == len(r["ids"])
            at += r["length"]
        assert at == 1024 or s == full[-1]
    assert packing.pack(nothing, BYTES).isEmpty()


def test_chunk_store(spark, docs, nothing):
    path = scratch(spark, "store")
    chunk_store.write(docs, path, WORDS, 2)
    got = sorted(chunk_store.digests(spark, path).collect(), key=lambda r: r["start"])
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((repr(i), len(x := ids(WORDS, t, 2)), crc(x)) for i, t in TEXTS)
    at, last = 0, -1
    for r in got:
        assert r["start"] == at and (r["doc_id"] is None and last == -1 or r["doc_id"] >= last)
        at += r["n_tokens"]
        last = -1 if r["doc_id"] is None else r["doc_id"]
    whole = {(r["doc_id"], r["start"]): np.frombuffer(r["ids"], "<u2").tolist() for r in chunk_store.read(spark, path).collect()}
    assert all(crc(whole[r["doc_id"], r["start"]]) == r["ids_crc32"] for r in got)
    chunks = chunk_store.chunks(spark, path).collect()
    assert len({bytes(c["hash"]) for c in chunks}) == len(chunks) and all(hashlib.sha256(c["content"]).digest() == c["hash"] for c in chunks)
    other = scratch(spark, "store")
    chunk_store.write(nothing, other, WORDS, 2)
    assert chunk_store.digests(spark, other).isEmpty()


def test_crc_of_parts():
    r = np.random.default_rng(1)
    a, b = r.bytes(1000), r.bytes(777)
    assert chunk_store.crc_shift(np.array([zlib.crc32(a)]), np.array([777]))[0] ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_language_id(spark, docs, nothing):
    rows = [(k, prose(80, k), "aa") for k in range(40)] + [(100 + k, prose(80, k).translate(str.maketrans("abcdefghij", "klmnopqrst")), "bb") for k in range(40)]
    all_rows = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(all_rows.where("doc_id % 2 = 0"))
    got = {r["doc_id"]: r for r in language_id.identify(all_rows, model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows)
    odd = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(odd[k]["lang_pred"] == "und" and odd[k]["rejected"] and odd[k]["score"] == 0 for k in (4, 5, 6, 16)) and odd[9]["lang_pred"] == "aa"
    assert language_id.identify(nothing, model).isEmpty()
    assert language_id.learn(all_rows.limit(0)) == {} and {r["lang_pred"] for r in language_id.identify(all_rows, {}).collect()} == {"und"}


def test_language_id_by_hand(spark):
    import zstandard as zstd

    alphabets = {"aa": "abcdefghij", "bb": "klmnopqrst", "cc": "aeiklmostu"}
    rows = [(k, prose(r, 40 + k).translate(str.maketrans("abcdefghij", alphabets[lang])).upper() + " 12!", lang) for r in (3, 30) for j, lang in enumerate(alphabets) for k in range(1000 * r + 100 * j, 1000 * r + 100 * j + 12)]
    rows += [rows[0], (None, rows[5][1], None), (7, "a", "aa"), (8, "é", None), (9, None, "bb"), (10, "5", "cc"), (11, rows[20][1] * 300, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language_id.learn(docs.where("lang is not null").repartition(n)) for n in (1, 7)]
    assert models[0] == models[1] and sorted(models[0]) == sorted(alphabets)
    for bound in (200, 64):
        small = language_id.learn(docs, dict_bytes=bound)
        assert all(8 <= len(raw) <= bound for raw in small.values())
    small = language_id.learn(docs, model_bytes=300 * len(alphabets))
    assert sorted(small) == sorted(alphabets) and all(len(d) <= 300 for d in small.values())
    pressed = []
    for lang, raw in sorted(models[0].items()):
        d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        pressed.append((lang, zstd.ZstdCompressor(level=language_id.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    want = collections.Counter()
    for i, t, _ in rows:
        clean = re.sub(r"[\W\d_]+", " ", (t or "").lower()).strip().encode()
        if not clean:
            want[i, "und", 0.0, True] += 1
            continue
        size = sorted((len(c.compress(clean)), lang) for lang, c in pressed)
        score = (size[1][0] - size[0][0]) / size[1][0]
        want[i, size[0][1], round(score, 9), score < 0.005] += 1
    got = language_id.identify(docs, models[0]).collect()
    assert collections.Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9), r["rejected"]) for r in got) == want


def plain_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_rules(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1, 0), (9, 1, 0), (10, 1, 0), (12, 0, 0), (13, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.judge(docs, labels).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in quality.BASE), r["base_failed"]) for r in got), key=repr) == sorted(((i, *plain_quality(t)) for i, t in TEXTS), key=repr)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[9] and kept[0] and not any(kept[k] for k in (4, 5, 6, 7, 12, 13))
    many = spark.createDataFrame([(k, k % 2) for k in range(500)], "doc_id long, quality int")
    drawn = [{tuple(r) for r in quality._sample(many.repartition(n), 40).collect()} for n in (1, 7)]
    assert drawn[0] == drawn[1] and len(drawn[0]) <= 40
    assert quality.judge(nothing, labels).isEmpty() and quality.judge(docs, labels.limit(0)).where("kept").count() > 0


def plain_scores(texts, trusted):
    """The mean log-ratio of each text, less that of the ids in ``trusted``, over words and words with their follower."""
    raw, target, grams, chars = collections.Counter(), collections.Counter(), {}, [0, 0]
    for k, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams[k] = w + list(zip(w, [*w[1:], None]))
        raw.update(grams[k])
        chars[0] += len(t or "")
        if k in trusted:
            target.update(grams[k])
            chars[1] += len(t or "")
    p, share = quality.PRIOR, max(chars[1], 1) / max(chars[0], 1)
    return {k: np.mean([np.log((target[g] + p * share) / (raw[g] + p)) - np.log(share) for g in gs]) if gs else None for k, gs in grams.items()}


def test_log_ratio_and_verdict_by_hand(spark):
    junk = random.Random(2)
    texts = [(k, prose(40, k)) for k in range(60)] + [(100 + k, " ".join(f"{junk.randrange(10**9):x}" for _ in range(40))) for k in range(30)] + [(200, None), (201, "one"), (202, "le mot " * 200)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 60)) for k, _ in texts if k % 2 == 0 and k < 200], "doc_id long, quality int")
    left_out = {r[0] for r in labels.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0).select("doc_id").collect()}
    labelled = {k: v for k, v in map(tuple, labels.collect())}
    want = plain_scores(texts, {k for k, v in labelled.items() if v and k not in left_out})
    cut = {v: np.percentile([want[k] for k in labelled if k in left_out and labelled[k] == v], [0.5, 50]) for v in (0, 1)}
    threshold = min(cut[1][0], (cut[0][1] + cut[1][1]) / 2)
    for n in (1, 7):
        got = {r["doc_id"]: r for r in quality.judge(rows.repartition(n), labels).collect()}
        for k, t in texts:
            assert got[k]["score"] == (want[k] if want[k] is None else pytest.approx(want[k], abs=0.02))  # a few of the hashed n-grams may share a counter
            failed = plain_quality(t)[-1]
            assert got[k]["base_failed"] == failed and (got[k]["kept"] == (not failed and want[k] >= threshold) or abs(want[k] - threshold) < 0.02), k
    assert sum(got[k]["kept"] for k in range(60)) > 55 and not any(got[100 + k]["kept"] for k in range(30))


def low_words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def test_decontamination(spark, docs, nothing):
    items = [(1, prose(40, 9)), (2, "ONE two"), (3, None), (4, "--"), (5, prose(40, 9)), (30, prose(25, 8)), (6, "le"), (7, " ".join(BASE.split()[5:16]))]
    table = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, word string")
    merged = {}
    for i, t in TEXTS:
        w = low_words(t)
        found, hit = set(), set()
        for item, it in items:
            x = low_words(it)
            k = min(10, len(x))
            wins = {tuple(x[s : s + k]) for s in range(len(x) - k + 1)} if k else set()
            for s in range(len(w) - k + 1):
                if k and tuple(w[s : s + k]) in wins:
                    found.add(str(item))
                    hit.update(range(s, s + k))
        merged[i] = (len(w), len(hit), sorted(found))
    for bound in (decontaminate.BOUND, 2500, 2):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate.decontaminate(docs, table, bound=bound).collect()}
        assert got == merged
    assert decontaminate.decontaminate(nothing, table).isEmpty()
    assert decontaminate.decontaminate(docs, table.limit(0)).where("n_hit > 0").isEmpty()


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_classes(texts, t=0.8):
    sets = {i: grams(x) for i, x in texts if i is not None}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    nodes, label, links = sorted(first.values()), {i: i for i in sets}, collections.Counter()
    for a in nodes:
        for b in nodes:
            if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = sorted((label[a], label[b]))
                label = {k: x if v == y else v for k, v in label.items()}
    rep = {i: first[s] if s else i for i, s in sets.items()}
    return {i: (rep[i], label[rep[i]], links[rep[i]]) for i in sets}


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 400])
def test_ngram_join(spark, docs, nothing, block):
    got = {r["doc_id"]: (r["copy_id"], r["class_id"], r["n_links"]) for r in near_duplicates.link_duplicates(docs, block=block).collect()}
    assert got.pop(None) == (None, None, 0)
    assert got == plain_classes(TEXTS)
    assert near_duplicates.link_duplicates(nothing).isEmpty()


@pytest.mark.parametrize("block", [near_duplicates.BLOCK, 700])
def test_ngram_join_of_a_group(spark, block):
    r, base, texts = random.Random(8), prose(100, 77).split(), []
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(100)] = f"new{r.randrange(10**6)}"
        texts.append((k, " ".join(w)))
    texts += [(100 + k, texts[3][1]) for k in range(20)]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    got = {x["doc_id"]: (x["copy_id"], x["class_id"], x["n_links"]) for x in near_duplicates.link_duplicates(rows, block=block).collect()}
    assert got == plain_classes(texts)


def test_bands_reach_the_recall():
    b = near_duplicates.bands()
    assert (1 - 0.8**near_duplicates.ROWS) ** b <= 1e-4 < (1 - 0.8**near_duplicates.ROWS) ** (b - 1)


def test_warc_round_trip_and_pushdown(spark):
    big = "<p>é" + "y" * 1500
    pages = [(1, "http://a/1", big), (2, "http://a/2", big), (3, "http://b/3", big), (4, "u", None), (5, None, "short"), (6, "v\r\nw", "short"), (7, "http://a/7", "WARC/1.1\r\n\r\nx" * 200)]
    table = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string")
    path = scratch(spark, "warc")
    warc.archive_pages(table, path)
    rows = {r["record_id"]: r for r in warc.read_archive(spark, path).collect()}
    assert {k for k, r in rows.items() if r["record_type"] == "revisit"} == {"<urn:page:1>", "<urn:page:2>"}
    assert rows["<urn:page:1>"]["headers"]["WARC-Refers-To"] == "<urn:page:3>"
    for i, _, html in pages:
        r, raw = rows[f"<urn:page:{i}>"], (html or "").encode()
        assert r["headers"]["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(raw).hexdigest()
        assert r["record_type"] == "revisit" and r["payload"] == b"" or r["payload"] == raw
    assert rows["<urn:page:6>"]["target_uri"] == "v w" and rows["<urn:page:5>"]["target_uri"] is None
    some = warc.read_archive(spark, path, "none").where("record_type = 'response' and target_uri like 'http://a/%'")
    assert [(r["record_id"], r["payload"]) for r in some.collect()] == [("<urn:page:7>", None)]
    assert "PushedFilters: [Or" not in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("shared_rows", [warc.SHARED, 0])
def test_warc_of_odd_pages(spark, shared_rows):
    big, other, lone = "a" * 1000, "b" * 2000, "c" * 3000
    pages = [(1, "u", big), (1, "u", big), (None, "u", big), (None, "v", other), (None, "v", other), (5, None, None), (5, None, None), (6, "", ""), (7, "w", lone), (8, "w", big[1:]), (9, "w", big[1:])]
    path = scratch(spark, "warc")
    warc.archive_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), path, shared_rows=shared_rows)
    got = collections.Counter((r["record_id"], r["record_type"], r["headers"].get("WARC-Refers-To"), r["payload"].decode()) for r in warc.read_archive(spark, path).collect())
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    want = [(name(i), "response", None, t or "") for i, _, t in pages if not (i is None and t == big)] + [(name(None), "revisit", name(1), "")]
    assert got == collections.Counter(want)
    none = scratch(spark, "warc")
    warc.archive_pages(spark.createDataFrame([], "page_id long, url string, html string"), none, shared_rows=shared_rows)
    assert warc.read_archive(spark, none).isEmpty()


def test_warc_reader_steps_over_blocks():
    class File:
        def __init__(self, data):
            self.data, self.at, self.got = data, 0, 0

        def size(self):
            return len(self.data)

        def seek(self, at):
            self.at = at

        def read(self, n):
            self.got += n
            self.at += n
            return self.data[self.at - n : self.at]

    rows = [{"payload": b"q" * 3_000_000, "record_type": "response", "record_id": f"r{k}", "target_uri": None, "headers": {}} for k in range(4)]
    import gzip

    for row in rows:
        row["payload"] = np.random.default_rng(1).bytes(3_000_000)
    for read, data in ((warc.records, b"".join(map(warc.record, rows))), (warc.members, b"".join(warc.member(warc.record(r)) for r in rows))):
        f = File(data)
        assert [h["WARC-Record-ID"] for h, _ in read(f, lambda h: h["WARC-Record-ID"] == "r2", False)] == ["r2"]
        assert f.got < 1_000_000
    assert gzip.decompress(data) == b"".join(map(warc.record, rows))
    for own in (data, b"".join(gzip.compress(warc.record(r)) for r in rows)):
        assert [p for _, p in warc.members(File(own), lambda h: True, True)] == [r["payload"] for r in rows]


def test_url_filter(spark):
    rules = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
    cases = [
        ("http://x.example.net/en/1", "x.example.net", "/en/1", "example.net/en/"), ("HTTP://A.NET/b?c#d", "a.net", "/b", "net/"), ("http://net", "net", "", None), ("x://notexample.net/en/", "notexample.net", "/en/", "net/"),
        ("http://example.com/de/?q=://z", "example.com", "/de/", "example.com/de/"), ("no scheme", "", "", None), (None, "", "", None), ("", "", "", None), ("http://É.org/fr/", "É.org", "/fr/", "org/fr/"), ("a\nb://Q.org#x", "q.org", "", None),
    ]
    more = [(100 + k, f"http://h{k}.example.net/en/good{k}", "z") for k in range(60)] + [(200 + k, f"http://h{k}.other.net/spam{k}", "z") for k in range(60)]
    pages = spark.createDataFrame([(k, c[0], "z") for k, c in enumerate(cases)] + more, "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules).collect()}
    for k, (_, host, path, rule) in enumerate(cases):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == (host, path, rule)
        assert got[k]["verdict"] == rules.get(rule, got[k]["verdict"])
    scores = [np.mean([got[k]["score"] for k in ks]) for ks in (range(100, 160), range(200, 260))]
    assert scores[0] > scores[1]
    assert url_filter.filter_urls(pages.limit(0), rules).isEmpty()


def plain_url_scores(labelled, urls):
    """Score of each URL by models of the labelled ones (url -> 1 or 0), with dictionaries."""
    pad = lambda u: b"\x01" * (url_filter.ORDERS - 1) + u.encode() + b"\x02"
    seen, after = collections.Counter(), collections.Counter()
    for u, y in labelled.items():
        raw = pad(u)
        for i in range(url_filter.ORDERS - 1, len(raw)):
            for k in range(1, url_filter.ORDERS + 1):
                seen[y, raw[i - k + 1 : i + 1]] += 1
                after[y, k, raw[i - k + 1 : i]] += 1
    out = {}
    for u in urls:
        raw, total = pad(u), 0.0
        for i in range(url_filter.ORDERS - 1, len(raw)):
            p = [1 / url_filter.ALPHABET] * 2
            for k in range(1, url_filter.ORDERS + 1):
                g = raw[i - k + 1 : i + 1]
                p = [(seen[y, g] + url_filter.PRIOR * p[y]) / (after[y, k, g[:-1]] + url_filter.PRIOR) for y in (0, 1)]
            total += np.log(p[1]) - np.log(p[0])
        out[u] = total / (len(raw) - url_filter.ORDERS + 1)
    return out


def test_url_scores_and_verdicts_by_hand(spark):
    r = random.Random(6)
    rules = {"net/": "block", "org/fr/": "allow"}
    urls = [f"http://{r.choice('abc')}x.net/spam{r.randrange(50)}" for _ in range(60)] + [f"https://{r.choice('xyz')}.org/fr/page-{r.randrange(50)}" for _ in range(60)]
    free = [f"http://q.de/spam{k}" for k in range(5)] + [f"https://q.de/fr/page-{k}" for k in range(5)] + ["é", "http://a.b/" + "long/" * 5000]
    rows = [(k, u) for k, u in enumerate(urls + free + free[:3] + ["", None])] + [(None, free[0])]
    frame = spark.createDataFrame(rows, "page_id long, url string")
    left_out = {x[0] for x in frame.where(F.pmod(F.xxhash64(F.lit(3), "url"), F.lit(5)) == 0).select("url").collect()}
    label = {u: int("/fr/" in u) for u in urls}
    want = plain_url_scores({u: y for u, y in label.items() if u not in left_out}, {u for _, u in rows if u})
    cut = {y: np.percentile([want[u] for u in label if u in left_out and label[u] == y], [5, 95]) for y in (0, 1)}
    threshold = (cut[1][0] + cut[0][1]) / 2
    for n in (1, 7):
        got = url_filter.filter_urls(frame.repartition(n), rules).collect()
        assert collections.Counter((x["page_id"], x["url"]) for x in got) == collections.Counter(rows)
        for x in got:
            score = want[x["url"]] if x["url"] else 0.0
            assert x["score"] == pytest.approx(score, abs=1e-4)
            assert x["rule"] or x["verdict"] == ("allow" if score >= threshold else "block") or abs(score - threshold) < 1e-3
    assert sum(x["verdict"] == "allow" for x in got if x["url"] in free[5:10]) == 5


def test_toxicity_learns_a_pair(spark, docs, nothing):
    r, rows = random.Random(4), []
    for k in range(1500):
        words = [r.choice(VOCABULARY) for _ in range(20)]
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append((k, " ".join(words + ["insult"] * a + ["group"] * b), int(a and b)))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machine = toxicity.fit(table.where("doc_id % 3 <> 0"))
    got = {x["doc_id"]: x["predicted"] for x in toxicity.score(table, machine).collect()}
    held = [k for k in range(1500) if k % 3 == 0]
    assert np.mean([got[k] == rows[k][2] for k in held]) > 0.95
    odd = toxicity.score(docs, machine).collect()
    assert len(odd) == len(TEXTS) and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.score(nothing, machine).isEmpty()
    assert toxicity.score(docs, toxicity.fit(table.limit(0))).where("predicted = 1").isEmpty()


def test_toxicity_by_hand_and_in_any_layout(spark, docs):
    """Pairs without single effects are learned; scores are those of the machine's arrays; equal rows give equal machines."""
    r, rows = random.Random(9), []
    for k in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append((k, " ".join([r.choice(VOCABULARY) for _ in range(20)] + ["insult"] * a + ["group"] * b), int(a != b)))
    rows += [(4000, rows[0][1], 1 - rows[0][2]), (4001, None, 0), (4002, "", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    machines = [toxicity.fit(frame.repartition(n), sample_rows=3900) for n in (1, 7)]
    m = machines[0]
    assert all(np.array_equal(getattr(m, c), getattr(machines[1], c)) for c in ("terms", "weight", "factors")) and m.bias == machines[1].bias
    got = {x["doc_id"]: x for x in toxicity.score(frame, m).collect()}
    assert np.mean([got[k]["predicted"] == y for k, _, y in rows[:4000]]) > 0.9
    for k, t, _ in rows[::200] + rows[-3:]:
        held = [m.terms.tolist().index(x) for x in sorted(set(toxicity.terms([t or ""])[1].tolist())) if x in m.terms]
        z = m.bias + sum(m.weight[i] for i in held) + sum(float(m.factors[i] @ m.factors[j]) for i in held for j in held if i < j)
        assert got[k]["score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    few = toxicity.fit(frame, sample_terms=100)
    assert 0 <= few.bias + 40  # a machine of the few texts that fit


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    clean = [(k, prose(60 + k, 500 + k), "aa") for k in range(40)]
    leak = prose(40, 9)
    extra = [(100, clean[3][1], "aa"), (101, clean[4][1] + " more", "aa"), (102, prose(50, 7) + " " + leak, "aa"), (103, "12 3", None), (104, None, "aa"), (105, "la la " * 100, "aa"), (3, clean[3][1], "aa"), (None, prose(70, 900), None)]
    docs = spark.createDataFrame([(*d, "s", 1, "c") for d in clean + extra], "doc_id long, text string, lang string, source string, n_chars long, __id string").drop("__id").withColumn("score", F.lit("c"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(30)] + [(105, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {*range(40), None}
    ends = got.where("start = 0").groupBy("doc_id").count().where("count > 1")
    assert ends.isEmpty()
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
