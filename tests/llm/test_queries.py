"""The registered queries over the driver's tables, with plain versions and DuckDB."""

import collections
import os
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarry.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()
DERIVED = r"""with w as (select doc_id, text, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
 win as (select doc_id, unnest(range(1, len(w) - 6)) as s, w from w), h as (select doc_id, s, array_to_string(w[s:s + 7], ' ') as t from win),
 r as (select doc_id, t from h group by all having count(*) > 1),
 c as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(s, s + 8)) as p from h join r using (doc_id, t)) group by doc_id)
 select doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols,
  len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words, len(w) < 20 or 100 * coalesce(n, 0) > 30 * len(w) as base_failed from w left join c using (doc_id)"""
RULES = r"""with p as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
 r(rule, h, p0, verdict) as (values ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'), ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow'))
 select page_id, host, path, arg_max(rule, length(rule)) as rule, arg_max(verdict, length(rule)) as verdict from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, p0) group by all"""


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.sql("select doc_id, text from documents").fetchall())


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in texts.items()}
    got = {tuple(r) for r in queries.op1_token_counts(spark, SF).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    assert got == {(i, len((texts[i] or "").encode()), n, n > 512) for i, n in want.items()}


def test_op3(spark, con):
    want = {r[0]: r[1:] for r in con.sql(RULES).fetchall()}
    got = {r["page_id"]: r for r in queries.op3_url_filters(spark, SF).collect()}
    assert {k: (r["host"], r["path"], r["rule"]) for k, r in got.items()} == {k: v[:3] for k, v in want.items()}
    assert all(r["verdict"] in ("allow", "block") and want[k][3] in (None, r["verdict"]) for k, r in got.items())


def test_op4(spark, con):
    got = queries.op4_quality_rules(spark, SF).collect()
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert {tuple(r[c] for c in columns) for r in got} == set(con.sql(DERIVED).fetchall())
    quality = dict(con.sql("select doc_id, quality from labels where quality is not null").fetchall())
    passed = [r for r in got if not r["base_failed"] and r["doc_id"] in quality]
    assert np.mean([r["kept"] for r in passed if quality[r["doc_id"]]]) > 0.95 and not any(r["kept"] for r in got if r["base_failed"])


@pytest.mark.parametrize("name, fold, rest", [("op6_toxicity", 5, 0), ("op10_language_id", 3, 1)])
def test_folds_and_held_out_accuracy(spark, con, texts, name, fold, rest):
    got = {r["doc_id"]: r for r in queries.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(texts)
    held = {i for i in texts if zlib.crc32(str(i).encode()) % fold == rest}
    assert all(r["held_out"] == (i in held) and 0 <= r["score"] <= 1 for i, r in got.items())
    if name == "op6_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
        return
    langs = dict(con.sql("select doc_id, lang from documents where lang is not null and len(regexp_extract_all(text, '[a-zA-Z]+')) > 20").fetchall())
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in langs.items() if i in held]) > 0.97


def test_op8_and_op9(spark, texts):
    rows = queries.op8_packing(spark, SF).collect()
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, x in texts.items():
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 0]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *np.cumsum([r["length"] for r in own])[:-1]] and sum(r["length"] for r in own) == len(ids) == own[0]["doc_tokens"]
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
    t, at = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0
    stored = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op9_chunk_store(spark, SF).collect()}
    for i in sorted(texts):
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        assert stored[i] == (at, len(ids), crc(ids))
        at += len(ids)


def test_op2_finds_every_link_of_a_table(spark):
    """All links at 0.8 among the distinct sets of a thousand documents, counted over shared n-grams."""
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op2_ngram_join(spark, sf).collect()}
    first, sets = {}, {}
    for i, t in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        w = (t or "").lower().split()
        s = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([i])
        sets[i] = first.setdefault(s, i)
    postings = collections.defaultdict(list)
    for s, i in first.items():
        for g in s:
            postings[g].append(i)
    both, size = collections.Counter(), {i: len(s) for s, i in first.items()}
    for ids in postings.values():
        both.update((a, b) for a in ids for b in ids if a < b)
    links = collections.Counter()
    for (a, b), n in both.items():
        if n >= 0.8 * (size[a] + size[b] - n):
            links[a] += 1
            links[b] += 1
    assert {i: (got[i]["copy_id"], got[i]["n_links"]) for i in got} == {i: (c, links[c]) for i, c in sets.items()}
