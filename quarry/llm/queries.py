"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.storage import scratch, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), seq_len=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm import chunk_store

    path = scratch(spark, "chunk-store")
    chunk_store.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return chunk_store.digests(spark, path)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language_id import identify, learn

    docs = table(spark, sf_dir, "documents")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = learn(docs.where(fold != 1))
    found = identify(docs, model)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


#: The URL rules of op3.
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import archive_pages, read_archive

    path = scratch(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    records = read_archive(spark, path)
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    is_response = F.col("record_type") == "response"
    return records.select(
        page(F.col("record_id")).alias("page_id"),
        F.when(is_response, F.octet_length("payload")).otherwise(F.col("headers")["X-Payload-Length"].cast("long")).cast("long").alias("payload_bytes"),
        F.when(is_response, F.sha1("payload")).otherwise(F.substring(F.col("headers")["WARC-Payload-Digest"], 6, 40)).alias("payload_digest"),
        "record_type",
        page(F.col("headers")["WARC-Refers-To"]).alias("refers_to"),
    )


OP5_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
r as (select max(page_id) as first, html from p where strlen(html) >= 1000 group by html)
select p.page_id, strlen(p.html)::bigint as payload_bytes, sha1(p.html) as payload_digest,
  case when r.first is null or r.first = p.page_id then 'response' else 'revisit' end as record_type,
  case when r.first <> p.page_id then r.first end as refers_to
from p left join r on p.html = r.html
"""


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.toxicity import fit_by_id, score

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    known = labels.where(fold != 0).select("doc_id", F.col("toxic").alias("label"))
    machine = fit_by_id(docs.select("doc_id", "text"), known)
    return score(docs, machine).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_duplicates import link_duplicates

    return link_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import BASE, judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *BASE, "base_failed", "kept", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.decontaminate import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: Windows are compared as joined words; no word holds a blank.
OP7_SQL = r"""
with dw as (select row_number() over () as row, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
iw as (select row_number() over () as item, item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
win as (select distinct item, item_id, k, array_to_string(w[s:s + k - 1], ' ') as t from (
  select item, item_id, w, least(10, len(w)) as k, unnest(range(1, len(w) - least(10, len(w)) + 2)) as s from iw where len(w) > 0)),
ks as (select distinct k from win),
occ as (select row, k, s, array_to_string(w[s:s + k - 1], ' ') as t from (
  select row, w, k, unnest(range(1, len(w) - k + 2)) as s from dw, ks where len(w) >= k)),
hit as (select o.row, o.s, o.k, win.item, win.item_id from occ o join win on o.t = win.t and o.k = win.k),
places as (select row, count(distinct p) as n_hit from (select row, unnest(range(s, s + k)) as p from hit) group by row),
found as (select row, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hit group by row)
select dw.doc_id, len(dw.w)::bigint as n_words, coalesce(p.n_hit, 0)::bigint as n_hit, coalesce(f.n_items, 0)::bigint as n_items,
  sha256(coalesce(f.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from dw left join places p using (row) left join found f using (row)
"""


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.whitening import whiten_rows

    return whiten_rows(table(spark, sf_dir, "embeddings"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.filter_audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Verdicts are bits of a number; a step's state has the bits of the filters before it.
OP12_SQL = r"""
with l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, min(doc_id) over (partition by text) as least from t),
m as (select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int
  + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > least, false)::int as m
  from w left join l using (doc_id)),
g as (select part, m, good, toxic, count(*) as n from m group by all),
x as (select unnest(string_split('ABCDE', '')) as x),
o as (select a.x || b.x || c.x || d.x || e.x as o from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select o, s, substr(o, s, 1) as f, (1 << (instr('ABCDE', substr(o, s, 1)) - 1))::int as bit,
  list_reduce(list_prepend(0, list_transform(range(1, s), lambda i: (1 << (instr('ABCDE', substr(o, i, 1)) - 1))::int)), lambda p, q: p + q) as state from o, range(1, 6) r(s)),
c as (select part, o, s, f, sum(case when m & (state | bit) = 0 then n else 0 end) as kept, sum(case when m & state = 0 and m & bit <> 0 then n else 0 end) as removed,
  sum(case when m & state <> 0 and m & bit <> 0 then n else 0 end) as redundant, sum(case when m = bit then n else 0 end) as unique_fails,
  sum(case when m & state = 0 and m & bit <> 0 and good then n else 0 end) as good_lost, sum(case when m & state = 0 and m & bit <> 0 and toxic then n else 0 end) as toxic_lost
  from g, s group by all)
select part, o as filter_order, s::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, f))::bigint as shapley from c
"""


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


#: What all slots of a source take together is the first words of its circle, up to its target.
OP13_SQL = r"""
with d as (select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as size,
  md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as shuffle from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as place from d group by source),
w as (select *, 2 * source_size as bound, [5, 2, 1][((place - 1) % 3 + 1)::int] as weight from s),
c as (select *, row_number() over (order by bound / weight, place) as k, coalesce(sum(bound) over (order by bound / weight, place rows between unbounded preceding and 1 preceding), 0)::bigint as full_words,
  sum(weight) over (order by bound / weight, place rows between current row and unbounded following) as open_weight from w),
v as (select arg_min(level, k) as level from (select k, bound / weight as most, (1.5::double * (select sum(source_size) from s)::bigint - full_words) / open_weight as level from c) where level <= most),
t as (select source, source_size, least(bound::double, level * weight) as target, least(bound, round(level * weight)::bigint) as words from w, v),
b as (select doc_id, size, source_size, target, words, coalesce(sum(size) over (partition by d.source order by shuffle, doc_id, size rows between unbounded preceding and 1 preceding), 0) as lo from d join t on d.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target, (greatest(0, least(lo + size, words) - lo) + greatest(0, least(lo + source_size + size, words) - lo - source_size))::bigint as taken from b
"""


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_ngram_join, op3_url_filters, op4_quality_rules, op5_warc, op6_toxicity, op7_decontamination, op8_packing, op9_chunk_store, op10_language_id,
        op11_embedding_whitening, op12_filter_audit, op13_source_mixing,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op5_warc": OP5_SQL, "op7_decontamination": OP7_SQL.replace("\\\\", "\\"), "op12_filter_audit": OP12_SQL.replace("\\\\", "\\"), "op13_source_mixing": OP13_SQL.replace("\\\\", "\\"),
}
