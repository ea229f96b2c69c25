"""The registered queries over the driver's tables and the SQL that they equal.

The synthetic corpus: a chunk is a document with the embedding of the same id, if
there is one; a query is a benchmark item with the embedding of its id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking, conversations, dialogue, evaluation, knowledge_base, lexical_index, models, pruned, retrieval, statistics
from quarry.operators.retrieval import RetrieveConfig
from quarry.sources import files
from quarry.storage import materialise, scratch, table
from quarry.streaming import deltas, indexing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"query {f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_pos"), F.col("embedding").alias("vector"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"), "text", F.col("source").alias("doc_name"))
    return docs.join(vectors, "chunk_pos", "left")


def passages(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus without vectors, for what reads texts alone: no join."""
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"), "text", F.col("source").alias("doc_name"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id", "left")


def kb_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = corpus(spark, sf)
    return d.select("chunk_pos", F.col("chunk_pos").alias("chunk_id"), F.pmod("chunk_pos", F.lit(50)).alias("doc_id"), "text", F.length("text").cast("long").alias("tokens"), "vector")


# -- text -----------------------------------------------------------------------------------

#: Weights are added from the left as doubles on both sides.
SQL_TOKENS = """floor(list_reduce(list_prepend(0.0::double, list_transform(string_split(coalesce({0}, ''), ''), lambda c:
 case when c = '' then 0.0 when regexp_matches(c, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}\\x{{ac00}}-\\x{{d7af}}\\x{{f900}}-\\x{{faff}}]') then 1.0
 when c in (' ', chr(10), chr(9)) then 0.2 else 0.25 end::double)), lambda a, b: a + b) + 0.5)::bigint"""
WORD = r"'[a-z0-9][a-z0-9_\-\.]{0,30}'"
TRIM = r"[\t\n\x0B\f\r \x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{TRIM}|{TRIM}$', '', 'g')"


@query(f"select doc_id, {SQL_TOKENS.format('text')} as n_tokens from documents")
def token_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.count_tokens(F.col("text")).alias("n_tokens"))


@query(r"""select doc_id, len(regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|\s+|[^\s]'))::bigint as n_units from documents""")
def unit_stats(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(T.units(F.col("text"))).cast("long").alias("n_units"))


@query(f"""select doc_id, len(t)::bigint as n_terms, len(list_distinct(t))::bigint as n_distinct, md5(array_to_string(t, ' ')) as terms_md5
from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), {WORD}) as t from documents)""")
def index_terms(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", T.index_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


#: Letters that stand for CJK characters, as the tables hold none.
LATIN, HAN = "abcdefghij", "人工智能学习资料机器"


@query(f"""with d as (select doc_id, translate(lower(text), '{LATIN}', '{HAN}') as t from documents where text is not null),
 l as (select doc_id, list_concat(regexp_extract_all(t, {WORD}), flatten(list_transform(regexp_extract_all(t, '[\\x{{4e00}}-\\x{{9fff}}]+'),
  lambda r: list_concat(string_split(r, ''), list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))) as terms from d)
 select doc_id, len(terms)::bigint as n_terms, md5(array_to_string(terms, ' ')) as terms_md5 from l""")
def index_terms_cjk(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    t = d.select("doc_id", T.index_terms(F.translate(F.lower("text"), LATIN, HAN)).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.md5(F.array_join("t", " ")).alias("terms_md5"))


@query(rf"""select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, '|')) as md5 from (select doc_id, list_filter(list_transform(
 regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'), '[^。！？!?；;\n]+[。！？!?；;]?["''”’）)]*|\n+'), lambda x: {sql_trim('x')}), lambda x: x <> '') as s from documents)""")
def sentences(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("md5"))


@query(rf"""with p as (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from documents),
 q as (select doc_id, case when len(regexp_split_to_array(t, '\n\s*\n')) <= 1 then string_split(t, chr(10)) else regexp_split_to_array(t, '\n\s*\n') end as parts from p),
 r as (select doc_id, list_filter(list_transform(parts, lambda x: {sql_trim('x')}), lambda x: x <> '') as s from q)
 select doc_id, len(s)::bigint as n_paragraphs, md5(array_to_string(s, '|')) as md5 from r""")
def paragraphs(spark, sf):
    s = table(spark, sf, "documents").select("doc_id", T.paragraphs(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_paragraphs"), F.md5(F.array_join("s", "|")).alias("md5"))


def _sql_chain(x: str, steps: list[tuple[str, str]]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
    return sql_trim(x)


#: The same steps as in functions/text.py, for DuckDB's dialect.
HTML_STEPS = [(r"(?i)<script[\s\S]*?</script>", "' '"), (r"(?i)<style[\s\S]*?</style>", "' '"), (r"(?i)<br\s*/?>", "chr(10)"), (r"(?i)</(?:p|div|li|h[1-6]|tr)>", "chr(10)"), ("<[^>]+>", "' '"), ("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), (r"[ \t]+", "' '"), (r"\n{3,}", "chr(10) || chr(10)")]
CLEAN_STEPS = [(r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "''"), (r"[ \t]+\n", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")]


@query(f"select page_id, length(t)::bigint as n_chars, md5(t) as md5 from (select page_id, {_sql_chain('html', HTML_STEPS)} as t from pages)")
def html_text(spark, sf):
    t = table(spark, sf, "pages").select("page_id", T.html_text(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("md5"))


@query(f"select doc_id, md5({_sql_chain('text', CLEAN_STEPS)}) as md5 from documents")
def normalize_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.normalize(F.col("text"))).alias("md5"))


@query(rf"""with l as (select doc_id, list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: {sql_trim('x')} <> '') as l from documents where text is not null),
 r as (select doc_id, list_transform(l, lambda x: list_transform(string_split(x, ','), lambda v: {sql_trim("regexp_replace(v, '^" + '"|"' + "$', '', 'g')")})) as r from l),
 o as (select doc_id, array_to_string(list_transform(r[2:], lambda x: array_to_string(case when len(x) = len(r[1]) then list_transform(range(1, len(x) + 1), lambda i: r[1][i] || ': ' || x[i]) else x end, ' | ')), chr(10)) as t from r)
 select doc_id, length(coalesce(t, ''))::bigint as n_chars, md5(coalesce(t, '')) as md5 from o""")
def csv_lines(spark, sf):
    t = table(spark, sf, "documents").where("text is not null").select("doc_id", T.csv_lines(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("md5"))


@query("""with k as (select page_id, substring(url, 1, (page_id % 20)::bigint) as k from pages)
 select page_id, case when length(k) = 0 or k is null then '' when length(k) <= 8 then repeat('*', length(k)) else left(k, 4) || '****' || right(k, 4) end as masked from k""")
def mask_key(spark, sf):
    k = table(spark, sf, "pages").select("page_id", F.substring(F.col("url"), F.lit(1), (F.col("page_id") % 20).cast("int")).alias("k"))
    return k.select("page_id", T.mask_key(F.col("k")).alias("masked"))


@query(rf"""with e as (select lower(regexp_extract(p, '\.([^./]+)$', 1)) as ext from (select url as p from pages union all select source || '.' || lang from documents union all select lang || '.Md' from documents) where p is not null)
 select ext, count(*)::bigint as n, ext in ({", ".join(f"'{e}'" for e in T.EXTENSIONS)}) as supported from e group by ext""")
def extension_gate(spark, sf):
    d = table(spark, sf, "documents")
    names = table(spark, sf, "pages").select(F.col("url").alias("p")).union(d.select(F.concat("source", F.lit("."), "lang"))).union(d.select(F.concat("lang", F.lit(".Md")))).where("p is not null")
    return names.groupBy(T.extension(F.col("p")).alias("ext")).agg(F.count("*").alias("n"), F.bool_or(T.supported(F.col("p"))).alias("supported"))


# -- retrieval ------------------------------------------------------------------------------

SQL_D = f"d as (select doc_id as chunk_pos, regexp_extract_all(lower(coalesce(text, '')), {WORD}) as t from documents)"
SQL_LEX = f"""{SQL_D}, l as (select chunk_pos, len(t) as dl, unnest(t) as term from d),
 st as (select count(*) as n, avg(len(t)) as avgdl from d), tf as (select chunk_pos, dl, term, count(*) as tf from l group by all),
 df as (select term, count(*) as df from tf group by term),
 qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), {WORD})[1:128]) as term from benchmark),
 qf as (select query_id, term, count(*) as qf from qt group by all),
 raw as (select query_id, chunk_pos, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qf join tf using (term) join df using (term), st group by all),
 lex as (select query_id, chunk_pos, case when score > 0 then score / max(score) over (partition by query_id) else 0 end as bm25 from raw)"""
SQL_SEM = """v as (select vec_id, embedding::double[] as e from embeddings),
 sem as (select b.item_id as query_id, d0.doc_id as chunk_pos, list_cosine_similarity(c.e, q.e) as semantic from benchmark b join v q on q.vec_id = b.item_id, documents d0 join v c on c.vec_id = d0.doc_id)"""
SQL_BOTH = """both_ as (select b.item_id as query_id, d1.doc_id as chunk_pos, coalesce(s.semantic, 0.0) as semantic, coalesce(x.bm25, 0.0) as bm25 from benchmark b cross join documents d1
 left join sem s on s.query_id = b.item_id and s.chunk_pos = d1.doc_id left join lex x on x.query_id = b.item_id and x.chunk_pos = d1.doc_id)"""
SQL_RRF = """rs as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(semantic, 9) desc, chunk_pos) as r from both_ where semantic > 0),
 rb as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(bm25, 9) desc, chunk_pos) as r from both_ where bm25 > 0),
 fused as (select a.*, coalesce(1.0::double / (60 + rs.r), 0) + coalesce(1.0::double / (60 + rb.r), 0) as fused from both_ a left join rs using (query_id, chunk_pos) left join rb using (query_id, chunk_pos))"""


def _sql_fused(expression: str) -> str:
    return f"fused as (select *, {expression} as fused from both_)"


def _sql_top(fused: str, scale: str, k: int = 30) -> str:
    return f"""with {SQL_LEX}, {SQL_SEM}, {SQL_BOTH}, {fused},
 top as (select *, row_number() over (partition by query_id order by round(fused, 9) desc, chunk_pos) as rank from fused)
 select query_id, chunk_pos, rank::int as rank, round(semantic, 6) as semantic, round(bm25, 6) as bm25, round(least(1.0, greatest(0.0, fused / {scale})), 6) as fused_norm from top where rank <= {k}"""


def _shown(df: DataFrame) -> DataFrame:
    r = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)
    return df.select("query_id", "chunk_pos", "rank", r("semantic"), r("bm25"), r("fused_norm"))


def _found(spark, sf, **options) -> DataFrame:
    return retrieval.retrieve(corpus(spark, sf), questions(spark, sf), RetrieveConfig(**options), passages(spark, sf))


def _mode(spark, sf, **options) -> DataFrame:
    return _shown(_found(spark, sf, **options))


@query(f"with {SQL_D}, e as (select unnest(list_distinct(t)) as term from d) select term, count(*)::bigint as df from e group by term")
def doc_frequency(spark, sf):
    p = retrieval.postings(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"), "text"))
    return p.groupBy("term").agg(F.count("*").alias("df"))


@query(f"with {SQL_D} select count(*)::bigint as n, round(avg(len(t)), 6) as avgdl from d")
def corpus_stats(spark, sf):
    return retrieval.corpus_stats(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"), "text")).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"""with {SQL_LEX} select query_id, chunk_pos, rank::int as rank, round(score, 6) as score from (
 select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pos) as rank from raw) where rank <= 10""")
def bm25_topk(spark, sf):
    s = retrieval.bm25_first(passages(spark, sf), questions(spark, sf), 10)
    return s.select("query_id", "chunk_pos", "rank", F.round("bm25", 6).alias("score"))


#: The corpus after the changes of ``_changed_index``.
SQL_CHANGED = """corpus as (select doc_id, case when lang = 'de' then text || ' revised edition' else text end as text from documents where source is distinct from 'src3' and lang is distinct from 'es'
 union all select -item_id - 1, text from benchmark)"""


def _changed_index(spark, sf) -> str:
    """An index of the documents, then one run of edits and deletions, one of further chunks, one compaction and one more run of deletions."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"), "text", "lang", "source")
    path = scratch(spark, "lexical-index")
    lexical_index.create(docs, path, buckets=16)
    edited = docs.where("lang = 'de'").select("chunk_pos", F.concat("text", F.lit(" revised edition")).alias("text"))
    lexical_index.update(spark, path, edited, docs.where("source = 'src3'"))
    lexical_index.update(spark, path, table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("chunk_pos"), "text"))
    lexical_index.compact(spark, path)
    lexical_index.update(spark, path, gone=docs.where("lang = 'es'"))
    return path


@query(f"""with {SQL_CHANGED}, {SQL_LEX.replace("from documents)", "from corpus)")} select query_id, chunk_pos, rank::int as rank, round(score, 6) as score from (
 select *, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pos) as rank from raw) where rank <= 10""")
def indexed_bm25_topk(spark, sf):
    s = lexical_index.bm25_first(spark, _changed_index(spark, sf), questions(spark, sf), 10)
    return s.select("query_id", "chunk_pos", "rank", F.round("bm25", 6).alias("score"))


@query(f"""with {SQL_CHANGED}, {SQL_D.replace("from documents)", "from corpus)")}, b as (select distinct unnest(regexp_extract_all(lower(text), {WORD})) as term from benchmark),
 e as (select unnest(list_distinct(t)) as term from d) select term, count(*)::bigint as df, (select count(*) from d)::bigint as n, round((select avg(len(t)) from d), 6) as avgdl from e join b using (term) group by term""")
def indexed_frequencies(spark, sf):
    path = _changed_index(spark, sf)
    terms = materialise(retrieval.asked_terms(questions(spark, sf)).select("term").distinct(), "terms")
    df = lexical_index.postings(spark, path, terms).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(lexical_index.stats(spark, path))).select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


@query(f"with {SQL_LEX} select query_id, count(*)::bigint as n, round(max(bm25), 6) as top, round(sum(bm25), 4) as total from lex group by query_id")
def bm25_norm(spark, sf):
    s = retrieval.normalised(retrieval.bm25(passages(spark, sf), questions(spark, sf)))
    return s.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.max("bm25"), 6).alias("top"), F.round(F.sum("bm25"), 4).alias("total"))


@query("""with v as (select vec_id, embedding::double[] as e from embeddings), s as (select a.vec_id as query_id, b.vec_id as chunk_pos, list_cosine_similarity(a.e, b.e) as semantic from v a, v b where a.vec_id % 20 = 0)
 select query_id, chunk_pos, rank::int as rank, round(semantic, 6) + 0.0 as semantic from (select *, row_number() over (partition by query_id order by round(semantic, 9) desc, chunk_pos) as rank from s) where rank <= 10""")
def dense_topk(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    s = retrieval.dense(v.select(F.col("vec_id").alias("chunk_pos"), F.col("embedding").alias("vector")), asked, 10)
    return s.select("query_id", "chunk_pos", retrieval.ranked("semantic"), F.round("semantic", 6).alias("semantic")).where("rank <= 10")


@query(ORACLE_SQL["dense_topk"])
def dense_pruned(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    s, _ = pruned.dense(v.select(F.col("vec_id").alias("chunk_pos"), F.col("embedding").alias("vector")), asked, 10)
    return s.select("query_id", "chunk_pos", "rank", (F.round("semantic", 6) + F.lit(0.0)).alias("semantic"))


@query(ORACLE_SQL["bm25_topk"].replace("[1:128]", ""))
def bm25_pruned(spark, sf):
    s, _ = pruned.bm25(passages(spark, sf), questions(spark, sf), 10, terms=None)
    return s.select("query_id", "chunk_pos", "rank", F.round("bm25", 6).alias("score"))


@query(_sql_top(SQL_RRF, "(2.0::double / 61)"))
def hybrid_rrf(spark, sf):
    return _mode(spark, sf)


@query(_sql_top(_sql_fused("(semantic * 0.6 + bm25 * 0.4) / 1.0"), "1.0"))
def hybrid_weighted(spark, sf):
    return _mode(spark, sf, fusion="weighted")


@query(_sql_top(_sql_fused("semantic"), "1.0").replace("round(bm25, 6) as bm25", "0.0::double as bm25"))
def mode_semantic(spark, sf):
    return _mode(spark, sf, mode="semantic")


@query(_sql_top(_sql_fused("bm25"), "1.0").replace("round(semantic, 6) as semantic", "0.0::double as semantic"))
def mode_bm25(spark, sf):
    return _mode(spark, sf, mode="bm25")


@query(f"""with {SQL_LEX}, {SQL_SEM}, {SQL_BOTH},
 a as (select query_id, 0 as variant, chunk_pos, semantic as fused from both_ union all select query_id, 1, chunk_pos, bm25 from both_),
 b as (select *, row_number() over (partition by query_id, variant order by round(fused, 9) desc, chunk_pos) as r from a),
 c as (select *, row_number() over (partition by query_id, chunk_pos order by round(fused, 9) desc, variant) as v from b where r <= 30),
 e as (select *, row_number() over (partition by query_id order by round(fused, 9) desc, chunk_pos) as place from c where v = 1)
 select query_id, chunk_pos, variant, place::int as place, round(fused, 6) as fused from e where place <= 30""")
def multi_query_merge(spark, sf):
    parts = [_found(spark, sf, mode=m).select("query_id", F.lit(k).alias("variant"), "chunk_pos", "fused") for k, m in enumerate(("semantic", "bm25"))]
    return retrieval.merge_variants(parts[0].union(parts[1])).select("query_id", "chunk_pos", "variant", "place", F.round("fused", 6).alias("fused"))


def _refs(spark, sf) -> DataFrame:
    return retrieval.context(_found(spark, sf), 0.35)


SQL_REFS = f"""with {SQL_LEX}, {SQL_SEM}, {SQL_BOTH}, {SQL_RRF},
 top as (select *, row_number() over (partition by query_id order by round(fused, 9) desc, chunk_pos) as rank from fused),
 fin as (select *, least(1.0, greatest(0.0, fused / (2.0::double / 61))) as f from top where rank <= 30),
 refs as (select *, row_number() over (partition by query_id order by round(f, 9) desc, chunk_pos) as ref from fin where round(f, 9) >= 0.35)"""


@query(SQL_REFS + " select query_id, ref::int as ref, chunk_pos, round(f, 4) as score, 'fusion' as score_from from refs where ref <= 8")
def threshold_context(spark, sf):
    return _refs(spark, sf).select("query_id", "ref", "chunk_pos", F.round("final_score", 4).alias("score"), "score_from")


@query(SQL_REFS + """ select query_id, md5(string_agg('[' || ref || '] 来源：' || source || chr(10) || text, chr(10) || chr(10) order by ref)) as block_md5
 from refs join documents on doc_id = chunk_pos where ref <= 8 group by query_id""")
def context_block(spark, sf):
    return retrieval.context_block(_refs(spark, sf), passages(spark, sf)).select("query_id", F.md5("block").alias("block_md5"))


SQL_FIN = SQL_REFS.split(",\n refs as")[0]


@query(SQL_FIN + """ select query_id, chunk_pos, round(f, 4) as best from (select *, max(round(f, 9)) over (partition by query_id) as top from fin) where rank = 1 and top < 0.9""")
def best_rejected(spark, sf):
    found = _found(spark, sf)
    return retrieval.best_rejected(found, 0.9).select("query_id", "chunk_pos", F.round("best", 4).alias("best"))


@query(SQL_FIN + """ select query_id, chunk_pos, rank::int as rank, round(f, 4) as score, source as doc_name, md5(substring(text, 1, 200)) as preview_md5 from fin join documents on doc_id = chunk_pos""")
def search_view(spark, sf):
    shown = retrieval.projected(_found(spark, sf), passages(spark, sf))
    return shown.select("query_id", "chunk_pos", "rank", F.col("fused_norm").alias("score"), "doc_name", F.md5("preview").alias("preview_md5"))


@query(SQL_REFS + f""", t as (select query_id, ref, chunk_pos, list_distinct(regexp_extract_all(lower(text), {WORD})) as terms from refs join documents on doc_id = chunk_pos where ref <= 8),
 folded as (select query_id, list_reduce(list({{'k': [{{'ref': ref, 'pos': chunk_pos, 'terms': terms}}]}} order by ref), lambda a, b: case when len(list_filter(a.k, lambda y:
  len(list_intersect(y.terms, b.k[1].terms)) / len(list_distinct(list_concat(y.terms, b.k[1].terms))) >= 0.3)) > 0 then a else {{'k': list_concat(a.k, b.k)}} end) as f from t group by query_id)
 select query_id, x.ref::int as ref, x.pos as chunk_pos from (select query_id, unnest(f.k) as x from folded)""")
def context_dedupe(spark, sf):
    return retrieval.without_repeats(_refs(spark, sf), passages(spark, sf), 0.3)


@query(f"""with t as (select item_id as query_id, list_distinct(regexp_extract_all(lower(d.text), {WORD})) as a, list_distinct(regexp_extract_all(lower(b.text), {WORD})) as e from benchmark b join documents d on d.doc_id = b.item_id),
 n as (select *, len(list_intersect(a, e)) as i, len(list_distinct(list_concat(a, e))) as u from t)
 select query_id, round(case when len(a) > 0 then i / len(a) else 0 end, 6) as precision, round(case when len(e) > 0 then i / len(e) else 0 end, 6) as recall, round(case when u > 0 then i / u else 0 end, 6) as jaccard from n""")
def eval_jaccard(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer"))
    rows = table(spark, sf, "benchmark").withColumnRenamed("text", "expected").join(d, "item_id").withColumnRenamed("item_id", "query_id")
    found = retrieval.evaluate(rows)
    return found.select("query_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "jaccard")])


@query(f"""with {SQL_LEX}, {SQL_SEM}, {SQL_BOTH}, best as (select query_id, max(semantic) as best from both_ group by query_id)
 select query_id, best >= 0.95 as answered, round(best, 4) + 0.0 as best from best""")
def no_answer(spark, sf):
    best = _found(spark, sf, mode="semantic").groupBy("query_id").agg(F.max("semantic").alias("best"))
    return best.select("query_id", (F.col("best") >= 0.95).alias("answered"), (F.round("best", 4) + F.lit(0.0)).alias("best"))


# -- searches of other questions ------------------------------------------------------------


def _sql_lex(asked: str) -> str:
    """The lexical CTEs for questions (query_id, text) of the table ``asked``."""
    own = f"qt as (select item_id as query_id, unnest(regexp_extract_all(lower(text), {WORD})[1:128]) as term from benchmark)"
    assert own in SQL_LEX
    return SQL_LEX.replace(own, own.replace("item_id as query_id", "query_id").replace("from benchmark", f"from {asked}"))


@query(f"""with d as (select coalesce(source, '') as session, doc_id as chunk_pos, regexp_extract_all(lower(coalesce(text, '')), {WORD}) as t from documents),
 st as (select session, count(*) as n, avg(len(t)) as avgdl from d group by session), l as (select session, chunk_pos, len(t) as dl, unnest(t) as term from d),
 tf as (select session, chunk_pos, dl, term, count(*) as tf from l group by all), df as (select session, term, count(*) as df from tf group by all),
 qf as (select item_id as query_id, term, count(*) as qf from (select item_id, unnest(regexp_extract_all(lower(text), {WORD})) as term from benchmark) group by all),
 raw as (select tf.session, query_id, chunk_pos, sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score
  from qf join tf using (term) join df on df.term = tf.term and df.session = tf.session join st on st.session = tf.session group by all)
 select session, query_id, chunk_pos, rank::int as rank, round(score, 6) as score from (select *, row_number() over (partition by session, query_id order by round(score, 9) desc, chunk_pos) as rank from raw) where rank <= 3""")
def session_topk(spark, sf):
    """Every source is a corpus of its own, in which all questions are asked."""
    docs = table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("session"), F.col("doc_id").alias("chunk_pos"), "text")
    asked = docs.select("session").distinct().join(F.broadcast(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")))
    s = retrieval.session_topk(docs, asked, 3, terms=None)
    return s.select("session", "query_id", "chunk_pos", "rank", F.round("bm25", 6).alias("score"))


SQL_VARIANTS = """v as (select item_id * 10 + v as query_id, item_id, v::int as variant, array_to_string(w[5 * v + 1:5 * v + 5], ' ') as text
 from (select item_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark where text is not null), range(2) t(v))"""
SQL_VARIANT_FIRST = f"""with {SQL_VARIANTS}, {_sql_lex("v")}, rb as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(bm25, 9) desc, chunk_pos) as r from lex where bm25 > 0),
 a as (select v.item_id, v.variant, d1.doc_id as chunk_pos, coalesce(1.0::double / (60 + r), 0.0) as fused from v cross join documents d1 left join rb on rb.query_id = v.query_id and rb.chunk_pos = d1.doc_id),
 b as (select *, row_number() over (partition by item_id, variant order by round(fused, 9) desc, chunk_pos) as r from a)"""


def _variants(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two queries that a model makes of each question, searched together; they have no vectors, so by terms alone."""
    asked = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), "text")
    made = dialogue.rewrite(asked, _first_words, "multi").withColumn("vector", F.lit(None).cast("array<float>"))
    return retrieval.search_variants(corpus(spark, sf), made, texts=passages(spark, sf))


@query(f"""{SQL_VARIANT_FIRST}, c as (select *, row_number() over (partition by item_id, chunk_pos order by round(fused, 9) desc, variant) as v1 from b where r <= 30),
 e as (select *, row_number() over (partition by item_id order by round(fused, 9) desc, chunk_pos) as place from c where v1 = 1)
 select item_id as query_id, chunk_pos, variant, place::int as place, round(fused, 6) as fused from e where place <= 30""")
def variant_search(spark, sf):
    return _variants(spark, sf)[0].select("query_id", "chunk_pos", "variant", "place", F.round("fused", 6).alias("fused"))


@query(f"{SQL_VARIANT_FIRST} select item_id as query_id, variant, r::int as rank, chunk_pos from b where r <= 10")
def variant_trace(spark, sf):
    return _variants(spark, sf)[1].select("query_id", "variant", "rank", "chunk_pos")


#: Terms a reranker takes of a question, and those that the model which stands in for it does.
LONG_QUESTION, LONGER_QUESTION = 28, 40


def _overlap_service(spark, sf, most: int, of_both: bool):
    """A reranker that scores by common terms, and fails for questions of more than ``most``."""

    def run(candidates: DataFrame) -> DataFrame:
        terms = lambda c: F.array_distinct(T.index_terms(F.col(c)))
        asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), terms("text").alias("q"))
        both = retrieval.looked_up(candidates, passages(spark, sf).select("chunk_pos", "text")).withColumn("t", terms("text")).drop("text").join(asked, "query_id")
        whole = F.size(F.array_union("q", "t")) if of_both else F.size("q")
        fails = F.size("q") > most
        return both.select("query_id", (F.col("rank") - 1).alias("index"), F.when(~fails, F.size(F.array_intersect("q", "t")) / whole).alias("score"), F.when(fails, F.format_string(f"more than {most} terms")).alias("error"))

    return run


@query(f"""with {SQL_LEX}, c as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pos) as rank from raw),
 t as (select c.*, list_distinct(regexp_extract_all(lower(b.text), {WORD})) as q, list_distinct(regexp_extract_all(lower(d.text), {WORD})) as t from c join benchmark b on item_id = query_id join documents d on doc_id = chunk_pos where rank <= 10),
 s as (select *, len(list_intersect(q, t)) as i, case when len(q) <= {LONG_QUESTION} then 'api' when len(q) <= {LONGER_QUESTION} then 'llm' else 'none' end as m from t),
 r as (select *, case m when 'api' then i / len(list_distinct(list_concat(q, t))) when 'llm' then i / len(q) end as rerank from s),
 p as (select *, row_number() over (partition by query_id order by rerank desc nulls last, rank) as place from r)
 select query_id, chunk_pos, round(rerank, 6) as rerank, place::int as place, m as rerank_mode,
  case m when 'llm' then '{dialogue.STOOD_IN}more than {LONG_QUESTION} terms' when 'none' then 'more than {LONG_QUESTION} terms | more than {LONGER_QUESTION} terms' end as degraded from p where place <= 5 or m = 'none'""")
def rerank_degraded(spark, sf):
    found = retrieval.bm25_first(passages(spark, sf), questions(spark, sf), 10)
    candidates = materialise(found.select("query_id", "chunk_pos", "rank"), "candidates")
    api, llm = _overlap_service(spark, sf, LONG_QUESTION, True), _overlap_service(spark, sf, LONGER_QUESTION, False)
    shown = dialogue.rerank_with_fallback(candidates, api, llm, 5)
    return shown.select("query_id", "chunk_pos", F.round("rerank", 6).alias("rerank"), "place", "rerank_mode", "degraded")


def _shorter(prompts: list[str]) -> list[str]:
    """A model of the tests' kind: of the question asked, the next three words that weren't asked yet."""
    import re

    out = []
    for p in prompts:
        asked, tried = p.rsplit("原始问题：", 1)[1].rsplit("\n已尝试的查询：", 1)
        at = 3 * (len(tried.split(" / ")) - 1)
        out.append(" ".join(re.findall("[A-Za-z]+", asked)[at : at + 3]))
    return out


#: Weight a term that a passage must reach for a question to count as found.
FOUND = 2.5


@query(f"""with w as (select item_id, text, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark where text is not null),
 a as (select item_id, 0 as i, text from w union all select item_id, i, array_to_string(w[3 * i - 2:3 * i], ' ') from w, range(1, 3) t(i)), v as (select item_id * 10 + i as query_id, item_id, i, text from a where text <> ''),
 {_sql_lex("v")}, n as (select query_id, count(distinct term) as terms from qt group by query_id),
 hit as (select item_id, i, v.text, chunk_pos from raw join n using (query_id) join v using (query_id) where round(score / terms, 6) >= {FOUND}),
 first as (select item_id, min(i) as i from hit group by item_id)
 select item_id as query_id, chunk_pos, i::int as iteration, md5(text) as query_md5 from hit join first using (item_id, i)""")
def retry_search(spark, sf):
    """Questions that no passage answers well enough are asked again in other words, twice at most."""
    docs = passages(spark, sf)

    def search(asked: DataFrame) -> DataFrame:
        terms = asked.select("query_id", F.size(F.array_distinct(F.slice(T.index_terms(F.col("text")), 1, retrieval.QUERY_TERMS))).alias("terms"))
        found = retrieval.bm25(docs, asked).join(terms, "query_id")
        return found.where(F.round(F.col("bm25") / F.col("terms"), 6) >= FOUND).select("query_id", "chunk_pos")

    def propose(left: DataFrame) -> DataFrame:
        prompts = left.select("query_id", dialogue.retry_prompt(F.get("tried", F.lit(0)), F.col("tried")).alias("prompt"))
        return dialogue.ask(prompts, _shorter).select("query_id", F.col("answer").alias("new_text"))

    asked = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), "text")
    return dialogue.with_retries(asked, search, propose, 2).select("query_id", "chunk_pos", "iteration", F.md5("query").alias("query_md5"))


@query(f"""with u as (select conv_id as query_id, coalesce(max_by(case when role = 'user' then text end, case when role = 'user' then turn end), '') as text from conversations group by conv_id), {_sql_lex("u")},
 c as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pos) as ref from raw),
 k as (select query_id, string_agg('[' || ref || '] 来源：' || source || chr(10) || d.text, chr(10) || chr(10) order by ref) as block from c join documents d on doc_id = chunk_pos where ref <= 3 group by query_id)
 select u.query_id as conv_id, md5('【参考资料】' || chr(10) || coalesce(block, '（无参考资料）') || chr(10) || chr(10) || '【用户问题】' || chr(10) || u.text) as content_md5 from u left join k using (query_id)""")
def prompt_with_context(spark, sf):
    """The last message of each conversation's prompt: the passages found for its question, then the question."""
    c = table(spark, sf, "conversations")
    asked = conversations.last_user(c).select(F.col("conv_id").alias("query_id"), F.col("question").alias("text"))
    found = retrieval.bm25_first_of_many(passages(spark, sf), asked, 3)
    refs = materialise(found.select("query_id", "chunk_pos", F.col("rank").alias("ref")), "refs")
    blocks = retrieval.context_block(refs, passages(spark, sf)).withColumnRenamed("query_id", "conv_id")
    made = conversations.prompt(c, blocks, "S")
    last = made.groupBy("conv_id").agg(F.max_by("content", "seq").alias("content"))
    return last.select("conv_id", F.md5("content").alias("content_md5"))


# -- vectors --------------------------------------------------------------------------------

SQL_ADJ = """a as (select vec_id, list_cosine_similarity(embedding::double[], lead(embedding::double[]) over (order by vec_id)) as sim from embeddings)"""


def _adjacent(spark, sf) -> DataFrame:
    following = statistics.with_next(table(spark, sf, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return following.select("vec_id", T.cosine(F.col("embedding"), F.col("next")).alias("sim"))


@query(f"with {SQL_ADJ} select vec_id, round(sim, 6) + 0.0 as sim from a where sim is not null")
def adjacent_cosine(spark, sf):
    return _adjacent(spark, sf).select("vec_id", (F.round("sim", 6) + F.lit(0.0)).alias("sim"))


@query(f"with {SQL_ADJ}, l as (select list_sort(list(sim)) as s from a where sim is not null) select round(s[1 + floor((len(s) - 1) * 0.85)::int], 6) as threshold from l")
def percentile_break(spark, sf):
    found = statistics.discrete_percentile(_adjacent(spark, sf), "sim", 85)
    return spark.createDataFrame([(found,)], "threshold double").select(F.round("threshold", 6).alias("threshold"))


SQL_FNV = "list_reduce(list_prepend(2166136261::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
SQL_COMPONENTS = f"""ws as (select {{key}} as id, w, count(*) as n from (select {{key}}, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]*')) as w from {{table}}) group by all),
 hs as (select id, n, {SQL_FNV.format('w')} as base, k, {SQL_FNV.format("(w || '#' || k)")} as h from ws, range(12) t(k)),
 cs as (select id, h % 1024 as idx, sum(n * (case when (h >> 8) & 1 = 1 then 1.0 else -1.0 end) * (1 + ((base >> (k % 16)::bigint) & 7) / 8.0::double)) as v from hs group by all),
 ns as (select id, sqrt(sum(v * v)) as norm from cs group by id)"""


@query(f"with {SQL_COMPONENTS.format(key='item_id', table='benchmark')} select id as item_id, idx::bigint as idx, round(v / norm, 6) as value from cs join ns using (id) where v <> 0")
def hash_embedding(spark, sf):
    return models.components(table(spark, sf, "benchmark"), "item_id")


SQL_UNITS_OF = f"""w as (select distinct w from (select unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]*')) as w from documents union all select unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]*')) from benchmark)),
 h as (select w, k, {SQL_FNV.format('w')} as base, {SQL_FNV.format("(w || '#' || k)")} as h from w, range(12) t(k)),
 e as (select w, h % 1024 as idx, (case when (h >> 8) & 1 = 1 then 1.0 else -1.0 end) * (1 + ((base >> k::bigint) & 7) / 8.0::double) as v from h),
 qs as (select id, idx, sum(v) as v from (select item_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]*')) as w from benchmark) join e using (w) group by all),
 ds as (select id, idx, sum(v) as v from (select doc_id as id, unnest(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\\-]*')) as w from documents) join e using (w) group by all),
 qn as (select id, idx, round(v / sqrt(sum(v * v) over (partition by id)), 6) as v from qs),
 dn as (select id, idx, round(v / sqrt(sum(v * v) over (partition by id)), 6) as v from ds)"""


@query(f"""with {SQL_LEX}, {SQL_UNITS_OF}, b30 as (select query_id, chunk_pos from (select b.item_id as query_id, d1.doc_id as chunk_pos,
  row_number() over (partition by b.item_id order by round(coalesce(x.bm25, 0.0), 9) desc, d1.doc_id) as r from benchmark b cross join documents d1 left join lex x on x.query_id = b.item_id and x.chunk_pos = d1.doc_id) where r <= 30),
 dots as (select query_id, chunk_pos, sum(q.v * c.v) as dot from b30 join qn q on q.id = query_id join dn c on c.id = chunk_pos and c.idx = q.idx group by all),
 sc as (select query_id, chunk_pos, round(greatest(0.0, least(0.99, (coalesce(dot, 0.0) + 0.2) * 0.95)), 4) as rerank from b30 left join dots using (query_id, chunk_pos)),
 pl as (select *, row_number() over (partition by query_id order by rerank desc, chunk_pos) as place from sc)
 select query_id, chunk_pos, rerank, place::int as place from pl where place <= 8""")
def hash_rerank(spark, sf):
    return models.rerank(_found(spark, sf, mode="bm25"), questions(spark, sf), passages(spark, sf), 8)


# -- chunking -------------------------------------------------------------------------------

SQL_UNITS = r"regexp_extract_all(text, '[A-Za-z]+|[0-9]+(?:\.[0-9]+)?|\s+|[^\s]')"
#: A unit's weight; blanks add up one by one, as doubles do.
SQL_UNIT = r"""case when regexp_matches(x, '^[A-Za-z0-9]') then 0.25::double * length(x) when regexp_matches(x, '^\s')
 then list_reduce(list_transform(string_split(x, ''), lambda c: case when c in (' ', chr(10), chr(9)) then 0.2::double else 0.25::double end), lambda a, b: a + b) else 0.25::double end"""


def _sql_fold(units: str, enough: float, least: str = "0") -> str:
    """(acc, n, hit): how many units reach ``enough`` together, more than ``least`` of them."""
    hit = f"{{0}} >= {float(enough)}::double and {{1}} > {least}"
    first = hit.format("x", "1")
    grown = hit.format("a.acc + b.acc", "a.n + 1")
    return f"""list_reduce(list_transform({units}, lambda x: {{{{'acc': x, 'n': 1::bigint, 'hit': {first}}}}}),
 lambda a, b: case when a.hit then a else {{{{'acc': a.acc + b.acc, 'n': a.n + 1, 'hit': {grown}}}}} end)""".replace("{{", "{").replace("}}", "}")


def _sql_slices(size: int, overlap: int) -> str:
    """CTEs up to chunks (doc_id, idx, text): windows over units, one step of the recursion a chunk."""
    reach = lambda st, least: _sql_fold(f"w[{st}:{st} + {5 * size + 1}]", size, least)
    back = f"list_reverse(w[greatest(st + 1, en - {5 * overlap + 1}):en])"
    keep = f"case when en = st then 1 else greatest(1, ({_sql_fold(back, overlap)}).n) end" if overlap else "0"
    go_on = "hit" if overlap else "hit and en < len(w)"
    return f"""recursive un as (select doc_id, {SQL_UNITS} as u from documents where regexp_matches(text, '[^[:space:]]')),
 ws as (select doc_id, list_transform(u, lambda x: {SQL_UNIT}) as w from un),
 hop(doc_id, st, en, hit) as (select doc_id, 1::bigint, r.n, r.hit from (select doc_id, {reach("1", "0")} as r from ws)
  union all select doc_id, nst, nst + r.n - 1, r.hit from (select doc_id, nst, {reach("nst", "en - nst + 1")} as r from (
   select hop.doc_id, en, w, en + 1 - {keep} as nst from hop join ws using (doc_id) where {go_on}))),
 cut as (select doc_id, st, en, {sql_trim("array_to_string(u[st:en], '')")} as text from hop join un using (doc_id)),
 chunks as (select doc_id, row_number() over (partition by doc_id order by st, en) - 1 as idx, text from cut where text <> '')"""


def _sql_greedy(parts: str, limit: int, glue: str) -> str:
    """CTEs up to blocks (doc_id, s): ``parts`` (of documents) joined while they stay within ``limit``."""
    joined = f"a.buf || {glue} || b.buf"
    return f"""parts as ({parts}), fold as (select doc_id, list_reduce(list_transform(s, lambda x: {{'buf': x, 'out': []::varchar[]}}),
  lambda a, b: case when {SQL_TOKENS.format(joined)} > {limit} then {{'buf': b.buf, 'out': list_append(a.out, {sql_trim("a.buf")})}} else {{'buf': {joined}, 'out': a.out}} end) as f from parts where len(s) > 0),
 blocks as (select doc_id, list_append(f.out, {sql_trim("f.buf")}) as s from fold)"""


def _sql_merged(least: int, glue: str) -> str:
    small = SQL_TOKENS.format("s[-1]")
    return f"merged as (select doc_id, case when len(s) > 1 and {small} < {least} then list_append(s[1:-3], s[-2] || {glue} || s[-1]) else s end as s from blocks)"


SQL_CHUNK_ROWS = f"select doc_id, idx::int as idx, {SQL_TOKENS.format('text')} as tokens, md5(text) as md5 from chunks"
SQL_EACH = "chunks as (select doc_id, unnest(range(len(s))) as idx, unnest(s) as text from {0})"
SQL_SENTENCES = rf"""select doc_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\r\n?', chr(10), 'g'),
 '[^。！？!?；;\n]+[。！？!?；;]?["''”’）)]*|\n+'), lambda x: {sql_trim('x')}), lambda x: x <> '') as s from documents"""
SQL_PARAGRAPHS = rf"""select doc_id, list_filter(list_transform(case when len(regexp_split_to_array(t, '\n\s*\n')) <= 1 then string_split(t, chr(10)) else regexp_split_to_array(t, '\n\s*\n') end,
 lambda x: {sql_trim('x')}), lambda x: x <> '') as s from (select doc_id, regexp_replace(text, '\r\n?', chr(10), 'g') as t from documents)"""
GAP = "chr(10) || chr(10)"
#: The paragraphs of a block are what lies between its blank lines; a block of one has its lines.
SQL_LAPPED = f"""blocks2 as (select doc_id, unnest(range(len(s))) as i, unnest(s) as text from merged),
 lapped as (select doc_id, i as idx, text, lag(text) over (partition by doc_id order by i) as before from blocks2),
 chunks as (select doc_id, idx, case when before is null then text else
  case when contains(before, {GAP}) then string_split(before, {GAP})[-1] else string_split(before, chr(10))[-1] end || {GAP} || text end as text from lapped)"""


def _chunks(cfg: chunking.ChunkConfig, spark, sf) -> DataFrame:
    c = chunking.chunk(table(spark, sf, "documents"), cfg)
    return c.select("doc_id", "idx", "tokens", F.md5("text").alias("md5"))


@query(f"with {_sql_slices(64, 0)} {SQL_CHUNK_ROWS}")
def fixed_chunks(spark, sf):
    return _chunks(chunking.ChunkConfig(size=64, overlap_enabled=False, markdown=False), spark, sf)


@query(f"with {_sql_slices(64, 10)} {SQL_CHUNK_ROWS}")
def fixed_chunks_overlap(spark, sf):
    return _chunks(chunking.ChunkConfig(size=64, overlap_mode="absolute", overlap_value=10, markdown=False), spark, sf)


@query()
def recursive_chunks(spark, sf):
    return _chunks(chunking.ChunkConfig("recursive", size=128), spark, sf)


#: A text's weight in twentieths of a token; tokens of it, where a half is decided by the text.
SQL_TWENTIETHS = r"(5 * length({0}) - length(regexp_replace({0}, '[^ \n\t]+', '', 'g')) + 15 * length(regexp_replace({0}, '[^\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{3040}}-\x{{30ff}}\x{{ac00}}-\x{{d7af}}\x{{f900}}-\x{{faff}}]+', '', 'g')))::bigint"


def _sql_recursive(size: int, overlap: int) -> str:
    """CTEs up to chunks: one level of splits a separator, a fold that joins parts, heads of the block before."""
    quoted = ["chr(10) || chr(10)", "chr(10)", *[f"'{x}'" for x in chunking.SEPARATORS[2:]]]
    levels = [f"""l{k + 1} as (select doc_id, flatten(list_transform(s, lambda x: case when ({SQL_TWENTIETHS.format('x')} + 10) // 20 > {size} or {SQL_TWENTIETHS.format('x')} % 20 = 10 and {SQL_TOKENS.format('x')} > {size}
  then list_filter(string_split(x, {sep}), lambda y: y <> '') else [x] end)) as s from l{k})""" for k, sep in enumerate(quoted)]
    glue = "(case when ends_with(a.buf, chr(10)) or starts_with(b.buf, chr(10)) then '' else chr(10) end)"
    q = f"(a.q + b.q + 4 * length({glue}))"
    fits = f"case when {q} % 20 <> 10 then ({q} + 10) // 20 else {SQL_TOKENS.format(f'(a.buf || {glue} || b.buf)')} end <= {size}"
    return f"""l0 as (select doc_id, [text] as s from documents where regexp_matches(text, '[^[:space:]]')), {", ".join(levels)},
 fold as (select doc_id, list_reduce(list_transform(s, lambda x: {{'buf': x, 'q': {SQL_TWENTIETHS.format('x')}, 'out': []::varchar[]}}),
  lambda a, b: case when {fits} then {{'buf': a.buf || {glue} || b.buf, 'q': {q}, 'out': a.out}} else {{'buf': b.buf, 'q': b.q, 'out': list_append(a.out, {sql_trim("a.buf")})}} end) as f from l9 where len(s) > 0),
 bl as (select doc_id, unnest(range(len(s))) as i, unnest(s) as text from (select doc_id, case when {sql_trim("f.buf")} = '' then f.out else list_append(f.out, {sql_trim("f.buf")}) end as s from fold)),
 bu as (select doc_id, i, text, {SQL_UNITS} as u from bl), bw as (select *, list_reverse(list_transform(u[greatest(1, len(u) - {5 * overlap}):], lambda x: {SQL_UNIT})) as w from bu),
 bh as (select doc_id, i, text, {sql_trim(f"array_to_string(u[len(u) - ({_sql_fold('w', overlap)}).n + 1:], '')")} as head from bw),
 bp as (select doc_id, i, text, lag(head) over (partition by doc_id order by i) as before from bh),
 chunks as (select * from (select doc_id, i as idx, case when i > 0 and coalesce(before, '') <> '' then {sql_trim("before || chr(10) || text")} else text end as text from bp) where text <> '')"""


@query(f"with {_sql_recursive(128, 19)} {SQL_CHUNK_ROWS}")
def recursive_overlap(spark, sf):
    return _chunks(chunking.ChunkConfig("recursive", size=128, markdown=False), spark, sf)


@query(f"with {_sql_greedy(SQL_PARAGRAPHS, 200, GAP)}, {_sql_merged(60, GAP)}, {SQL_LAPPED} {SQL_CHUNK_ROWS}")
def paragraph_chunks(spark, sf):
    return _chunks(chunking.ChunkConfig("paragraph", paragraph_max=200), spark, sf)


@query(f"with {_sql_greedy(SQL_SENTENCES, 200, chr(39) * 2)}, {_sql_merged(80, chr(39) * 2)}, {SQL_EACH.format('merged')} {SQL_CHUNK_ROWS}")
def semantic_fallback(spark, sf):
    return _chunks(chunking.ChunkConfig("semantic", semantic_max=200), spark, sf)


SQL_WORDS_OF = r"regexp_extract_all(lower(text), '[a-z0-9][a-z0-9_\-]*')"
#: Vectors of sentences in millionths, so that sums are exact; then sentences grouped from the left and small groups merged.
SQL_SEMANTIC = f"""sen as ({SQL_SENTENCES} where text is not null), si as (select doc_id, unnest(range(len(s))) as i, unnest(s) as text from sen),
 sw as (select doc_id, i, w, count(*) as n from (select doc_id, i, unnest({SQL_WORDS_OF}) as w from si) group by all),
 hw as (select w, k, {SQL_FNV.format('w')} as base, {SQL_FNV.format("(w || '#' || k)")} as h from (select distinct w from sw), range(12) t(k)),
 we as (select w, h % 1024 as idx, sum((case when (h >> 8) & 1 = 1 then 1 else -1 end) * (8 + ((base >> k::bigint) & 7))) as v from hw group by all),
 sv as (select doc_id, i, idx, sum(n * v)::bigint as v from sw join we using (w) group by all having sum(n * v) <> 0),
 sn as (select *, (round(v / 8.0::double / sqrt(sum(v * v) over (partition by doc_id, i)::double / 64) * 1e6))::bigint as m from sv),
 sq as (select doc_id, i, sum(m * m)::double as q from sn group by all),
 sd as (select a.doc_id, b.i, sum(a.m * b.m)::double as dot from sn a join sn b on a.doc_id = b.doc_id and b.i = a.i + 1 and a.idx = b.idx group by all),
 sc as (select si.doc_id, si.i, si.text, {SQL_TOKENS.format('si.text')} as n, case when si.i > 0 then coalesce(dot / (sqrt(p.q) * sqrt(o.q)), 0.0) end as sim
  from si left join sd using (doc_id, i) left join sq o on o.doc_id = si.doc_id and o.i = si.i left join sq p on p.doc_id = si.doc_id and p.i = si.i - 1),
 st as (select doc_id, @limit@ as limit_, list({{'buf': text, 'tot': n, 'sim': sim}} order by i) as l from sc group by doc_id),
 gf as (select doc_id, list_reduce(list_transform(l, lambda x: {{'buf': x.buf, 'tot': x.tot, 'sim': x.sim, 'lim': limit_, 'out': []::varchar[]}}),
  lambda a, b: case when b.sim < b.lim or a.tot + b.tot > 400 then {{'buf': b.buf, 'tot': b.tot, 'sim': b.sim, 'lim': b.lim, 'out': list_append(a.out, a.buf)}}
   else {{'buf': a.buf || b.buf, 'tot': a.tot + b.tot, 'sim': b.sim, 'lim': b.lim, 'out': a.out}} end) as f from st),
 gm as (select doc_id, list_reduce(list_transform(list_append(f.out, f.buf), lambda x: {{'g': [x], 'n': {SQL_TOKENS.format('x')}}}),
  lambda a, b: case when least(a.n, b.n) < 80 and a.n + b.n <= 400 then {{'g': list_append(a.g[1:-2], a.g[-1] || b.g[1]), 'n': {SQL_TOKENS.format('(a.g[-1] || b.g[1])')}}}
   else {{'g': list_append(a.g, b.g[1]), 'n': b.n}} end) as f from gf),
 chunks as (select doc_id, unnest(range(len(f.g))) as idx, {sql_trim("unnest(f.g)")} as text from gm)"""


@query(f"with {SQL_SEMANTIC.replace('@limit@', '0.3::double')} {SQL_CHUNK_ROWS}")
def semantic_chunks(spark, sf):
    return _chunks(chunking.ChunkConfig("semantic", semantic_max=400, threshold=0.3, overlap_enabled=False, markdown=False, offline_vectors=True), spark, sf)


@query(f"with {SQL_SEMANTIC.replace('@limit@', '(list_sort(list(sim) filter (where sim is not null)))[1 + floor((count(sim) - 1) * 0.35)::int]')} {SQL_CHUNK_ROWS}")
def semantic_percentile(spark, sf):
    cfg = chunking.ChunkConfig("semantic", semantic_max=400, threshold_mode="percentile", percentile=35, overlap_enabled=False, markdown=False, offline_vectors=True)
    return _chunks(cfg, spark, sf)


@query(f"""with {_sql_slices(512, 77)}, t as (select doc_id, {SQL_TOKENS.format('text')} as n from chunks)
 select doc_id, 'fixed' as strategy, count(*)::bigint as n_chunks, floor(sum(n) / count(*) + 0.5)::bigint as avg_tokens, min(n)::bigint as min_tokens, max(n)::bigint as max_tokens, 77.0::double as overlap_tokens from t group by doc_id""")
def chunk_meta(spark, sf):
    made = chunking.chunk_meta(table(spark, sf, "documents"), chunking.ChunkConfig(markdown=False))
    return made.drop("degraded", "threshold")


SQL_SPANS = f"""{_sql_slices(64, 10)}, raw as (select doc_id, st, array_to_string(u[st:en], '') as r, coalesce(list_sum(list_transform(u[1:st - 1], lambda x: length(x))), 0) as off from hop join un using (doc_id)),
 spans as (select doc_id, row_number() over (partition by doc_id order by st, off + length(r)) - 1 as idx, off + length(r) - length(regexp_replace(r, '^{TRIM}', '')) as a, off + length(regexp_replace(r, '{TRIM}$', '')) as b
  from raw where {sql_trim('r')} <> '')"""


@query(f'with {SQL_SPANS} select doc_id, idx::int as idx, a::bigint as begin, b::bigint as "end" from spans')
def chunk_spans(spark, sf):
    return chunking.chunk_spans(table(spark, sf, "documents"), chunking.ChunkConfig(size=64, overlap_mode="absolute", overlap_value=10, markdown=False))


@query(f"""with {SQL_SPANS}, l as (select *, coalesce(lag(b) over (partition by doc_id order by idx), 0) as before from spans)
 select doc_id, count(*)::bigint as n_chunks, sum(b - greatest(a, before))::bigint as covered, sum(greatest(before - a, 0))::bigint as shared, 16::int as planned from l group by doc_id""")
def chunk_coverage(spark, sf):
    return chunking.coverage(table(spark, sf, "documents"), chunking.ChunkConfig(size=64, overlap_mode="absolute", overlap_value=10, markdown=False))


@query(f"with {_sql_slices(64, 0)} {SQL_CHUNK_ROWS} where idx < 3")
def chunk_preview(spark, sf):
    cfg = chunking.ChunkConfig(size=64, overlap_enabled=False, markdown=False)
    return knowledge_base.preview(table(spark, sf, "documents"), cfg, 3).select("doc_id", "idx", "tokens", F.md5("text").alias("md5"))


# -- answers and their passages -------------------------------------------------------------

SQL_GIVEN = f"""{SQL_LEX}, p as (select query_id, chunk_pos, row_number() over (partition by query_id order by round(score, 9) desc, chunk_pos)::int as ref from raw),
 g as (select p.query_id, ref, list_distinct(regexp_extract_all(lower(text), {WORD})) as held from p join documents on doc_id = chunk_pos where ref <= 3)"""


def _given(spark, sf) -> DataFrame:
    """The first three passages of each question."""
    docs = passages(spark, sf)
    found = retrieval.bm25_first(docs, questions(spark, sf), 3).select("query_id", "chunk_pos", F.col("rank").alias("ref"))
    given = retrieval.looked_up(found, docs.select("chunk_pos", "text")).select("query_id", "ref", "text")
    return materialise(given, "given")


@query(f"""with {SQL_GIVEN}, sen as ({SQL_SENTENCES}), a as (select item_id as query_id, list_distinct(regexp_extract_all(lower(b.text), {WORD})) as q, list_distinct(regexp_extract_all(lower(coalesce(d.text, '')), {WORD})) as a, sen.s
  from benchmark b join documents d on d.doc_id = item_id join sen on sen.doc_id = item_id),
 t as (select query_id, unnest(range(len(s))) as i, unnest(list_transform(s, lambda x: list_distinct(regexp_extract_all(lower(x), {WORD})))) as terms from a),
 u as (select t.query_id, i, max(coalesce(len(list_intersect(terms, held)), 0) / len(terms)) as support from t left join g using (query_id) where len(terms) > 0 group by t.query_id, i),
 m as (select query_id, count(*) as n, sum((support >= 0.5)::int) as good, avg(support) as mean from u group by query_id)
 select query_id, coalesce(n, 0)::bigint as n_sentences, coalesce(good, 0)::bigint as n_supported, round(coalesce(mean, 0), 6) as faithfulness,
  round(case when len(q) > 0 then len(list_intersect(q, a)) / len(q) else 0 end, 6) as relevancy from a left join m using (query_id)""")
def eval_sentences(spark, sf):
    """The document of a question's number is its answer."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query_id"), F.col("text").alias("answer"))
    answers = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).join(d, "query_id")
    found = evaluation.by_sentence(answers, _given(spark, sf))
    return found.select("query_id", "n_sentences", "n_supported", F.round("faithfulness", 6).alias("faithfulness"), F.round("relevancy", 6).alias("relevancy"))


@query(f"""with {SQL_GIVEN}, sen as ({SQL_SENTENCES.replace("doc_id", "item_id").replace("from documents", "from benchmark")}),
 n as (select item_id as query_id, list_transform(range(len(s)), lambda i: ((i * i) % 7)::int) as n, array_to_string(list_transform(range(len(s)), lambda i: s[i + 1] || ' <' || ((i * i) % 7) || '> [' || ((i * i) % 7) || ']'), ' & ') as answer from sen),
 r as (select query_id, list(ref) as refs from g group by query_id)
 select n.query_id, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: list_contains(coalesce(refs, []), x)))), ',') as cited, array_to_string(list_sort(list_distinct(list_filter(n, lambda x: not list_contains(coalesce(refs, []), x)))), ',') as dangling,
  len(n)::bigint as n_citations, len(list_filter(coalesce(refs, []), lambda x: not list_contains(n, x)))::bigint as n_unused,
  md5(regexp_replace(replace(replace(replace(answer, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\\[([0-9]+)\\]', '<span class="ref">[\\1]</span>', 'g')) as shown_md5 from n left join r using (query_id)""".replace("\\\\", "\\"))
def citation_report(spark, sf):
    """Answers that cite a passage after each sentence of the question; some of the numbers are no passage's."""
    number = lambda i: (i * i % 7).cast("string")
    said = F.transform(T.sentences(F.col("text")), lambda s, i: F.concat(s, F.lit(" <"), number(i), F.lit("> ["), number(i), F.lit("]")))
    answers = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), F.array_join(said, " & ").alias("answer"))
    found = evaluation.citations(answers, _given(spark, sf))
    listed = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",").alias(c)
    return found.select("query_id", listed("cited"), listed("dangling"), "n_citations", "n_unused", F.md5("shown").alias("shown_md5"))


# -- conversations --------------------------------------------------------------------------


@query("select conv_id, coalesce(max_by(case when role = 'user' then text end, case when role = 'user' then turn end), '') as question from conversations group by conv_id")
def last_user(spark, sf):
    return conversations.last_user(table(spark, sf, "conversations"))


SQL_BACK = "select *, row_number() over (partition by conv_id order by turn desc, role, text) as back from conversations"


@query(f"select conv_id, turn, role, text, back::int as back from ({SQL_BACK}) where back between 2 and 7")
def history_frame(spark, sf):
    return conversations.history(table(spark, sf, "conversations"))


@query(f"select conv_id, turn, role, text, back::int as back from ({SQL_BACK}) where back <= 8")
def recent_messages(spark, sf):
    return conversations.recent(table(spark, sf, "conversations"))


@query(f"""with b as ({SQL_BACK}), u as (select conv_id, coalesce(max_by(case when role = 'user' then text end, case when role = 'user' then turn end), '') as question from conversations group by conv_id)
 select conv_id, 0 as seq, 'system' as role, md5('S') as content_md5 from u union all select conv_id, (9 - back)::int, role, md5(text) from b where back <= 8
 union all select conv_id, 9, 'user', md5('【参考资料】' || chr(10) || '（无参考资料）' || chr(10) || chr(10) || '【用户问题】' || chr(10) || question) from u""")
def prompt(spark, sf):
    c = table(spark, sf, "conversations")
    made = conversations.prompt(c, spark.createDataFrame([], "conv_id long, block string"), "S")
    return made.select("conv_id", "seq", "role", F.md5("content").alias("content_md5"))


# -- knowledge base -------------------------------------------------------------------------

SQL_KB = "kb as (select d.doc_id as chunk_pos, d.doc_id as chunk_id, d.doc_id % 50 as doc_id, d.text, length(d.text)::bigint as tokens, e.embedding as vector from documents d left join embeddings e on e.vec_id = d.doc_id)"


#: Documents of the knowledge base; a chunk's is its position modulo 50, so the last ones have none.
SQL_KB_DOCS = "(select distinct doc_id % 60 as i from documents) r"


def _kb_docs(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.pmod("doc_id", F.lit(60)).alias("doc_id")).distinct()


@query(f"with {SQL_KB} select (select count(*) from {SQL_KB_DOCS})::bigint as docs, count(*)::bigint as chunks, count(vector)::bigint as indexed, (count(*) - count(vector))::bigint as pending, coalesce(min_by(len(vector), case when vector is not null then chunk_pos end), 0)::bigint as dim, sum(tokens)::bigint as tokens from kb")
def kb_stats(spark, sf):
    return knowledge_base.stats(_kb_docs(spark, sf), kb_chunks(spark, sf))


@query(f"with {SQL_KB} select r.i as doc_id, count(kb.doc_id)::bigint as n_chunks from {SQL_KB_DOCS} left join kb on kb.doc_id = r.i group by r.i")
def docs_chunk_count(spark, sf):
    return knowledge_base.chunk_counts(_kb_docs(spark, sf), kb_chunks(spark, sf))


@query(f"with {SQL_KB} select chunk_id, doc_id, vector is not null as has_vector from kb where contains(lower(text), 'the') order by chunk_pos limit 20 offset 5")
def chunk_browse(spark, sf):
    return knowledge_base.browse(kb_chunks(spark, sf), "THE", offset=5, limit=20).select("chunk_id", "doc_id", "has_vector")


@query(f"with {SQL_KB} select chunk_id, tokens from kb where vector is null")
def pending(spark, sf):
    return knowledge_base.pending(kb_chunks(spark, sf)).select("chunk_id", "tokens")


@query(f"with {SQL_KB} select chunk_id, case when chunk_id % 7 = 0 then {SQL_TOKENS.format("(text || ' (new)')")} else tokens end as tokens, vector is not null and chunk_id % 7 <> 0 as has_vector from kb")
def update_chunk(spark, sf):
    kb = kb_chunks(spark, sf)
    new = knowledge_base.update_chunks(kb, kb.where("chunk_id % 7 = 0").select("chunk_id", F.concat("text", F.lit(" (new)")).alias("new_text")))
    return new.select("chunk_id", "tokens", F.col("vector").isNotNull().alias("has_vector"))


@query(f"with {SQL_KB} select chunk_id, chunk_pos from kb where doc_id <> 3 union all select -chunk_id, chunk_pos + (select max(chunk_pos) from kb where doc_id <> 3) + 1 from kb where doc_id = 3")
def replace_chunks(spark, sf):
    kb = kb_chunks(spark, sf)
    return knowledge_base.replace_chunks(kb, kb.where("doc_id = 3").withColumn("chunk_id", -F.col("chunk_id"))).select("chunk_id", "chunk_pos")


@query(f"with {SQL_KB} select doc_id, count(*)::bigint as n from kb where doc_id not in (1, 2) group by doc_id")
def delete_doc(spark, sf):
    _, chunks = knowledge_base.delete_documents(_kb_docs(spark, sf), kb_chunks(spark, sf), spark.createDataFrame([(1,), (2,)], "doc_id long"))
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n"))


@query(f"""with {SQL_KB}, s as (select doc_id, bool_and(vector is not null or chunk_id % 2 = 0) as ready from kb group by doc_id)
 select r.i as doc_id, case when s.ready is null then 'parsed' when s.ready then 'indexed' else 'chunked' end as status from {SQL_KB_DOCS} left join s on s.doc_id = r.i""")
def set_vectors(spark, sf):
    kb = kb_chunks(spark, sf)
    zero = F.array(F.lit(0.0).cast("float"))
    filled = knowledge_base.set_vectors(kb, kb.where("chunk_id % 2 = 0").select("chunk_id", F.coalesce("vector", zero).alias("new_vector")))
    return knowledge_base.status(_kb_docs(spark, sf), filled, "all")


@query(f"with {SQL_KB} select chunk_id, doc_id from kb where chunk_id % 5 <> 0")
def delete_chunk(spark, sf):
    kb = kb_chunks(spark, sf)
    return knowledge_base.delete_chunks(kb, kb.where("chunk_id % 5 = 0").select("chunk_id")).select("chunk_id", "doc_id")


@query(f"with {SQL_KB} select chunk_id, coalesce(len(vector), 64)::bigint as dim from kb")
def index_pending(spark, sf):
    return knowledge_base.index_pending(kb_chunks(spark, sf), 64).select("chunk_id", F.size("vector").cast("long").alias("dim"))


@query(f"with {SQL_KB} select count(*)::bigint as total from kb where contains(lower(text), 'the')")
def browse_total(spark, sf):
    return knowledge_base.browse_total(kb_chunks(spark, sf), "THE")


@query(f"with {SQL_KB} select floor(avg(tokens) + 0.5)::bigint as avg_tokens from (select tokens from kb where contains(lower(text), 'the') order by chunk_pos limit 20 offset 5)")
def page_average(spark, sf):
    return knowledge_base.page_average(knowledge_base.browse(kb_chunks(spark, sf), "THE", offset=5, limit=20))


def _named_chunks(spark, sf) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_pos")) - 1
    return kb_chunks(spark, sf).withColumn("idx", place).withColumn("doc_name", F.lit("d"))


@query(f"""with {SQL_KB}, n as (select doc_id, count(*) as n from kb group by doc_id),
 t as (select -item_id - 1 as chunk_id, item_id % 70 as doc_id, text from benchmark),
 p as (select *, row_number() over (partition by doc_id order by chunk_id) - 1 as p from t)
 select chunk_id, p.doc_id, (coalesce(n, 0) + p)::int as idx, case when p.doc_id < 60 then 'd' else '手动新增' end as doc_name, {SQL_TOKENS.format('text')} as tokens from p left join n using (doc_id)""")
def add_chunk(spark, sf):
    texts = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("chunk_id"), F.pmod("item_id", F.lit(70)).alias("doc_id"), "text")
    made = knowledge_base.add_chunks(_named_chunks(spark, sf), texts, _kb_docs(spark, sf).withColumn("doc_name", F.lit("d")))
    return made.where("chunk_id < 0 and vector is null").select("chunk_id", "doc_id", "idx", "doc_name", "tokens")


@query(f"select i as doc_id, 'parsed' as status, 0::bigint as tokens from {SQL_KB_DOCS} union all select -item_id - 1, 'parsed', 0 from benchmark")
def add_document(spark, sf):
    docs = knowledge_base.add_documents(_kb_docs(spark, sf).limit(0).select("doc_id", F.lit("x").alias("doc_name"), F.lit("parsed").alias("status"), F.lit(0).cast("long").alias("tokens")), _kb_docs(spark, sf).withColumn("doc_name", F.lit("a")))
    new = table(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("doc_id"), F.lit("b").alias("doc_name"))
    return knowledge_base.add_documents(docs, new).select("doc_id", "status", "tokens")


@query("select 0::bigint as docs, 0::bigint as chunks, 0::bigint as indexed, 0::bigint as pending, 0::bigint as dim, 0::bigint as tokens")
def cleared(spark, sf):
    return knowledge_base.stats(*knowledge_base.clear(_kb_docs(spark, sf), kb_chunks(spark, sf)))


# -- sources --------------------------------------------------------------------------------


@query("select doc_id, substring(coalesce(text, ''), 1, 20000) as text, length(coalesce(text, ''))::bigint as total from documents")
def document_text(spark, sf):
    return files.read_text(table(spark, sf, "documents"))


@query("select doc_id, substring(coalesce(text, ''), 1, 500) as preview from documents")
def document_preview(spark, sf):
    return files.preview(table(spark, sf, "documents")).select("doc_id", "preview")


@query()
def json_pretty(spark, sf):
    return table(spark, sf, "events").select("event_id", files.pretty_json(F.col("props")).alias("text"))


# -- dialogue -------------------------------------------------------------------------------

SQL_ANSWERS = "answers as (select item_id as query_id, '" + dialogue.ANSWER_HEAD + "' || substring(string_split(coalesce(text, ''), chr(10))[-1], 1, 60) || '" + dialogue.ANSWER_TAIL + "' as answer from benchmark)"


def _answers(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), dialogue.offline_answer(F.col("text")).alias("answer"))


@query(f"with {SQL_ANSWERS} select query_id, answer from answers")
def offline_answer(spark, sf):
    return _answers(spark, sf)


@query(f"""with {SQL_ANSWERS}, n as (select *, (length(answer) + 11) // 12 as pieces from answers)
 select query_id as run_id, i::int as seq, case when i < pieces then 'delta' else 'done' end as type, case when i < pieces then substring(answer, (12 * i + 1)::bigint, 12) else '' end as payload
 from (select *, unnest(range(pieces + 1)) as i from n)""")
def answer_events(spark, sf):
    return dialogue.answer_events(_answers(spark, sf))


@query("select item_id as run_id, ceil(length(text) / 12.0)::bigint as n_events, md5(text) as answer_md5 from benchmark where text <> ''")
def delta_events(spark, sf):
    """Questions as streamed answers, cut into pieces of some bytes that arrive as three files."""
    base = scratch(spark, "deltas")
    said = F.transform(F.regexp_extract_all("text", F.lit("[\\s\\S]{1,12}"), F.lit(0)), lambda p: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(p.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n: ping\n")))
    raw = F.concat(F.array_join(said, ""), F.lit("data: [DONE]\n")).cast("binary")
    runs_ = table(spark, sf, "benchmark").where("text <> ''").select(F.col("item_id").alias("run_id"), raw.alias("raw"))
    cut = runs_.select("run_id", "raw", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / 61).cast("int") - 1)).alias("seq"))
    pieces = cut.select("run_id", F.col("seq").cast("long").alias("seq"), F.substring("raw", F.col("seq") * 61 + 1, F.lit(61)).alias("piece"))
    pieces.repartition(3, F.pmod("seq", F.lit(3))).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    deltas.parse(stream).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema("run_id long, seq long, delta string").parquet(f"{base}/out").groupBy("run_id").agg(F.count("*").alias("n_events"), F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("l"))
    return found.select("run_id", "n_events", F.md5(F.array_join(F.transform("l", lambda x: x["delta"]), "")).alias("answer_md5"))


@query("select item_id as query_id, 0 as variant, text, 'none' as mode from benchmark")
def rewrite_none(spark, sf):
    return dialogue.rewrite(questions(spark, sf))


@query(f"select item_id as query_id, item_id % 2 = 1 as refused, case when item_id % 2 = 1 then '{dialogue.REFUSAL}' end as answer from benchmark")
def refusals(spark, sf):
    q = questions(spark, sf)
    return dialogue.no_answer(q, q.where("query_id % 2 = 0"))


@query("""with t as (select conv_id as query_id, turn as ref, length(coalesce(text, ''))::bigint as tokens from conversations)
 select * from (select query_id, ref, tokens, (sum(tokens) over (partition by query_id order by ref rows unbounded preceding))::bigint as used from t) where used <= 400""")
def context_budget(spark, sf):
    c = table(spark, sf, "conversations")
    return dialogue.within_budget(c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("ref"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("tokens")), 400)


def _first_words(prompts: list[str]) -> list[str]:
    """A model of the tests' kind: words 1 to 5 and 6 to 10 of the question as two queries."""
    import json
    import re

    found = [re.findall("[A-Za-z]+", p.rsplit(dialogue.ASKED, 1)[-1]) for p in prompts]
    return [json.dumps({"queries": [" ".join(w[:5]), " ".join(w[5:10])]}) for w in found]


@query("""with w as (select item_id as query_id, regexp_extract_all(text, '[A-Za-z]+') as w from benchmark where text is not null)
 select query_id, v::int as variant, array_to_string(w[5 * v + 1:5 * v + 5], ' ') as text, 'multi' as mode from w, range(2) t(v)""")
def rewrite_variants(spark, sf):
    asked = table(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("query_id"), "text")
    return dialogue.rewrite(asked, _first_words, "multi")


@query("""with n as (select item_id as query_id, len(regexp_extract_all(text, '[A-Za-z]+')) as n from benchmark where len(regexp_extract_all(text, '[A-Za-z]+')) > 1)
 select query_id, (n - n % 2)::bigint as chunk_pos, (n % 2)::int as iteration from n join documents on doc_id = n - n % 2""")
def retry_rounds(spark, sf):
    # a question of an even number of words finds the document of that number; another is asked again without its last word
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_pos"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").where(F.size(words) > 1)
    search = lambda q: q.select("query_id", F.size(words).cast("long").alias("chunk_pos")).where("chunk_pos % 2 = 0").join(docs, "chunk_pos")
    propose = lambda q: q.select("query_id", F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("new_text"))
    return dialogue.with_retries(asked, search, propose, 1).select("query_id", "chunk_pos", "iteration")


@query("""select item_id as query_id, i::int as index, round((item_id % 7 + i) / 100.0::double, 6) as score from benchmark, range(3) t(i)""")
def rerank_responses(spark, sf):
    # services answer in four shapes and name their scores in four ways
    item = lambda name: F.array(*[F.struct(F.lit(i).alias("index"), ((F.col("item_id") % 7 + i) / 100).alias(name)) for i in range(3)])
    shapes = [
        F.to_json(F.struct(item("relevance_score").alias("results"))), F.to_json(F.struct(F.struct(item("score").alias("results")).alias("output"))),
        F.to_json(F.struct(item("relevance").alias("data"))), F.to_json(F.struct(item("similarity").alias("documents"))),
    ]
    shape = F.element_at(F.array(*shapes), (F.col("item_id") % 4 + 1).cast("int"))
    found = dialogue.response_items(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "item_id", shape.alias("answer")))
    return found.select("query_id", "index", F.round("score", 6).alias("score"))


#: Documents of one source and language, one after the other, are the text of one file.
SQL_FILES = f"""files as (select part as doc_id, {_sql_chain("string_agg(text || chr(10), '' order by doc_id)", CLEAN_STEPS)} as text
 from (select coalesce(source, 'none') || '-' || coalesce(lang, 'none') as part, doc_id, text from documents where text is not null @some@) group by part)"""


def _sql_file_chunks(some: str = "") -> str:
    slices = _sql_slices(512, 77).replace("from documents", "from files")
    return f"""with {slices.replace("recursive un as", "recursive " + SQL_FILES.replace('@some@', some) + ", un as")}, t as (select doc_id, {SQL_TOKENS.format('text')} as n from chunks)
 select doc_id as part, count(*)::bigint as n_chunks, sum(n)::bigint as tokens, 64::bigint as dim from t group by doc_id"""


#: All files of the two queries below are indexed: the SQL knows no limit. No limit at all, where large files are read in pieces; bytes that one row can hold.
NO_LIMIT, ANY_SIZE = (1 << 63) - 1, (1 << 31) - 1


def _write_files(docs: DataFrame, path: str, mode: str) -> None:
    part = F.concat(F.coalesce("source", F.lit("none")), F.lit("-"), F.coalesce("lang", F.lit("none"))).alias("part")
    listed = docs.where("text is not null").select("doc_id", "text", part).repartition("part").sortWithinPartitions("part", "doc_id")
    listed.select("part", "text").write.mode(mode).partitionBy("part").option("lineSep", "\n").text(path)


def _by_file(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    part = F.regexp_extract("path", "part=([^/]*)", 1).alias("part")
    made = chunks.join(paths.select("doc_id", part), "doc_id")
    return made.groupBy("part").agg(F.count("*").alias("n_chunks"), F.sum("tokens").alias("tokens"), F.min(F.size("vector")).cast("long").alias("dim"))


@query(_sql_file_chunks())
def incremental_index(spark, sf):
    """Documents written as files and indexed by the streaming job."""
    base = scratch(spark, "incremental")
    _write_files(table(spark, sf, "documents"), f"{base}/in", "overwrite")
    indexing.index_folder(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", chunking.ChunkConfig(markdown=False), 64, max_bytes=NO_LIMIT).awaitTermination()
    return _by_file(spark.read.parquet(f"{base}/out"), files.ingest(spark, f"{base}/in", NO_LIMIT).select("doc_id", F.col("file_path").alias("path")))


@query(_sql_file_chunks("and lang is distinct from 'en'"))
def folder_sync(spark, sf):
    """A folder that is indexed, of which files are then replaced by others and deleted: what is left is the last state."""
    base, docs, cfg = scratch(spark, "folder"), table(spark, sf, "documents"), chunking.ChunkConfig(markdown=False)
    _write_files(docs.withColumn("text", F.substring("text", 1, 200)), f"{base}/in", "overwrite")
    indexing.sync_folder(spark, f"{base}/in", f"{base}/out", cfg, 64, max_bytes=ANY_SIZE)
    _write_files(docs.where("lang is distinct from 'en'"), f"{base}/in", "overwrite")
    indexing.sync_folder(spark, f"{base}/in", f"{base}/out", cfg, 64, max_bytes=ANY_SIZE)
    return _by_file(indexing.indexed_chunks(spark, f"{base}/out"), indexing.manifest(spark, f"{base}/out"))
