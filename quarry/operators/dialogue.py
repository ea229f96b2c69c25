"""Rewriting, reranking with fallback, retrying, refusing and answering, for a table of questions at a time.

A model is a function from a list of prompts to as many answers; it runs in tasks, a
batch at a time. What a model gave is written once, as asking again might differ.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import trim
from quarry.operators import conversations
from quarry.storage import materialise

Model = Callable[[list[str]], list[str]]

#: The texts of a refusal and of the offline answer, around the question's last line.
REFUSAL = "抱歉，依据当前知识库无法回答该问题（未检索到置信度足够的资料）。"
ANSWER_HEAD = "【Mock 模型回答】我已阅读你提供的参考资料。\n\n针对「"
ANSWER_TAIL = (
    "」，依据检索到的资料片段，结论如下 [1]：\n\n"
    "- 资料中包含与问题相关的段落，可作为回答依据 [1]；\n"
    "- 如需更精确的答案，建议缩小问题范围或补充文档。\n\n"
    "（当前由本地 Mock 模型生成，未调用真实大模型。）"
)
#: What a model is asked for, around the question.
REWRITE_SYSTEM = "你是查询优化专家。只输出查询语句本身，不要回答用户的问题。"
RETRY_SYSTEM = "你是检索优化助手，只输出一条新的检索查询。"
ASKED = "用户问题："
MULTI = (
    "你是检索查询生成专家。基于对话历史和用户最新问题，生成 {n} 个不同角度的检索查询，用于召回互补资料。\n"
    '只输出 JSON：{"queries":["q1","q2"]}，不要解释。'
)
HYDE = (
    "请针对下面的问题，写一段\"假设性答案\"（100~200字），用于向量检索。\n"
    "要求：像资料中的原话一样表述，包含可能的专业术语；不要说\"根据资料\"，直接写内容。\n\n问题：{q}"
)
RETRY = (
    "上一轮检索没有找到能回答该问题的资料。请换一种表述方式，生成一个更利于检索的新查询（可拆分为更具体的子问题或替换同义词）。\n"
    "只输出一个新查询文本，不要解释。\n\n原始问题：{q}\n已尝试的查询：{tried}"
)
SCORE_SYSTEM = (
    "你是检索相关性评审专家。给定用户查询与若干候选片段，请为每个片段打出 0~100 的相关性分数。"
    '只输出 JSON：{"scores":[{"index":0,"score":87}]}，不要任何解释。'
)
#: Where services put their list of scores, and what they call a score.
LISTS = ["$.results", "$.output.results", "$.data", "$.documents"]
SCORES = ["relevance_score", "score", "relevance", "similarity"]
PIECE = 12
EXCERPT = 60


def ask(prompts: DataFrame, model: Model, batch: int = 16) -> DataFrame:
    """query_id, answer, error of every row of ``prompts`` (query_id, prompt); a batch that fails has no answers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                some = frame.iloc[lo : lo + batch]
                try:
                    answers, error = list(model(some["prompt"].tolist())), None
                    if len(answers) != len(some):
                        raise ValueError(f"{len(answers)} answers to {len(some)} prompts")
                except Exception as e:  # a provider may raise anything; the row says what
                    answers, error = [None] * len(some), str(e) or type(e).__name__
                yield pd.DataFrame({"query_id": some["query_id"].to_numpy(), "answer": answers, "error": [error] * len(some)})

    return materialise(prompts.select("query_id", "prompt").mapInPandas(run, "query_id long, answer string, error string"), "answers")


def unquoted(c: Column) -> Column:
    return F.regexp_replace(trim(c), "^[\"'`]|[\"'`]$", "")


def histories(messages: DataFrame, turns: int = 3) -> DataFrame:
    """conv_id, history: the messages before the last one as lines of role and text, oldest first."""
    before = conversations.history(messages, turns)
    lines = F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), F.concat_ws(": ", "role", "text").alias("line"))))
    return before.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("history"))


def rewrite_prompt(kind: str, prompt: str = "", count: int = 3) -> Column:
    """What a model is asked, of columns text and history: the history stands before the request."""
    text = F.coalesce("text", F.lit(""))
    if kind == "hyde":
        own = F.replace(F.lit(HYDE), F.lit("{q}"), text)
    elif kind == "multi":
        own = F.concat(F.lit(f"{prompt.strip()}\n\n{MULTI.replace('{n}', str(count))}\n\n{ASKED}"), text)
    else:
        own = F.concat(F.lit(f"{prompt.strip()}\n\n{ASKED}"), text)
    return F.concat(F.lit(REWRITE_SYSTEM + "\n"), F.when(F.col("history") != "", F.concat("history", F.lit("\n"))).otherwise(""), own)


def retry_prompt(text: Column, tried: Column) -> Column:
    """What a model is asked for another query, after those ``tried`` found nothing."""
    asked = F.replace(F.replace(F.lit(RETRY), F.lit("{q}"), text), F.lit("{tried}"), F.array_join(tried, " / "))
    return F.concat(F.lit(RETRY_SYSTEM + "\n"), asked)


def score_prompt(query: Column, texts: Column, most: int = 1200) -> Column:
    """What a model is asked for the scores of an array of candidates, each cut at ``most`` characters."""
    numbered = F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("[#"), i.cast("string"), F.lit("] "), F.substring(t, 1, most))), "\n\n")
    return F.concat(F.lit(SCORE_SYSTEM + "\n查询："), query, F.lit("\n\n候选片段：\n"), numbered)


def response_items(responses: DataFrame, percent: bool = False) -> DataFrame:
    """query_id, index, score of rerank responses (query_id, answer: JSON text) of any known shape.

    The first list there is counts; items without an index or a score go. ``percent``: a
    model's own scores of 0 to 100, which may stand in other text.
    """
    raw = F.nullif(F.regexp_extract("answer", "(\\{[\\s\\S]*\\})", 1), F.lit("")) if percent else F.col("answer")
    found = F.try_parse_json(F.coalesce(raw, "answer"))
    lists = [F.try_variant_get(found, path, "array<variant>") for path in (["$.scores", "$.results", "$.data"] if percent else LISTS)]
    each = responses.select("query_id", F.explode(F.coalesce(*lists)).alias("r"))
    index = F.coalesce(F.try_variant_get("r", "$.index", "int"), F.try_variant_get("r", "$.document.index", "int"))
    score = F.coalesce(*[F.try_variant_get("r", f"$.{name}", "double") for name in SCORES])
    items = each.select("query_id", index.alias("index"), (score / 100 if percent else score).alias("score"))
    return items.where("index is not null and score is not null")


def rewrite(questions: DataFrame, model: Model | None = None, mode: str = "none", count: int = 3, prompt: str = "") -> DataFrame:
    """query_id, variant, text, mode: what to search for, for each question (query_id, text).

    single: one new query. multi: up to ``count`` (2 to 5) of a JSON object's queries. hyde: the
    question and a supposed answer. An empty multi or hyde goes on to single, an empty single to
    the question; an error gives the question with mode error.
    """
    asked = questions.select("query_id", "text")
    if mode == "none" or model is None:
        return asked.select("query_id", F.lit(0).alias("variant"), "text", F.lit("none").alias("mode"))
    count = max(2, min(5, count))
    history = F.coalesce("history", F.lit("")) if "history" in questions.columns else F.lit("")
    asked = questions.select("query_id", "text", history.alias("history"))
    said = lambda rows, kind: ask(rows.select("query_id", rewrite_prompt(kind, prompt, count).alias("prompt")), model)
    parts, left = [], asked
    if mode in ("multi", "hyde"):
        got = asked.join(said(asked, mode), "query_id")
        if mode == "multi":
            found = F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract("answer", "(\\{[\\s\\S]*\\})", 1), F.lit("")), "answer"))
            listed = F.slice(F.filter(F.try_variant_get(found, "$.queries", "array<string>"), lambda q: q != ""), 1, count)
            got = got.withColumn("list", F.coalesce(listed, F.array().cast("array<string>"))).withColumn("bad", F.col("error").isNotNull() | found.isNull())
        else:
            full = F.when(trim(F.col("answer")) != "", F.array("text", trim(F.col("answer"))))
            got = got.withColumn("list", F.coalesce(full, F.array().cast("array<string>"))).withColumn("bad", F.col("error").isNotNull())
        parts.append(got.where("not bad").select("query_id", F.posexplode("list").alias("variant", "text"), F.lit(mode).alias("mode")))
        parts.append(got.where("bad").select("query_id", F.lit(0).alias("variant"), "text", F.lit("error").alias("mode")))
        left = got.where("not bad and size(list) = 0").select("query_id", "text", "history")
    got = left.join(said(left, "single"), "query_id")
    text = F.coalesce(F.nullif(unquoted(F.col("answer")), F.lit("")), "text")
    parts.append(got.select("query_id", F.lit(0).alias("variant"), text.alias("text"), F.when(F.col("error").isNull(), "single").otherwise("error").alias("mode")))
    return reduce(DataFrame.unionByName, parts)


def rerank_items(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """``candidates`` (query_id, rank from 1, ...) with the rerank score of ``items`` (query_id, index from 0, score).

    Items without a finite score or beyond the candidates go; so do candidates without an item.
    """
    fine = items.where("index is not null and score is not null and not isnan(score) and abs(score) <> double('infinity')")
    named = fine.select("query_id", (F.col("index") + 1).alias("rank"), F.col("score").cast("double").alias("rerank"))
    return candidates.join(named, ["query_id", "rank"])


def rerank_chain(candidates: DataFrame, rerankers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """``candidates`` with rerank and rerank_mode: each query takes the first reranker that has anything for it.

    A reranker maps candidates to (query_id, chunk_pos, rerank). Queries that none serves keep
    their candidates, rerank null, mode none.
    """
    left, parts = candidates, []
    for name, reranker in rerankers.items():
        found = materialise(reranker(left).select("query_id", "chunk_pos", "rerank"), "reranked")
        parts.append(left.join(found, ["query_id", "chunk_pos"]).withColumn("rerank_mode", F.lit(name)))
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
    parts.append(left.withColumn("rerank", F.lit(None).cast("double")).withColumn("rerank_mode", F.lit("none")))
    return reduce(DataFrame.unionByName, parts)


#: What is said where a reranker has nothing, and where the next one stood in for it.
NOTHING = "重排结果为空"
STOOD_IN = "重排 API 失败，已降级为 LLM 打分："


def rerank_with_fallback(candidates: DataFrame, service: Callable[[DataFrame], DataFrame], other: Callable[[DataFrame], DataFrame] | None = None, top_n: int = 20, names: tuple[str, str] = ("api", "llm")) -> DataFrame:
    """``candidates`` (query_id, rank from 1, chunk_pos, ...) with rerank, place, rerank_mode and degraded.

    A service maps candidates to items: query_id, index (rank - 1), score, error (text, where it failed for the query).
    Queries for which the first fails, or has no item of theirs, go to ``other``, and ``degraded`` says why; where
    that fails too they keep their candidates in order, without rerank, and both reasons are told.
    """
    keep = candidates.columns

    def served(rows: DataFrame, run: Callable[[DataFrame], DataFrame], name: str) -> tuple[DataFrame, DataFrame]:
        items = materialise(run(rows).select("query_id", "index", "score", "error"), "items")
        why = items.where("error is not null").groupBy("query_id").agg(F.max("error").alias("why"))
        scored = rerank_items(rows, items).join(why, "query_id", "left_anti")
        order = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "rank")
        scored = materialise(scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top_n).withColumn("rerank_mode", F.lit(name)), "reranked")
        lost = rows.select("query_id").distinct().join(scored.select("query_id").distinct(), "query_id", "left_anti").join(why, "query_id", "left")
        return scored, materialise(lost.select("query_id", F.coalesce("why", F.lit(NOTHING)).alias("why")), "failed")

    result = [*keep, "rerank", "place", "rerank_mode", "degraded"]
    done, failed = served(candidates, service, names[0])
    parts = [done.withColumn("degraded", F.lit(None).cast("string")).select(result)]
    if other is not None:
        second, again = served(candidates.join(failed.select("query_id"), "query_id", "left_semi"), other, names[1])
        parts.append(second.join(failed, "query_id").withColumn("degraded", F.concat(F.lit(STOOD_IN), "why")).select(result))
        failed = failed.join(again.select("query_id", F.col("why").alias("also")), "query_id").select("query_id", F.concat_ws(" | ", "why", "also").alias("why"))
    rest = candidates.join(failed, "query_id").select(*keep, F.lit(None).cast("double").alias("rerank"), F.col("rank").cast("int").alias("place"), F.lit("none").alias("rerank_mode"), F.col("why").alias("degraded"))
    return reduce(DataFrame.unionByName, [*parts, rest])


def with_retries(questions: DataFrame, search: Callable[[DataFrame], DataFrame], propose: Callable[[DataFrame], DataFrame], rounds: int = 2) -> DataFrame:
    """What ``search`` finds for each question (query_id, text), with iteration and query.

    Questions without a result are asked again, ``rounds`` times at most, with what ``propose``
    makes of (query_id, text, tried): query_id, new_text. Only new, non-empty proposals go on.
    """
    left = questions.select("query_id", "text", F.array("text").alias("tried"))
    parts = []
    for i in range(rounds + 1):
        found = materialise(search(left.select("query_id", "text")), "found")
        parts.append(found.join(left.select("query_id", F.col("text").alias("query")), "query_id").withColumn("iteration", F.lit(i)))
        left = left.join(found.select("query_id").distinct(), "query_id", "left_anti")
        if i == rounds:
            break
        new = left.join(propose(left).select("query_id", unquoted(F.col("new_text")).alias("new")), "query_id")
        new = new.where("new <> '' and not array_contains(tried, new)")
        left = materialise(new.select("query_id", F.col("new").alias("text"), F.array_append("tried", F.col("new")).alias("tried")), "retry")
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, parts)


def no_answer(questions: DataFrame, refs: DataFrame, mode: str = "refuse", text: str = REFUSAL) -> DataFrame:
    """query_id, refused, answer: the fixed text for questions without context, null for those a model answers."""
    has = refs.select("query_id").distinct().withColumn("has", F.lit(True))
    refused = F.col("has").isNull() & F.lit(mode == "refuse")
    return questions.select("query_id").join(has, "query_id", "left").select("query_id", refused.alias("refused"), F.when(refused, text).alias("answer"))


def offline_answer(question: Column) -> Column:
    """The template answer of the offline model, which quotes the question's last line."""
    last = F.element_at(F.split(F.coalesce(question, F.lit("")), "\n"), -1)
    return F.concat(F.lit(ANSWER_HEAD), F.substring(last, 1, EXCERPT), F.lit(ANSWER_TAIL))


def answer_events(answers: DataFrame) -> DataFrame:
    """run_id, seq, type, payload: each answer (query_id, answer) as deltas of a few characters, then done."""
    pieces = F.regexp_extract_all("answer", F.lit(f"[\\s\\S]{{1,{PIECE}}}"), F.lit(0))
    each = F.concat(F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("type"), p.alias("payload"))), F.array(F.struct(F.lit("done").alias("type"), F.lit("").alias("payload"))))
    return answers.select(F.col("query_id").alias("run_id"), F.posexplode(each).alias("seq", "e")).select("run_id", "seq", "e.type", "e.payload")


def within_budget(refs: DataFrame, budget: int) -> DataFrame:
    """The leading passages of each query (query_id, ref, tokens) whose tokens fit the budget together."""
    total = F.sum("tokens").over(Window.partitionBy("query_id").orderBy("ref").rowsBetween(Window.unboundedPreceding, 0))
    return refs.withColumn("used", total).where(F.col("used") <= budget)
