"""Grounded answers: contexts, messages, validation, repair, fallback. The model is a callable."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.extract import article_numbers, article_ref, doc_ref
from granary.functions.text import squeeze
from granary.operators.fusion import ordered_refs, running_budget

NOT_FOUND = "Chưa xác định được căn cứ pháp luật liên quan."
FALLBACK = "Các căn cứ pháp luật liên quan được hệ thống truy hồi gồm: "


def allowed_articles(refs: Column) -> Column:
    """`Điều n` of article references (number|title|article), in order."""
    return F.array_distinct(F.flatten(F.transform(refs, lambda r: article_numbers(F.substring_index(r, "|", -1), ordered=True))))


def disallowed_articles(answer: Column, allowed: Column) -> Column:
    """Articles that an answer names and its sources don't, in order of mention."""
    return F.array_except(article_numbers(answer, ordered=True), F.coalesce(allowed, F.array().cast("array<string>")))


def needs_repair(answer: Column, allowed: Column) -> Column:
    """Whether the answer is blank, names an article it may not, or names none although there are some."""
    said = article_numbers(answer, ordered=True)
    some = F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0
    return (squeeze(answer) == "") | (F.size(disallowed_articles(answer, allowed)) > 0) | (some & ~F.arrays_overlap(said, allowed))


def fallback_answer(allowed: Column) -> Column:
    return F.when(F.size(F.coalesce(allowed, F.array().cast("array<string>"))) > 0, F.concat(F.lit(FALLBACK), F.array_join(allowed, "; "), F.lit("."))).otherwise(F.lit(NOT_FOUND))


def clean_answer(c: Column | str) -> Column:
    """An answer without the model's thinking and its blank lines."""
    x = F.regexp_replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), r"(?is)<think>.*?</think>|<think>.*$|^.*?</think>", "")
    return F.array_join(F.filter(F.transform(F.split(x, "\n"), lambda s: F.rtrim(s)), lambda s: F.trim(s) != ""), "\n")


def context_rows(hits: DataFrame, budget: int = 6000) -> DataFrame:
    """(qid, relevant_docs, relevant_articles, allowed_articles, contexts) of ranked hits.

    `hits` has qid, rank, score, number, title, article, text. Contexts are the
    texts in rank order until `budget` characters are used.
    """
    docs = ordered_refs(hits, "qid", doc_ref("number", "title")).withColumnRenamed("refs", "relevant_docs")
    arts = ordered_refs(hits, "qid", article_ref("number", "title", "article")).withColumnRenamed("refs", "relevant_articles")
    kept = running_budget(hits, "qid", [F.col("rank")], "text", budget)
    item = F.struct("rank", "score", doc_ref("number", "title").alias("doc_ref"), article_ref("number", "title", "article").alias("article_ref"), F.col("context").alias("text"))
    ctx = kept.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("contexts"))
    none = F.array().cast("array<string>")
    out = hits.select("qid").distinct().join(docs, "qid", "left").join(arts, "qid", "left").join(ctx, "qid", "left")
    return out.select("qid", F.coalesce("relevant_docs", none).alias("relevant_docs"), F.coalesce("relevant_articles", none).alias("relevant_articles"), F.coalesce(allowed_articles(F.col("relevant_articles")), none).alias("allowed_articles"), "contexts")


def messages(question: Column, contexts: Column, allowed: Column, system: str = "Trả lời dựa trên các căn cứ đã cho.") -> Column:
    """array<struct<role, content>>: the system turn and the user turn with numbered contexts."""
    numbered = F.transform(contexts, lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), c["article_ref"], F.lit("\n"), c["text"]))
    user = F.concat(F.lit("Câu hỏi: "), squeeze(question), F.lit("\nĐiều được phép nêu: "), F.array_join(allowed, "; "), F.lit("\n\n"), F.array_join(numbered, "\n\n"))
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(system)), turn("user", user))


def repair_messages(first: Column, answer: Column, wrong: Column) -> Column:
    """The turns of a second try: the first ones, the answer, and what is wrong with it."""
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    note = F.concat(F.lit("Câu trả lời nêu điều không có trong căn cứ: "), F.array_join(wrong, "; "), F.lit(". Hãy viết lại."))
    return F.concat(first, F.array(turn("assistant", answer), turn("user", note)))


def generate(rows: DataFrame, model: Callable[[list[list[dict]]], list[str]], turns: str = "messages", out: str = "answer") -> DataFrame:
    """Adds the model's answers; the model gets a batch of conversations at a time. A failed batch gives empty answers."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            chats = [[dict(t) if isinstance(t, dict) else t for t in json.loads(x)] for x in s]
            try:
                yield pd.Series(model(chats))
            except Exception:  # the row shows it by its empty answer
                yield pd.Series([""] * len(chats))

    return rows.withColumn(out, call(F.to_json(turns)))


def answer_questions(rows: DataFrame, model: Callable[[list[list[dict]]], list[str]] | None, mode: str = "llm") -> DataFrame:
    """(qid, answer, relevant_docs, relevant_articles, repaired) of `context_rows` with a `question`.

    Modes: `empty`, `retrieval` (the fallback sentence) and `llm`: generate,
    check, generate once more where the check fails, fall back where it fails
    again.
    """
    if mode not in ("empty", "retrieval", "llm") or mode == "llm" and model is None:
        raise ValueError("mode is empty, retrieval or llm, and llm needs a model")
    allowed = F.col("allowed_articles")
    if mode != "llm":
        answer = F.lit("") if mode == "empty" else fallback_answer(allowed)
        return rows.select("qid", answer.alias("answer"), "relevant_docs", "relevant_articles", F.lit(False).alias("repaired"))
    first = generate(rows.withColumn("messages", messages(F.col("question"), F.col("contexts"), allowed)), model, "messages", "first")
    first = first.withColumn("first", clean_answer("first")).withColumn("again", needs_repair(F.col("first"), allowed))
    turns = F.when(F.col("again"), repair_messages(F.col("messages"), F.col("first"), disallowed_articles(F.col("first"), allowed))).otherwise(F.col("messages"))
    second = generate(first.filter("again").withColumn("turns", turns), model, "turns", "second").withColumn("second", clean_answer("second"))
    done = second.select("qid", F.when(needs_repair(F.col("second"), allowed), fallback_answer(allowed)).otherwise(F.col("second")).alias("answer"), "relevant_docs", "relevant_articles", F.lit(True).alias("repaired"))
    return first.filter("not again").select("qid", F.col("first").alias("answer"), "relevant_docs", "relevant_articles", F.lit(False).alias("repaired")).unionByName(done)


def first_json(text: str) -> object | None:
    """The first JSON value in a model's answer: fenced, bare or inside other words; None if there is none."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text or ""):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except ValueError:
            continue
    return None


def picks_of(text: str, n: int) -> list[int]:
    """Numbers from 1 to n that a selector's answer lists, once each, in order."""
    value = first_json(text)
    if isinstance(value, dict):
        value = next((v for v in value.values() if isinstance(v, list)), [])
    out: list[int] = []
    for x in value if isinstance(value, list) else []:
        if isinstance(x, bool) or not str(x).strip().isdigit():
            continue
        if 1 <= int(x) <= n and int(x) not in out:
            out.append(int(x))
    return out


def fit_texts(texts: list[str], budget: int, count: Callable[[str], int]) -> list[str]:
    """Texts cut to one common length, the longest at which all fit the budget of tokens."""
    low, high = 0, max(map(len, texts), default=0)
    while low < high:
        mid = (low + high + 1) // 2
        if sum(count(t[:mid]) for t in texts) <= budget:
            low = mid
        else:
            high = mid - 1
    return [t[:low] for t in texts]
