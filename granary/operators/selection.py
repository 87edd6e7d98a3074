"""From ranked hits to what is handed on: one row per document, valid rows, sub-queries, branches and a selector's choice."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import titles as TT
from granary.functions.text import dedup_key
from granary.operators.fusion import newest_version, select_listed
from granary.operators.qa import first_json, fit_texts, picks_of

#: Token counts from which a question is taken apart into two and three.
TWO_FROM, THREE_FROM = 30, 58
#: Keys under which a listwise reranker names the place of a document, and a selector its choice.
PLACE_KEYS = ("index", "corpus_id", "doc_id", "document_index")
CHOICE_KEYS = ("selected", "indices", "indexes", "candidates", "relevant_candidates")
LEAST_LINE = 10


def one_per_document(hits: DataFrame, number: str, title: str, article: str, dates: Column, score: str = "score", rank: str = "rank") -> DataFrame:
    """One hit per document and article of each qid, in the place of its first hit.

    Hits with equal `document_key` and article are one; of consolidated texts
    the newest stays, else the best score, then the first rank. A hit without a
    title is a document of its own. Adds `key`, `position` and `rank_out`.
    """
    doc, art = TT.document_key(number, title, dates), dedup_key(article)
    key = F.when(doc == "", F.concat(F.lit("point|"), F.col("id").cast("string"))).when(art != "", F.concat_ws("|", F.lit("article"), doc, art)).otherwise(F.concat_ws("|", F.lit("doc"), doc))
    newest = TT.is_consolidated(F.array(F.col(number), F.col(title)))
    none = F.struct(F.lit(0).alias("y"), F.lit(0).alias("m"), F.lit(0).alias("d"))
    keyed = hits.withColumn("key", key).withColumn("when_", F.when(newest, TT.issue_key(dates, title)).otherwise(none))
    return newest_version(keyed, ["qid"], ["key"], [F.col("when_")], score, rank).drop("when_")


def valid_only(hits: DataFrame, by: str, number: Column, title: Column, limit: int | None = None) -> DataFrame:
    """Hits with a number and a usable title, ranked anew; the limit counts what is left."""
    ok = hits.filter((F.trim(F.coalesce(number, F.lit(""))) != "") & ~TT.bad_title(title))
    w = Window.partitionBy(by).orderBy("rank", F.col("id").cast("string"))
    out = ok.withColumn("old_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.filter(F.col("rank") <= limit)


def n_sub_queries(tokens: Column, two_from: int = TWO_FROM, three_from: int = THREE_FROM) -> Column:
    return F.when(tokens < two_from, 1).when(tokens < three_from, 2).otherwise(3)


def split_answer(text: str | None, n: int, question: str) -> list[str]:
    """Sub-queries in a model's answer: a JSON array, filled up with the question; else its long lines; else the question."""
    text = (text or "").strip()
    if m := re.search(r"\[.*\]", text, re.S):
        try:
            value = json.loads(m[0])
        except ValueError:
            value = None
        parts = [s for s in (str(x).strip() for x in value or ()) if s]
        if parts:
            return (parts + [question] * n)[:n]
    lines = [s for s in (x.strip(" \"'-•") for x in text.splitlines() if x.strip()) if len(s) > LEAST_LINE]
    return lines[:n] if len(lines) >= n else [question]


def sub_queries(questions: DataFrame, answers: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(qid, pos, text): what each question is searched by.

    `questions` has qid, text, n. `known` (qid, sub_queries) comes before a
    model's `answers` (qid, answer); a question with neither is its own
    sub-query. Question ids are compared as text.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<string>")
    def read(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, n, q in parts:
            yield pd.Series([split_answer(x, int(k), t) for x, k, t in zip(a, n, q)])

    q = questions.withColumn("k_", F.col("qid").cast("string"))
    none = F.lit(None)
    for df, name, kind in ((known, "sub_queries", "array<string>"), (answers, "answer", "string")):
        q = q.join(df.select(F.col("qid").cast("string").alias("k_"), name), "k_", "left") if df is not None else q.withColumn(name, none.cast(kind))
    own = F.array(F.coalesce("text", F.lit("")))
    given = F.filter(F.coalesce("sub_queries", F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    parts = F.when(F.size(given) > 0, given).when((F.col("n") <= 1) | F.col("answer").isNull(), own).otherwise(read("answer", "n", "text"))
    return q.select("qid", F.posexplode(parts).alias("pos", "text"))


def branches(ranked: DataFrame, most_numbers: int = 3, most_topics: int = 1) -> DataFrame:
    """(qid, branch_no, kind, value): filters to search by, from (qid, domain_rank, numbers, topics).

    Numbers are taken in turn from the domains (the first of each, then the
    second of each), topics domain by domain; each value once.
    """
    def first(values: str, order: list[str], most: int, kind: str) -> DataFrame:
        x = ranked.select("qid", "domain_rank", F.posexplode(values).alias("i", "value"))
        x = x.groupBy("qid", "value").agg(F.min(F.struct(*order)).alias("at"))
        return x.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).filter(F.col("n") <= most).select("qid", F.lit(kind).alias("kind"), "n", "value")

    both = first("numbers", ["i", "domain_rank"], most_numbers, "number").unionByName(first("topics", ["domain_rank", "i"], most_topics, "topic"))
    return both.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("kind", "n")).alias("branch_no"), "kind", "value")


def listwise_scores(results: list[dict], documents: list[str]) -> list[float]:
    """A score for each document from a listwise reranker's results.

    A result belongs to the place it names, else to the first unused document
    with its text, else to the place it stands at; a place is filled once.
    """
    scores: dict[int, float] = {}
    for i, r in enumerate(x if isinstance(x, dict) else {} for x in results):
        if not r:
            continue
        named = next((int(r[k]) for k in PLACE_KEYS if isinstance(r.get(k), int) or str(r.get(k)).isdigit()), None)
        same = (j for j, d in enumerate(documents) if j not in scores and r.get("document") is not None and str(r["document"]) == d)
        at = named if named is not None else next(same, i if i not in scores else -1)
        if 0 <= at < len(documents) and at not in scores:
            scores[at] = float(r.get("relevance_score", r.get("score", 0.0)))
    return [scores.get(i, 0.0) for i in range(len(documents))]


def choice_of(text: str | None, n: int) -> list[int] | None:
    """Places from 1 to n that a selector chose; None if its answer can't be read, [] if it finds none answerable."""
    value = first_json(text or "")
    if isinstance(value, dict):
        found = next((value[k] for k in CHOICE_KEYS if value.get(k) is not None), None)
        value = [] if found is None and value.get("answerable") is False else found
    return picks_of(json.dumps(value), n) if isinstance(value, list) else None


def candidate_prompts(pool: DataFrame, text: str, budget: int, count: Callable[[str], int]) -> DataFrame:
    """(qid, n_candidates, prompt): the candidates of each question, numbered by rank, their texts cut to one length at which all fit the budget."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        texts = fit_texts([x or "" for x in g[text]], budget, count)
        return pd.DataFrame({"qid": [g["qid"].iloc[0]], "n_candidates": [len(g)], "prompt": ["\n\n".join(f"[{i}]\n{t}" for i, t in enumerate(texts, 1))]})

    kind = pool.schema["qid"].dataType.simpleString()
    return pool.select("qid", "rank", text).groupBy("qid").applyInPandas(pack, f"qid {kind}, n_candidates int, prompt string")


def select_candidates(pool: DataFrame, answers: DataFrame, fallback: int) -> DataFrame:
    """The candidates of a stored pool that a selector's `answers` (qid, answer) name, in its order; without a valid one the first `fallback`.

    Ranks of the pool count from 1 without gaps.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<int>")
    def read(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, n in parts:
            yield pd.Series([choice_of(x, int(k)) or [] for x, k in zip(a, n)])

    size = pool.groupBy("qid").agg(F.max("rank").alias("n"))
    return select_listed(pool, answers.join(size, "qid").select("qid", read("answer", "n").alias("picks")), fallback)


def keyword_delta(rows: DataFrame, text: Column, extra: list[str], active: list[str], known: DataFrame, key: str = "id") -> DataFrame:
    """(key, reason, hits, new_hits): why a row stays out, or `delta` for those that new keywords bring in.

    Reasons in this order: the key is `known`, no extra keyword stands in the
    text, only active ones do.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.array(*(F.lit(w.lower()) for w in dict.fromkeys(extra)))
    old = F.array(*(F.lit(w.lower()) for w in active)) if active else F.array().cast("array<string>")
    hits = F.filter(words, lambda w: F.contains(low, w))
    j = rows.withColumn("hits", hits).withColumn("new_hits", F.array_except("hits", old)).join(known.select(key).distinct().withColumn("known_", F.lit(True)), key, "left")
    reason = F.when(F.col("known_"), "already_known").when(F.size("hits") == 0, "no_extra_keyword").when(F.size("new_hits") == 0, "only_active_keywords").otherwise("delta")
    return j.select(key, reason.alias("reason"), "hits", "new_hits")
