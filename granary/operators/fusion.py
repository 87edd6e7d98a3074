"""Rank fusion, reranking, version-aware de-duplication and selection of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import terms
from granary.session import plain_unions

RRF_K = 60


def rrf(branches: dict[str, DataFrame], limit: int, weights: dict[str, float] | None = None, k: int = RRF_K) -> DataFrame:
    """(qid, id, score, rank, <branch>_rank, <branch>_score): reciprocal-rank fusion of ranked lists.

    A branch has (qid, id, score, rank). A hit scores the sum of weight /
    (k + rank). Ties: by the ranks of the branches in their order (missing
    last), then by the id as text.
    """
    weights = weights or {}
    plain_unions(next(iter(branches.values())).sparkSession)
    parts = [df.select("qid", "id", "score", "rank", F.lit(name).alias("branch"), F.lit(float(weights.get(name, 1.0))).alias("w")) for name, df in branches.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    of = lambda c, name: F.min(F.when(F.col("branch") == name, F.col(c))).alias(f"{name}_{c}")
    fused = both.groupBy("qid", "id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 9).alias("score"), *(of(c, n) for n in branches for c in ("rank", "score")))
    order = [F.col("score").desc(), *(F.col(f"{n}_rank").asc_nulls_last() for n in branches), F.col("id").cast("string")]
    w = Window.partitionBy("qid").orderBy(*order)
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def rerank(hits: DataFrame, score: Column, limit: int, threshold: float | None = None) -> DataFrame:
    """Hits ordered anew by `score`; ties by the old rank, then the id as text. Adds rerank_score and retrieval_rank."""
    scored = hits.withColumn("rerank_score", score).withColumnRenamed("rank", "retrieval_rank")
    if threshold is not None:
        scored = scored.filter(F.col("rerank_score") >= threshold)
    w = Window.partitionBy("qid").orderBy(F.col("rerank_score").desc(), F.col("retrieval_rank"), F.col("id").cast("string"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def overlap_score(query: Column | str, text: Column | str) -> Column:
    """A scorer without a model: the share of the query's distinct terms that the text has."""
    q, t = F.array_distinct(terms(query)), terms(text)
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(q, t)) / F.size(q), 6))


def newest_version(hits: DataFrame, by: list[str], key: list[str], recency: list[Column], score: str, rank: str) -> DataFrame:
    """One row per key within each of `by`: the most recent, then the best score, then the first rank.

    It takes the place (`position`) of the key's first row.
    """
    w = Window.partitionBy(*by, *key)
    best = w.orderBy(*(c.desc() for c in recency), F.col(score).desc(), F.col(rank))
    x = hits.withColumn("n_", F.row_number().over(best)).withColumn("position", F.min(rank).over(w)).filter("n_ = 1").drop("n_")
    return x.withColumn("rank_out", F.row_number().over(Window.partitionBy(*by).orderBy("position")))


def select_listed(candidates: DataFrame, chosen: DataFrame, fallback: int) -> DataFrame:
    """Candidates picked by number: `chosen` has (qid, picks array<int>, from 1).

    Numbers out of range and repeats are ignored; a query without a valid pick
    gets its first `fallback` candidates.
    """
    n = candidates.groupBy("qid").agg(F.max("rank").alias("n"))
    valid = chosen.join(n, "qid").select("qid", F.array_distinct(F.filter("picks", lambda i: (i >= 1) & (i <= F.col("n")))).alias("picks"))
    j = candidates.join(valid, "qid", "left")
    none = F.coalesce(F.size("picks"), F.lit(0)) <= 0
    at = F.when(none, F.col("rank")).otherwise(F.array_position("picks", F.col("rank")))
    return j.withColumn("rank_out", at.cast("int")).filter(F.when(none, F.col("rank") <= fallback).otherwise(F.col("rank_out") > 0)).drop("picks")


def running_budget(rows: DataFrame, by: str, order: list[Column], text: str, budget: int, separator: int = 4, least: int = 200) -> DataFrame:
    """Texts in order until a budget of characters is used up.

    A text that no longer fits is cut to what remains if that is at least
    `least` characters; blank texts are skipped. Adds `context` and `remaining`.
    """
    full = rows.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rem = F.lit(budget) - F.coalesce(F.sum(F.length(text) + separator).over(w), F.lit(0))
    x = full.withColumn("remaining", rem.cast("bigint"))
    fits = (F.col("remaining") > 0) & ((F.length(text) <= F.col("remaining")) | (F.col("remaining") >= least))
    return x.filter(fits).withColumn("context", F.rtrim(F.substr(F.col(text), F.lit(1), F.col("remaining").cast("int"))))


def ordered_refs(hits: DataFrame, by: str, ref: Column, pos: str = "rank") -> DataFrame:
    """(by, refs): distinct non-empty references in the order of their first hit."""
    first = hits.select(by, ref.alias("ref"), pos).filter("ref <> ''").groupBy(by, "ref").agg(F.min(pos).alias("p"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "ref"))), lambda x: x["ref"]).alias("refs"))
