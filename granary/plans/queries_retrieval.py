"""Retrieval queries. Queries are the rows whose id 50 divides, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import terms
from granary.operators import fusion, retrieval
from granary.plans import sql as S
from granary.session import spread, table, written

EVERY = 50


def _vectors(spark: SparkSession, d: str, label: bool = False) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    more = ["label"] if label else []
    v = e.select(F.col("vec_id").alias("id"), "embedding", *more)
    return v, e.filter(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("qid"), "embedding", *more)


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return docs, docs.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("qid"), "text")


def _titles(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "doc_metadata").filter(F.col("id") % EVERY == 0)
    return m.groupBy(F.col("id").alias("qid")).agg(F.max("title").alias("text"))


TITLES = f"SELECT id AS qid, max(title) AS text FROM doc_metadata WHERE id % {EVERY} = 0 GROUP BY id"
TEXTS = "SELECT doc_id AS id, text FROM documents"
TEXT_QUERIES = f"SELECT doc_id AS qid, text FROM documents WHERE doc_id % {EVERY} = 0"


def _dense_sql(k: int, same: bool = False) -> str:
    return S.top(f"SELECT q.vec_id AS qid, v.vec_id AS id, {S.cosine('q.embedding', 'v.embedding')} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id{' AND q.label = v.label' if same else ''} WHERE q.vec_id % {EVERY} = 0", k)


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(*_vectors(spark, d), 10)


def dense_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.dense_top_k(*_vectors(spark, d, True), 10, same="label")


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_top_k(_texts(spark, d)[0], _titles(spark, d), 10)


def _branches(spark: SparkSession, d: str, k: int = 20) -> dict[str, DataFrame]:
    v, q = _vectors(spark, d)
    return {"dense": retrieval.dense_top_k(v, q, k), "sparse": retrieval.bm25_top_k(*_texts(spark, d), k, keep_self=False)}


def _rrf_sql(k: int, limit: int, wd: float, ws: float) -> str:
    return f"""
        WITH dense AS ({_dense_sql(k)}), sparse AS (SELECT * FROM ({S.bm25(TEXTS, TEXT_QUERIES, k, keep_self=False)})),
        x AS (SELECT qid, id, score, rank, 'dense' AS branch, {wd} AS w FROM dense UNION ALL SELECT qid, id, score, rank, 'sparse', {ws} FROM sparse),
        f AS (SELECT qid, id, round(sum(CAST(w AS DOUBLE) / ({fusion.RRF_K} + rank)), 9) AS score,
                     min(rank) FILTER (branch = 'dense') AS dense_rank, min(score) FILTER (branch = 'dense') AS dense_score,
                     min(rank) FILTER (branch = 'sparse') AS sparse_rank, min(score) FILTER (branch = 'sparse') AS sparse_score FROM x GROUP BY qid, id)
        {S.top('SELECT * FROM f', limit, 'score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, CAST(id AS VARCHAR)')}
    """


def hybrid_rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_branches(spark, d), 10)


def hybrid_rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_branches(spark, d), 10, {"dense": 1.0, "sparse": 3.0})


def bm25_index(spark: SparkSession, d: str) -> DataFrame:
    p = retrieval.postings(_texts(spark, d)[0])
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").cast("bigint").alias("max_tf"))


def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = _texts(spark, d)[0]
    q = _titles(spark, d)
    hits = retrieval.bm25_top_k(docs, q, 20)
    full = hits.join(docs, "id").join(q.withColumnRenamed("text", "question"), "qid")
    out = fusion.rerank(full, fusion.overlap_score("question", "text"), 5, threshold=0.2)
    return out.select("qid", "id", "score", "retrieval_rank", "rerank_score", "rank")


def multi_query_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Each half of a title is a query of its own; their lists are fused per title."""
    docs, q = _texts(spark, d)[0], _titles(spark, d).select("qid", terms("text").alias("t"))
    half = F.ceil(F.size("t") / 2).cast("int")
    parts = q.select("qid", F.array_join(F.slice("t", F.lit(1), half), " ").alias("a"), F.array_join(F.slice("t", half + 1, F.greatest(F.size("t"), F.lit(1))), " ").alias("b"))
    index = written(retrieval.tokens(spread(docs)), "terms")
    lists = {n: retrieval.bm25_top_k(docs, parts.select("qid", F.col(n).alias("text")), 20, index=index) for n in ("a", "b")}
    return fusion.rrf(lists, 10)


def dedup_versioned(spark: SparkSession, d: str) -> DataFrame:
    """Of hits with the same text only the newest stays, in the place of the first."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "published_at")
    hits = retrieval.bm25_top_k(docs.select("id", "text"), _titles(spark, d), 30).join(docs, "id")
    from granary.functions.text import dedup_key

    keyed = hits.withColumn("key", F.md5(dedup_key("text")))
    out = fusion.newest_version(keyed, ["qid"], ["key"], [F.coalesce(F.unix_micros("published_at"), F.lit(-1))], "score", "rank")
    return out.select("qid", "id", "score", "rank", "position", F.col("rank_out").cast("int").alias("rank_out"))


def selection_join(spark: SparkSession, d: str) -> DataFrame:
    """Candidates picked by the numbers that a selector returned; every third query has none that is valid."""
    hits = retrieval.dense_top_k(*_vectors(spark, d), 8)
    picks = F.when(F.col("qid") % 3 == 0, F.array(F.lit(0), F.lit(99))).otherwise(F.array(F.lit(4), F.lit(2), F.lit(4), F.lit(50)))
    chosen = hits.select("qid").distinct().select("qid", picks.alias("picks"))
    return fusion.select_listed(hits, chosen, 3).select("qid", "id", "score", "rank", "rank_out")


def vector_l2_norm(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    n = retrieval.normalised("embedding")
    return e.select("vec_id", F.round(retrieval.l2_norm("embedding"), 6).alias("norm"), F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 5).alias("unit_sum"))


QUERIES = {f.__name__: f for f in (dense_topk, dense_topk_filtered, bm25_topk, hybrid_rrf, hybrid_rrf_weighted, bm25_index, rerank_lexical, multi_query_rrf, dedup_versioned, selection_join, vector_l2_norm)}

_BM = S.bm25(TEXTS, TITLES, 20)
_HALF = "CAST(ceil(len(t) / 2) AS INTEGER)"
_PARTS = f"SELECT qid, t[1:{_HALF}] AS a, t[{_HALF} + 1:] AS b FROM (SELECT qid, {S.terms('text')} AS t FROM ({TITLES}))"
_LIST = {n: S.bm25(TEXTS, f"SELECT qid, array_to_string({n}, ' ') AS text FROM ({_PARTS})", 20) for n in "ab"}

ORACLE_SQL = {
    "dense_topk": _dense_sql(10),
    "dense_topk_filtered": _dense_sql(10, True),
    "bm25_topk": S.bm25(TEXTS, TITLES, 10),
    "hybrid_rrf": _rrf_sql(20, 10, 1.0, 1.0),
    "hybrid_rrf_weighted": _rrf_sql(20, 10, 1.0, 3.0),
    "bm25_index": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({S.terms('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "rerank_lexical": f"""
        WITH h AS ({_BM}), j AS (SELECT h.qid, h.id, h.score, h.rank AS retrieval_rank, list_distinct({S.terms('q.text')}) AS qt, list_distinct({S.terms('d.text')}) AS dt
            FROM h JOIN ({TEXTS}) d USING (id) JOIN ({TITLES}) q USING (qid)),
        s AS (SELECT qid, id, score, retrieval_rank, CASE WHEN len(qt) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(qt, dt)) AS DOUBLE) / len(qt), 6) END AS rerank_score FROM j)
        {S.top('SELECT * FROM s WHERE rerank_score >= 0.2', 5, 'rerank_score DESC, retrieval_rank, CAST(id AS VARCHAR)')}
    """,
    "multi_query_rrf": f"""
        WITH a AS (SELECT * FROM ({_LIST['a']})), b AS (SELECT * FROM ({_LIST['b']})),
        x AS (SELECT *, 'a' AS branch FROM a UNION ALL SELECT *, 'b' FROM b),
        f AS (SELECT qid, id, round(sum(CAST(1.0 AS DOUBLE) / (60 + rank)), 9) AS score, min(rank) FILTER (branch = 'a') AS a_rank, min(score) FILTER (branch = 'a') AS a_score,
                     min(rank) FILTER (branch = 'b') AS b_rank, min(score) FILTER (branch = 'b') AS b_score FROM x GROUP BY qid, id)
        {S.top('SELECT * FROM f', 10, 'score DESC, a_rank NULLS LAST, b_rank NULLS LAST, CAST(id AS VARCHAR)')}
    """,
    "dedup_versioned": f"""
        WITH h AS ({S.bm25(TEXTS, TITLES, 30)}), j AS (SELECT h.*, md5({S.dedup_key('d.text')}) AS key, coalesce(epoch_us(d.published_at), -1) AS p FROM h JOIN documents d ON d.doc_id = h.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY p DESC, score DESC, rank) AS n, min(rank) OVER (PARTITION BY qid, key) AS position FROM j)
        SELECT qid, id, score, rank, position, CAST(row_number() OVER (PARTITION BY qid ORDER BY position) AS INTEGER) AS rank_out FROM r WHERE n = 1
    """,
    "selection_join": f"""
        WITH h AS ({_dense_sql(8)})
        SELECT qid, id, score, rank, CAST(CASE WHEN qid % 3 = 0 THEN rank WHEN rank = 4 THEN 1 ELSE 2 END AS INTEGER) AS rank_out FROM h
        WHERE CASE WHEN qid % 3 = 0 THEN rank <= 3 ELSE rank IN (4, 2) END
    """,
    "vector_l2_norm": """
        WITH n AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM n)
        SELECT vec_id, round(n, 6) AS norm, round(list_sum(list_transform(e, lambda x: CASE WHEN n = 0 THEN x ELSE x / n END)), 5) AS unit_sum FROM l
    """,
}
