"""Filters on payload columns, keyword and branch queries, plans of sub-queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T
from granary.operators import fusion, payload, retrieval
from granary.operators.packed_values import MAX_NAMES, explode_packed
from granary.plans import queries_retrieval as R
from granary.plans import sql as S
from granary.plans.queries_corpus import CHUNKS, META, _chunks, _meta
from granary.session import table


def _sector_names(spark: SparkSession, d: str) -> list[str]:
    return sorted(r.sector_name for r in table(spark, d, "sector_list").select("sector_name").limit(MAX_NAMES + 1).collect())


def payload_filter(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).withColumn("articles", X.article_numbers("text"))
    f = payload.payload_filter(equal={"chunk_method": "tree_leaf"}, contains={"articles": "Điều 2"}, between={"chunk_index": (0, 3)})
    return c.filter(f).select("chunk_id", "chunk_index", "authority_code")


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mentions by sector name."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"))
    h = payload.keyword_hits(docs, "doc_id", "t", {n: [n.lower()] for n in _sector_names(spark, d)})
    return h.groupBy("rule").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("hits").alias("n_keywords"))


def domain_top(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).select("chunk_id", F.lower("text").alias("t"))
    rules: dict[str, list[str]] = {}
    for n in _sector_names(spark, d):
        rules.setdefault(n.split(" ")[0], []).append(n.lower().split(",")[0])
    return payload.top_rules(payload.keyword_hits(c, "chunk_id", "t", rules), "chunk_id", 2)


def sector_counts(spark: SparkSession, d: str) -> DataFrame:
    v = explode_packed(_meta(spark, d), "id", {"legal_sectors": {"names": _sector_names(spark, d), "dash": True}})
    return v.groupBy(F.lower("val").alias("sector")).agg(F.count_distinct("id").alias("n_acts"), F.min("id").alias("first_id"))


def branch_rrf(spark: SparkSession, d: str) -> DataFrame:
    v, q = R._vectors(spark, d, True)
    sparse = retrieval.bm25_top_k(*R._texts(spark, d), 15, keep_self=False)
    lists = {"all": retrieval.dense_top_k(v, q, 15), "same": retrieval.dense_top_k(v, q, 15, same="label"), "sparse": sparse}
    return fusion.rrf(lists, 10, {"all": 1.0, "same": 0.5, "sparse": 1.0}).select("qid", "id", "score", "rank", "all_rank", "same_rank", "sparse_rank")


def subquery_plan(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select("id", "title")
    n = T.token_estimate("title")
    return m.select("id", n.alias("tokens"), F.when(n <= 20, 1).when(n <= 26, 2).otherwise(3).alias("n_sub_queries"))


def shared_articles(spark: SparkSession, d: str) -> DataFrame:
    """Articles that an act's chunks name and that its own headings have."""
    c = _chunks(spark, d)
    said = c.select("document_id", F.explode(X.article_numbers("text")).alias("a")).groupBy("document_id").agg(F.collect_set("a").alias("said"))
    own = c.filter("article_no is not null").groupBy("document_id").agg(F.collect_set("article_no").alias("own"))
    both = F.array_sort(F.array_intersect("said", "own"))
    return said.join(own, "document_id").select("document_id", F.array_join(both, ";").alias("shared"), F.size(F.array_except("said", "own")).alias("n_foreign"))


QUERIES = {f.__name__: f for f in (payload_filter, keyword_hits, domain_top, sector_counts, branch_rrf, subquery_plan, shared_articles)}

_ART = "list_transform(regexp_extract_all(text, '(?i)Điều\\s+([0-9]+(?:\\.[0-9A-Za-zĐđ]+)*)', 1), lambda x: 'Điều ' || x)"
_SPARSE = S.bm25(R.TEXTS, R.TEXT_QUERIES, 15, keep_self=False)

ORACLE_SQL = {
    "payload_filter": f"SELECT chunk_id, chunk_index, authority_code FROM ({CHUNKS}) WHERE chunk_method = 'tree_leaf' AND chunk_index BETWEEN 0 AND 3 AND list_contains({_ART}, 'Điều 2')",
    "keyword_hits": "SELECT sector_name AS rule, count(*) AS n_docs, count(*) AS n_keywords FROM documents JOIN sector_list ON contains(lower(text), lower(sector_name)) GROUP BY sector_name",
    "domain_top": f"""
        WITH r AS (SELECT DISTINCT string_split(sector_name, ' ')[1] AS rule, string_split(lower(sector_name), ',')[1] AS k FROM sector_list),
        h AS (SELECT chunk_id, rule, count(*) AS hits FROM ({CHUNKS}) c JOIN r ON contains(lower(c.text), k) GROUP BY ALL)
        SELECT chunk_id, rule, CAST(hits AS INTEGER) AS hits, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY hits DESC, rule) AS INTEGER) AS rank FROM h QUALIFY rank <= 2
    """,
    "branch_rrf": f"""
        WITH a AS ({R._dense_sql(15)}), b AS ({R._dense_sql(15, True)}), c AS (SELECT * FROM ({_SPARSE})),
        x AS (SELECT qid, id, rank, 'all' AS branch, 1.0 AS w FROM a UNION ALL SELECT qid, id, rank, 'same', 0.5 FROM b UNION ALL SELECT qid, id, rank, 'sparse', 1.0 FROM c),
        f AS (SELECT qid, id, round(sum(CAST(w AS DOUBLE) / (60 + rank)), 9) AS score, min(rank) FILTER (branch = 'all') AS all_rank, min(rank) FILTER (branch = 'same') AS same_rank, min(rank) FILTER (branch = 'sparse') AS sparse_rank FROM x GROUP BY qid, id)
        {S.top('SELECT * FROM f', 10, 'score DESC, all_rank NULLS LAST, same_rank NULLS LAST, sparse_rank NULLS LAST, CAST(id AS VARCHAR)')}
    """,
    "subquery_plan": f"SELECT id, n AS tokens, CAST(CASE WHEN n <= 20 THEN 1 WHEN n <= 26 THEN 2 ELSE 3 END AS INTEGER) AS n_sub_queries FROM (SELECT id, {S.token_estimate('title')} AS n FROM ({META}))",
    "shared_articles": f"""
        WITH c AS ({CHUNKS}), s AS (SELECT document_id, list_distinct(flatten(list({_ART}))) AS said FROM c GROUP BY document_id), o AS (SELECT document_id, list_distinct(list(article_no)) AS own FROM c WHERE article_no IS NOT NULL GROUP BY document_id)
        SELECT document_id, array_to_string(list_sort(list_intersect(said, own)), ';') AS shared, CAST(len(list_filter(said, lambda x: NOT list_contains(own, x))) AS INTEGER) AS n_foreign FROM s JOIN o USING (document_id) WHERE len(said) > 0
    """,
}
