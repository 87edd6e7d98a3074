"""Joins, upserts, segmentation and reports over the acts and their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T
from granary.operators import corpus, fusion, segments
from granary.plans import sql as S
from granary.session import table


def _meta(spark: SparkSession, d: str) -> DataFrame:
    """One row per act: the one crawled last, of equals by its text."""
    m = table(spark, d, "doc_metadata")
    return corpus.latest(m, ["id"], [F.col("crawled_at").desc_nulls_last(), F.col("ingested_at").desc_nulls_last(), corpus.row_hash(m)])


def _content(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_content")
    return corpus.latest_of_few(c, "id", [F.col("crawled_at").desc_nulls_last(), corpus.row_hash(c)])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return corpus.latest_of_few(c, "chunk_id", [F.col("created_at").desc_nulls_last(), corpus.row_hash(c)])


def metadata_enrich(spark: SparkSession, d: str) -> DataFrame:
    out = corpus.fill_status(_meta(spark, d), table(spark, d, "effect_metadata"))
    return out.select("id", "effect_status", T.first_filled("issuing_authority", "source_site").alias("origin"), T.joined_filled(" | ", "legal_type", "lang").alias("kind"))


def content_metadata_join(spark: SparkSession, d: str) -> DataFrame:
    j = _content(spark, d).select("id", "content").join(_meta(spark, d).select("id", "title", "source_site"), "id")
    return j.select("id", "title", "source_site", F.length("content").alias("n_chars"))


def allowlist_semi(spark: SparkSession, d: str) -> DataFrame:
    return _meta(spark, d).join(table(spark, d, "effect_metadata").filter("effect_status is not null"), "id", "left_semi").select("id", "title")


def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "tree_nodes").select(F.col("document_id").alias("id")).distinct()
    return _content(spark, d).join(done, "id", "left_anti").select("id", "source_site")


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_content").select("id").distinct().join(table(spark, d, "doc_metadata"), "id", "left_anti")


def merge_upsert(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "doc_metadata").groupBy("id").agg(F.max("effect_status").alias("effect_status"))
    e = table(spark, d, "effect_metadata").filter("effect_status is not null").groupBy("id").agg(F.max("effect_status").alias("effect_status"))
    return corpus.upsert(m, e, ["id"])


def checkpoint_match(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "doc_metadata").groupBy("id").agg(F.max("effect_status").alias("effect_status"))
    e = table(spark, d, "effect_metadata").groupBy("id").agg(F.max("effect_status").alias("effect_status"))
    return corpus.matches_stored(m, e, "id", ["effect_status"])


def dup_ordinal(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return corpus.occurrence(docs, F.md5(F.concat_ws("|", "source", T.squeeze("text"))), [F.col("doc_id")]).select("doc_id", F.col("occurrence").cast("int").alias("occurrence"))


def title_map(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select(F.split_part("document_number", F.lit("/"), F.lit(3)).alias("sign"), "title", "id")
    return corpus.title_map(m, "sign", "title", F.contains(F.lower("title"), F.lit("quy định")), ["id"])


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    one = c.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(T.squeeze("text") == "").alias("n_empty"), F.count_if(F.length("text") > 3000).alias("n_long"), F.max("chunk_count").alias("max_chunk_count"),
        F.count_if(F.col("heading").isNull()).alias("n_no_heading"), F.sum(F.length("text")).alias("n_chars"), F.max(F.length("text")).alias("max_chars"),
    )
    dup = c.groupBy("chunk_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_repeated_ids"))
    return one.join(F.broadcast(dup))


def method_report(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("chunk_method").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("n_documents"), F.round(F.avg(F.length("text")), 4).alias("avg_chars"))


def dataset_profile(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    return corpus.counts_by(m, {"legal_type": F.lower("legal_type"), "year": X.last_year("issuance_date"), "authority": F.col("issuing_authority"), "status": F.col("effect_status"), "site": F.col("source_site")}, F.coalesce(X.last_year("issuance_date") >= 2030, F.lit(False)))


def _size_band(n: Column) -> Column:
    return F.when(n < 2000, "under 2k").when(n < 10_000, "2k to 10k").when(n < 50_000, "10k to 50k").otherwise("50k and more")


def content_scan_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.coalesce("content", F.lit("")))
    c = _content(spark, d).select("source_site", n.alias("n"))
    return c.groupBy("source_site", _size_band(F.col("n")).alias("band")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_chars"), F.max("n").alias("max_chars"), F.sum(F.greatest(F.lit(1), F.ceil(F.col("n") / 1600))).alias("n_pieces"))


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return segments.word_windows(docs, "doc_id", "text", 108, 27).select("doc_id", "piece_no", F.md5("piece").alias("digest"), "n_words")


def heading_segments(spark: SparkSession, d: str) -> DataFrame:
    c = _content(spark, d).select("id", "content")
    return segments.heading_segments(c, "id", "content").select("id", "segment_no", "heading", "article_no", F.md5("segment").alias("digest"))


def table_groups(spark: SparkSession, d: str) -> DataFrame:
    return segments.table_groups(_content(spark, d).select("id", "content"), "id", "content")


def chunk_reindex(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("document_id")
    c = _chunks(spark, d).filter("article_no is not null")
    n = F.row_number().over(w.orderBy("chunk_index", "chunk_id")) - 1
    return c.select("chunk_id", n.cast("int").alias("new_index"), F.count(F.lit(1)).over(w).alias("new_count"))


def context_budget(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).select("document_id", "chunk_index", "chunk_id", "text")
    out = fusion.running_budget(c, "document_id", [F.col("chunk_index"), F.col("chunk_id")], "text", 4000)
    return out.select("document_id", "chunk_id", "remaining", F.md5("context").alias("digest"))


def references_ordered(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).select("document_id", "chunk_index", "article_no")
    m = _meta(spark, d).select(F.col("id").alias("document_id"), "document_number", "title")
    j = c.join(m, "document_id")
    return fusion.ordered_refs(j, "document_id", X.article_ref("document_number", "title", "article_no"), "chunk_index").select("document_id", F.array_join("refs", "\n").alias("refs"))


def tree_stats(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "tree_nodes")
    return n.groupBy("document_id", "node_type").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.size("blocks")).alias("n_blocks"), F.sum(F.size(F.filter("blocks", lambda b: b["type"] == "table"))).alias("n_tables"), F.max(F.size("path")).alias("depth"))


def table_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "tree_nodes").select("node_id", F.posexplode("blocks").alias("pos", "b")).filter("b.type = 'table'")
    return b.select("node_id", (F.col("pos") + 1).alias("pos"), segments.table_markdown(F.col("b.headers"), F.col("b.rows")).alias("markdown"), F.size("b.rows").alias("n_rows"))


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang")
    return corpus.stratified(docs, F.concat_ws("/", "source", F.lower(F.coalesce("lang", F.lit("none")))), [F.col("doc_id")], 3).select("doc_id", "bucket", F.col("n_in_bucket").cast("int").alias("n_in_bucket"))


QUERIES = {f.__name__: f for f in (metadata_enrich, content_metadata_join, allowlist_semi, resume_antijoin, missing_ids, merge_upsert, checkpoint_match, dup_ordinal, title_map, quality_report, method_report, dataset_profile, content_scan_stats, word_windows, heading_segments, table_groups, chunk_reindex, context_budget, references_ordered, tree_stats, table_blocks, stratified_sample)}

META = "SELECT * FROM doc_metadata QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST, ingested_at DESC NULLS LAST) = 1"
CONTENT = "SELECT * FROM doc_content QUALIFY row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST) = 1"
CHUNKS = "SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST) = 1"
_BOTH = "(SELECT id, max(effect_status) AS s FROM doc_metadata GROUP BY id) m"
_WORDS = f"string_split({S.squeeze('text')}, ' ')"
_LAST_YEAR = "(CASE WHEN TRY_CAST(list_extract(regexp_extract_all(coalesce(issuance_date, ''), '(\\d{4})', 1), -1) AS INTEGER) BETWEEN 1800 AND 2100 THEN TRY_CAST(list_extract(regexp_extract_all(coalesce(issuance_date, ''), '(\\d{4})', 1), -1) AS INTEGER) END)"


def _profile(name: str, x: str) -> str:
    s = S.squeeze(f"CAST({x} AS VARCHAR)")
    return f"SELECT '{name}' AS dimension, CASE WHEN {s} = '' THEN 'unknown' ELSE {s} END AS value, coalesce({_LAST_YEAR} >= 2030, false) AS k FROM m"


_HEADING = "^\\s*(?:<[^<>]{1,40}>|[#=>*]+|\\\\\\w+\\{)*\\s*(?:Điều|Article)\\s+\\d+"

ORACLE_SQL = {
    "metadata_enrich": f"""
        WITH e AS (SELECT id, max(effect_status) AS s FROM effect_metadata WHERE {S.squeeze('effect_status')} <> '' GROUP BY id)
        SELECT m.id, CASE WHEN {S.squeeze('m.effect_status')} <> '' THEN {S.squeeze('m.effect_status')} WHEN e.s IS NULL THEN '' ELSE {S.squeeze('e.s')} END AS effect_status,
               CASE WHEN {S.squeeze('issuing_authority')} <> '' THEN issuing_authority WHEN {S.squeeze('source_site')} <> '' THEN source_site END AS origin,
               concat_ws(' | ', CASE WHEN {S.squeeze('legal_type')} <> '' THEN {S.squeeze('legal_type')} END, CASE WHEN {S.squeeze('lang')} <> '' THEN {S.squeeze('lang')} END) AS kind
        FROM ({META}) m LEFT JOIN e USING (id)
    """,
    "content_metadata_join": f"SELECT id, m.title, m.source_site, CAST(length(c.content) AS INTEGER) AS n_chars FROM ({CONTENT}) c JOIN ({META}) m USING (id)",
    "allowlist_semi": f"SELECT id, title FROM ({META}) WHERE id IN (SELECT id FROM effect_metadata WHERE effect_status IS NOT NULL)",
    "resume_antijoin": f"SELECT id, source_site FROM ({CONTENT}) WHERE id NOT IN (SELECT document_id FROM tree_nodes)",
    "missing_ids": "SELECT DISTINCT id FROM doc_content WHERE id NOT IN (SELECT id FROM doc_metadata)",
    "merge_upsert": f"SELECT id, coalesce(e.s, m.s) AS effect_status FROM {_BOTH} FULL JOIN (SELECT id, max(effect_status) AS s FROM effect_metadata WHERE effect_status IS NOT NULL GROUP BY id) e USING (id)",
    "checkpoint_match": f"SELECT id, coalesce(m.s = e.s, false) AS matches FROM {_BOTH} JOIN (SELECT id, max(effect_status) AS s FROM effect_metadata GROUP BY id) e USING (id)",
    "dup_ordinal": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY md5(concat_ws('|', source, {S.squeeze('text')})) ORDER BY doc_id) - 1 AS INTEGER) AS occurrence FROM documents",
    "title_map": f"""
        WITH r AS (SELECT split_part(document_number, '/', 3) AS sign, {S.squeeze('title')} AS t, contains(lower(title), 'quy định') AS named, id FROM ({META}) WHERE {S.squeeze("split_part(document_number, '/', 3)")} <> '' AND {S.squeeze('title')} <> ''),
        g AS (SELECT sign, arg_min(t, id) AS f, arg_min(t, (-length(t), id)) FILTER (named) AS b FROM r GROUP BY sign)
        SELECT sign, CASE WHEN length(b) > length(f) THEN b ELSE f END AS title FROM g
    """,
    "quality_report": f"""
        SELECT count(*) AS n_rows, count(*) FILTER ({S.squeeze('text')} = '') AS n_empty, count(*) FILTER (length(text) > 3000) AS n_long, max(chunk_count) AS max_chunk_count, count(*) FILTER (heading IS NULL) AS n_no_heading,
               CAST(sum(length(text)) AS BIGINT) AS n_chars, max(length(text)) AS max_chars, (SELECT count(*) FROM (SELECT chunk_id FROM chunks GROUP BY chunk_id HAVING count(*) > 1)) AS n_repeated_ids FROM chunks
    """,
    "method_report": "SELECT chunk_method, count(*) AS n, count(DISTINCT document_id) AS n_documents, round(avg(length(text)), 4) AS avg_chars FROM chunks GROUP BY chunk_method",
    "dataset_profile": f"""
        WITH m AS ({META}), x AS ({_profile('legal_type', 'lower(legal_type)')} UNION ALL {_profile('year', _LAST_YEAR)} UNION ALL {_profile('authority', 'issuing_authority')}
            UNION ALL {_profile('status', 'effect_status')} UNION ALL {_profile('site', 'source_site')})
        SELECT dimension, value, count(*) AS n_all, count(*) FILTER (k) AS n_kept FROM x GROUP BY dimension, value
    """,
    "content_scan_stats": f"""
        WITH c AS (SELECT source_site, length(coalesce(content, '')) AS n FROM ({CONTENT}))
        SELECT source_site, CASE WHEN n < 2000 THEN 'under 2k' WHEN n < 10000 THEN '2k to 10k' WHEN n < 50000 THEN '10k to 50k' ELSE '50k and more' END AS band, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_chars, max(n) AS max_chars,
               CAST(sum(greatest(1, ceil(n / 1600))) AS BIGINT) AS n_pieces FROM c GROUP BY ALL
    """,
    "word_windows": f"""
        WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE {S.squeeze('text')} <> ''),
        s AS (SELECT doc_id, w, unnest(range(0, CASE WHEN len(w) <= 80 THEN 1 ELSE CAST(ceil((len(w) - 80) / 60.0) AS BIGINT) + 1 END)) AS i FROM w)
        SELECT doc_id, CAST(i + 1 AS INTEGER) AS piece_no, md5(array_to_string(w[i * 60 + 1:i * 60 + 80], ' ')) AS digest, CAST(len(w[i * 60 + 1:i * 60 + 80]) AS INTEGER) AS n_words FROM s
    """,
    "heading_segments": f"""
        WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM ({CONTENT}) WHERE content IS NOT NULL),
        h AS (SELECT *, regexp_matches(line, '{_HEADING}') AS head FROM l), g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY id ORDER BY n) AS segment_no FROM h),
        a AS (SELECT id, segment_no, string_agg(line, chr(10) ORDER BY n) AS segment, min(line) FILTER (head) AS heading FROM g GROUP BY id, segment_no)
        SELECT id, CAST(segment_no AS INTEGER) AS segment_no, {S.squeeze('heading')} AS heading, regexp_extract({S.squeeze('heading')}, '((?:Điều|Article)\\s+\\d+[A-Za-z]?)', 1) AS article_no, md5(segment) AS digest
        FROM a WHERE {S.squeeze('segment')} <> ''
    """,
    "table_groups": f"""
        WITH l AS (SELECT id, unnest(string_split(content, chr(10))) AS line, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n FROM ({CONTENT}) WHERE content IS NOT NULL),
        t AS (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS g FROM l WHERE regexp_matches({S.squeeze('line')}, '^\\|.*\\|$') AND length({S.squeeze('line')}) > 1)
        SELECT id, CAST(min(n) AS INTEGER) AS line_start, CAST(max(n) AS INTEGER) AS line_end, CAST(count(*) AS INTEGER) AS n_lines FROM t GROUP BY id, g
    """,
    "chunk_reindex": f"SELECT chunk_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) - 1 AS INTEGER) AS new_index, count(*) OVER (PARTITION BY document_id) AS new_count FROM ({CHUNKS}) WHERE article_no IS NOT NULL",
    "context_budget": f"""
        WITH c AS (SELECT document_id, chunk_id, text, 4000 - coalesce(sum(length(text) + 4) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining FROM ({CHUNKS}) WHERE trim(text) <> '')
        SELECT document_id, chunk_id, CAST(remaining AS BIGINT) AS remaining, md5(rtrim(text[1:remaining], ' ')) AS digest FROM c WHERE remaining > 0 AND (length(text) <= remaining OR remaining >= 200)
    """,
    "references_ordered": f"""
        WITH r AS (SELECT document_id, {S.squeeze('document_number')} || '|' || {S.squeeze('title')} || '|' || {S.squeeze('article_no')} AS ref, min(chunk_index) AS p FROM ({CHUNKS}) c JOIN ({META}) m ON m.id = c.document_id
            WHERE {S.squeeze('document_number')} <> '' AND {S.squeeze('title')} <> '' AND {S.squeeze('article_no')} <> '' GROUP BY ALL)
        SELECT document_id, string_agg(ref, chr(10) ORDER BY p, ref) AS refs FROM r GROUP BY document_id
    """,
    "tree_stats": "SELECT document_id, node_type, count(*) AS n_nodes, CAST(sum(len(blocks)) AS BIGINT) AS n_blocks, CAST(sum(len(list_filter(blocks, lambda b: b.type = 'table'))) AS BIGINT) AS n_tables, CAST(max(len(path)) AS INTEGER) AS depth FROM tree_nodes GROUP BY ALL",
    "table_blocks": """
        WITH b AS (SELECT node_id, unnest(range(1, len(blocks) + 1)) AS pos, unnest(blocks) AS b FROM tree_nodes), t AS (SELECT node_id, pos, b.headers AS h, b.rows AS r FROM b WHERE b.type = 'table')
        SELECT node_id, CAST(pos AS INTEGER) AS pos, CAST(len(r) AS INTEGER) AS n_rows, CASE WHEN len(h) = 0 THEN array_to_string(list_transform(r, lambda x: '| ' || array_to_string(x, ' | ') || ' |'), chr(10)) ELSE array_to_string(list_concat(['| ' || array_to_string(h, ' | ') || ' |', '| ' || array_to_string(list_transform(h, lambda x: '---'), ' | ') || ' |'],
            list_transform(r, lambda x: '| ' || array_to_string(list_transform(range(1, len(h) + 1), lambda i: coalesce(x[i], '')), ' | ') || ' |')), chr(10)) END AS markdown FROM t
    """,
    "stratified_sample": "SELECT doc_id, bucket, CAST(n AS INTEGER) AS n_in_bucket FROM (SELECT doc_id, source || '/' || lower(coalesce(lang, 'none')) AS bucket, row_number() OVER (PARTITION BY source || '/' || lower(coalesce(lang, 'none')) ORDER BY doc_id) AS n FROM documents) WHERE n <= 3",
}
