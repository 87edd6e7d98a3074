"""Parsing, chunking, answering and incremental queries."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.extract import article_ref
from granary.operators import audit, chunking, corpus, hierarchy, qa, retrieval
from granary.plans import sql as S
from granary.plans.queries_corpus import CHUNKS, CONTENT, META, _chunks, _meta
from granary.plans.queries_retrieval import TITLES, _titles
from granary.session import scratch_path, table, written
from granary.streaming import incremental


def _acts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_content").select("id", "content", "crawled_at")
    c = corpus.latest_of_few(c, "id", [F.col("crawled_at").desc_nulls_last(), corpus.row_hash(c)])
    return c.select("id", "content").join(_meta(spark, d).select("id", "title", F.col("document_number").alias("number")), "id", "left")


def tree_nodes_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Every node below a document's own: where it begins, its type and number, and whether it has a title."""
    n = hierarchy.parse_documents(_acts(spark, d), "id", "content")
    return n.filter("node_seq > 0").select("id", F.col("line_start").alias("line"), "node_type", "number", (F.col("title") != "").alias("titled"), "depth")


def tree_blocks_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Tables and headings of the parsed acts and the node they stand in."""
    n = hierarchy.parse_documents(_acts(spark, d), "id", "content")
    b = n.select("id", "node_type", F.explode("blocks").alias("b")).filter("b.type in ('table', 'heading')")
    return b.select("id", F.col("b.line_start").alias("line"), "node_type", F.col("b.type").alias("block_type"), F.md5("b.text").alias("digest"))


def tree_audit(spark: SparkSession, d: str) -> DataFrame:
    """Heading lines of the texts against the nodes parsed from them, by type: lines, nodes, documents in which they differ."""
    acts = _acts(spark, d)
    n = hierarchy.parse_documents(acts, "id", "content")
    return audit.raw_against_tree(acts, n, "id", "content")


def tree_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_documents(_acts(spark, d), "id", "content", budget=400, overlap=50)


def marked_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.marked_pieces(table(spark, d, "documents"), "doc_id", "text", 200, 30)


def sentence_pack(spark: SparkSession, d: str) -> DataFrame:
    return chunking.sentence_pieces(table(spark, d, "documents"), "doc_id", "text", 200, 30)


def _hits(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    c = _chunks(spark, d).select(F.col("chunk_id").alias("id"), "document_id", "article_no", "text")
    top = written(retrieval.bm25_top_k(c.select("id", "text"), _titles(spark, d), k), "hits")
    m = _meta(spark, d).select(F.col("id").alias("document_id"), F.col("document_number").alias("number"), "title")
    return top.join(c, "id").join(m, "document_id").withColumnRenamed("article_no", "article")


def chunk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return h.select("qid", "id", "score", "rank", article_ref("number", "title", "article").alias("ref"))


def qa_contexts(spark: SparkSession, d: str) -> DataFrame:
    r = qa.context_rows(written(_hits(spark, d), "answer-hits"))
    return r.select("qid", F.array_join("relevant_articles", "\n").alias("articles"), F.array_join("allowed_articles", ";").alias("allowed"), F.size("contexts").alias("n_contexts"), qa.fallback_answer(F.col("allowed_articles")).alias("answer"))


def answer_validate(spark: SparkSession, d: str) -> DataFrame:
    """Each document's articles against those its acts' chunks hold under the same number modulo."""
    a = table(spark, d, "documents").select("doc_id", "text")
    allowed = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 40 + 1).cast("int")), lambda i: F.concat(F.lit("Điều "), i.cast("string")))
    return a.select("doc_id", F.array_join(qa.disallowed_articles(F.col("text"), allowed), ";").alias("disallowed"), qa.needs_repair(F.col("text"), allowed).alias("again"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Document rows read as a stream, one per text, written incrementally and read back."""
    path = os.path.join(d, "documents.parquet")
    schema = spark.read.parquet(path).schema
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    folder = path if os.path.isdir(path) else d
    src = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else "documents.parquet").parquet(folder)
    q = incremental.ingest(src, out, state, "doc_id", lambda df: df.select("doc_id", "source", "n_chars"), order="n_chars")
    q.awaitTermination()
    return spark.read.parquet(out).drop("run", "batch")


QUERIES = {f.__name__: f for f in (tree_nodes_parsed, tree_blocks_parsed, tree_audit, tree_chunks, marked_pieces, sentence_pack, chunk_retrieval, qa_contexts, answer_validate, stream_ingest)}

_HITS = S.bm25("SELECT chunk_id AS id, text FROM c", TITLES, 5)
_REF = f"CASE WHEN {S.squeeze('m.document_number')} = '' OR {S.squeeze('m.title')} = '' OR {S.squeeze('c.article_no')} = '' THEN '' ELSE {S.squeeze('m.document_number')} || '|' || {S.squeeze('m.title')} || '|' || {S.squeeze('c.article_no')} END"
_ARTICLES = "list_transform(regexp_extract_all(coalesce(text, ''), '(?i)Điều\\s+([0-9]+(?:\\.[0-9A-Za-zĐđ]+)*)', 1), lambda x: 'Điều ' || x)"
_ALLOWED = "list_transform(range(1, doc_id % 40 + 2), lambda i: 'Điều ' || CAST(i AS VARCHAR))"

# The parse told anew as a recursion over line numbers: every step takes the next line of each document.
_SIDE = "[\\p{L}\\p{N}_]"
_BIG = "A-Z" + hierarchy.MARKED.upper()
_LETTERS = "regexp_replace(x, '\\P{L}', '', 'g')"
_TITLE = f"(length(x) BETWEEN 1 AND 260 AND NOT regexp_matches(x, '[.;,]$') AND {_LETTERS} <> '' AND (len(list_filter(string_split({_LETTERS}, ''), lambda c: upper(c) = c)) > 0.72 * length({_LETTERS}) OR regexp_matches(x, '[{_BIG}]{{3,}}')))"
_ATTACHED = "regexp_matches(lower(x), '" + "|".join(hierarchy.ATTACHED) + "')"
_HEADS = {
    "part": "^(?:Phần|PHẦN) +([IVXLCDM\\p{Nd}]+)[.:]? *(.*)$", "chapter": "^(?:Chương|CHƯƠNG) +([IVXLCDM\\p{Nd}]+)[.:]? *(.*)$", "section": "^(?:Mục|MỤC) +(\\p{Nd}+[A-Za-z]?)[.]? *(.*)$",
    "subsection": "^(?:Tiểu mục|TIỂU MỤC) +(\\p{Nd}+[A-Za-z]?)[.]? *(.*)$", "article": "^(?:Điều|ĐIỀU) +(\\p{Nd}+[A-Za-z]?)[.]? *(.*)$", "appendix": "^(?:Phụ lục|PHỤ LỤC)(?: +([IVXLCDM\\p{Nd}]+))?[.:]? *(.*)$",
    "list": f"^(?:Danh mục|DANH MỤC|Mẫu số|MẪU SỐ)($|[^\\p{{L}}\\p{{N}}_].*$)", "form": "^((?:[bB][mM] ?\\p{Nd}+[A-Za-z]?)|(?:(?i)mẫu số ?:? ?[\\p{L}\\p{N}_./-]+))$",
    "appendix_section": f"^([A-Z]|[IVXLCDM]+)[.] +([{_BIG}].+)$", "clause": "^(\\p{Nd}+)[.] +(.+)$", "point": "^([A-Za-zđĐ])[)] +(.+)$", "subpoint": "^([-–•]) +(.+)$",
}
_NEEDS = {"list": "NOT list_contains(chain, 'article')", "appendix_section": "list_contains(chain, 'appendix')", "clause": "list_contains(chain, 'article')", "point": "list_has_any(chain, ['article', 'clause'])", "subpoint": "list_has_any(chain, ['point', 'clause'])"}
_CASES = " ".join(f"WHEN m_{k}{' AND ' + _NEEDS[k] if k in _NEEDS else ''} THEN '{k}'" for k in _HEADS)
_PARENTS = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in sorted(v))}]" for k, v in hierarchy.PARENTS.items())


def _closing(word: str) -> str:
    """A closing word and a change between sign and no sign of a word after it."""
    after = _SIDE if word[-1] == "." else f"($|[^{_SIDE[1:-1]}])"
    return f"regexp_matches(lower(x), '^{word.lower().replace('.', '[.]')}{after}')"


_LATE = " OR ".join(map(_closing, hierarchy.CLOSINGS))
_WORDS = "|".join(w.lower() for w in hierarchy.SUBSTANTIVE)
_LINES = f"""
    SELECT id, n, x, x = '' AS blank, length(x) > 1 AND x[1] = '|' AND x[-1] = '|' AS is_row, {_TITLE} AS title_like, regexp_matches(x, '{_HEADS['list']}') AS list_like, ({_LATE}) AS closing, starts_with(lower(x), 'nơi nhận') AS recipients,
           NOT {_ATTACHED} AND regexp_matches(lower(x), '(?:^|[^{_SIDE[1:-1]}])(?:{_WORDS})(?:$|[^{_SIDE[1:-1]}])') AS substantive, {_ATTACHED} AS attached, {', '.join(f"regexp_matches(x, '{p}') AS m_{k}" for k, p in _HEADS.items())}
    FROM (SELECT id, generate_subscripts(p, 1) AS n, trim(regexp_replace(unnest(p), '[ \\t\\r\\f\\x0B\\x{{A0}}]+', ' ', 'g'), ' ') AS x
          FROM (SELECT id, string_split_regex(content, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS p FROM ({CONTENT}) WHERE content IS NOT NULL))
"""
_WALK = f"""
    WITH RECURSIVE l AS MATERIALIZED ({_LINES}),
    w AS (SELECT id, 0 AS n, ['document'] AS chain, true AS has_title, false AS structured, NULL::VARCHAR AS opened, NULL::VARCHAR AS did FROM (SELECT DISTINCT id FROM l)
        UNION ALL
        SELECT id, n, CASE WHEN opened IS NULL THEN chain WHEN opened = 'footer' THEN ['document', 'footer'] ELSE list_append(chain[:greatest(1, coalesce(list_max(list_filter(range(1, len(chain) + 1), lambda i: list_contains(CASE opened {_PARENTS} END, chain[i]))), 1))], opened) END,
               CASE WHEN did = 'absorb' THEN true WHEN opened IS NULL THEN has_title ELSE titled END, structured OR coalesce(opened <> 'footer', false), opened, did
        FROM (SELECT id, n, chain, has_title, structured, titled, did, CASE did WHEN 'list' THEN 'appendix' WHEN 'form' THEN 'appendix' WHEN 'recover' THEN 'appendix' WHEN 'absorb' THEN NULL WHEN 'heading' THEN NULL WHEN 'text' THEN NULL ELSE did END AS opened
              FROM (SELECT w.id, l.n, chain, has_title, structured, CASE WHEN m_list AND NOT list_contains(chain, 'article') THEN trim(regexp_extract(x, '{_HEADS['list']}', 1)) <> '' {' '.join(f"WHEN m_{k} THEN trim(regexp_extract(x, '{_HEADS[k]}', 2)) <> ''" for k in ('part', 'chapter', 'section', 'subsection', 'article', 'appendix', 'appendix_section'))} ELSE false END AS titled,
                    CASE WHEN blank THEN 'text' WHEN is_row THEN CASE WHEN chain[-1] = 'footer' AND substantive THEN 'recover' ELSE 'text' END {_CASES}
                         WHEN chain[-1] IN ('part', 'chapter', 'appendix') AND NOT has_title AND title_like THEN 'absorb' WHEN list_like THEN 'heading'
                         WHEN closing AND (recipients OR l.n > {hierarchy.SIGNATURES_FROM} AND structured) THEN 'footer' WHEN title_like AND chain[-1] IN ('appendix', 'document') THEN 'heading' ELSE 'text' END AS did
                    FROM w JOIN l ON l.id = w.id AND l.n = w.n + 1)))
"""
_RAW = ", ".join(f"count(*) FILTER (m_{k} AND NOT is_row) AS {k}" for k in audit.TYPES)

ORACLE_SQL = {
    "tree_nodes_parsed": f"""
        {_WALK}
        SELECT w.id, CAST(w.n AS INTEGER) AS line, opened AS node_type, CASE did WHEN 'form' THEN upper(x) {' '.join(f"WHEN '{k}' THEN {'lower' if k == 'point' else ''}(regexp_extract(x, '{_HEADS[k]}', 1))" for k in ('part', 'chapter', 'section', 'subsection', 'article', 'appendix', 'appendix_section', 'clause', 'point'))} ELSE '' END AS number,
               CASE WHEN did = 'recover' OR opened IN ('clause', 'point', 'subpoint', 'footer') THEN false ELSE has_title OR coalesce(next_did = 'absorb', false) END AS titled, CAST(len(chain) - 1 AS INTEGER) AS depth
        FROM (SELECT *, (SELECT min(did) FROM w v WHERE v.id = w.id AND v.did = 'absorb' AND v.n > w.n AND v.n < coalesce((SELECT min(u.n) FROM w u WHERE u.id = w.id AND u.n > w.n AND u.opened IS NOT NULL), 1000000000)) AS next_did FROM w WHERE opened IS NOT NULL) w JOIN l ON l.id = w.id AND l.n = w.n
    """,
    "tree_blocks_parsed": f"""
        {_WALK},
        r AS (SELECT w.id, w.n, l.x, l.attached, w.chain[-1] AS node_type, did, opened, w.n - row_number() OVER (PARTITION BY w.id ORDER BY w.n) AS g FROM w JOIN l ON l.id = w.id AND l.n = w.n WHERE is_row),
        t AS (SELECT id, g, min(n) AS line, arg_max(node_type, n) AS node_type, string_agg(x, chr(10) ORDER BY n) AS text, bool_or(attached) AS attached FROM r GROUP BY id, g)
        SELECT id, CAST(line AS INTEGER) AS line, node_type, 'table' AS block_type, md5(text) AS digest FROM t WHERE NOT regexp_matches(lower(text), '{'|'.join(hierarchy.ATTACHED)}')
        UNION ALL SELECT w.id, CAST(w.n AS INTEGER), chain[-1], 'heading', md5(x) FROM w JOIN l ON l.id = w.id AND l.n = w.n WHERE did = 'heading'
    """,
    "tree_audit": f"""
        {_WALK},
        raw AS (UNPIVOT (SELECT id, {_RAW} FROM l GROUP BY id) ON {', '.join(audit.TYPES)} INTO NAME node_type VALUE n),
        tree AS (SELECT id, opened AS node_type, count(*) AS n FROM w WHERE opened IN ({', '.join(repr(k) for k in audit.TYPES)}) GROUP BY id, opened)
        SELECT raw.node_type, CAST(sum(raw.n) AS BIGINT) AS n_lines, CAST(sum(coalesce(tree.n, 0)) AS BIGINT) AS n_nodes, count(*) FILTER (raw.n <> coalesce(tree.n, 0)) AS n_differing FROM raw LEFT JOIN tree USING (id, node_type) GROUP BY raw.node_type
    """,
    "chunk_retrieval": f"""
        WITH c AS ({CHUNKS}), h AS (SELECT * FROM ({_HITS}))
        SELECT h.qid, h.id, h.score, h.rank, {_REF} AS ref FROM h JOIN c ON c.chunk_id = h.id JOIN ({META}) m ON m.id = c.document_id
    """,
    "answer_validate": f"""
        WITH x AS (SELECT doc_id, text, {_ARTICLES} AS a, {_ALLOWED} AS ok FROM documents), y AS (SELECT *, list_filter(a, lambda v, i: list_position(a, v) = i AND NOT list_contains(ok, v)) AS bad FROM x)
        SELECT doc_id, array_to_string(bad, ';') AS disallowed, {S.squeeze('text')} = '' OR len(bad) > 0 OR NOT list_has_any(a, ok) AS again FROM y
    """,
    "qa_contexts": f"""
        WITH c AS ({CHUNKS}), h AS (SELECT * FROM ({_HITS})), j AS (SELECT h.qid, h.rank, c.text, {_REF} AS ref FROM h JOIN c ON c.chunk_id = h.id JOIN ({META}) m ON m.id = c.document_id),
        r AS (SELECT qid, ref, min(rank) AS p FROM j WHERE ref <> '' GROUP BY qid, ref), a AS (SELECT qid, string_agg(ref, chr(10) ORDER BY p, ref) AS articles, list(split_part(ref, '|', -1) ORDER BY p, ref) AS parts FROM r GROUP BY qid),
        w AS (SELECT qid, text, 6000 - coalesce(sum(length(text) + 4) OVER (PARTITION BY qid ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rem FROM j WHERE trim(text) <> ''),
        n AS (SELECT qid, count(*) AS n FROM w WHERE rem > 0 AND (length(text) <= rem OR rem >= 200) GROUP BY qid),
        x AS (SELECT q.qid, coalesce(articles, '') AS articles, coalesce(list_filter(parts, lambda v, i: list_position(parts, v) = i AND starts_with(v, 'Điều ')), []) AS ok, n FROM (SELECT DISTINCT qid FROM j) q LEFT JOIN a USING (qid) LEFT JOIN n USING (qid))
        SELECT qid, articles, array_to_string(ok, ';') AS allowed, CAST(coalesce(n, -1) AS INTEGER) AS n_contexts, CASE WHEN len(ok) > 0 THEN {S.q(qa.FALLBACK)} || array_to_string(ok, '; ') || '.' ELSE {S.q(qa.NOT_FOUND)} END AS answer FROM x
    """,
    "stream_ingest": "SELECT doc_id, source, n_chars FROM documents",
}
