"""Queries over titles, references, selection and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T
from granary.functions import titles as TT
from granary.operators import corpus, retrieval, selection
from granary.plans import sql as S
from granary.plans.queries_corpus import CHUNKS, META, _chunks, _meta
from granary.plans.queries_retrieval import TITLES, _dense_sql, _titles, _vectors
from granary.session import table, written

NEW_WORDS, OLD_WORDS = ["chứng từ", "bản vẽ", "thuế", "trường học"], ["thuế"]


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Acts, every third as a consolidated text of its own year."""
    m = _meta(spark, d).select("id", "title", "document_number", "issuance_date")
    third = F.col("id") % 3 == 0
    year = F.format_string("năm %d", F.lit(2010) + F.col("id") % 7)
    title = F.when(third, F.concat(F.lit("Văn bản hợp nhất "), year, F.lit(" do Chính phủ ban hành "), "title")).otherwise(F.col("title"))
    return m.select("id", title.alias("title"), F.when(third, F.concat((F.col("id") % 90).cast("string"), F.lit("/VBHN-BTC"))).otherwise(F.col("document_number")).alias("number"), F.when(~third, F.col("issuance_date")).alias("issued"))


def dedup_acts(spark: SparkSession, d: str) -> DataFrame:
    v = written(_versions(spark, d), "versions")
    hits = retrieval.bm25_top_k(v.select("id", F.col("title").alias("text")), _titles(spark, d), 30).join(v, "id")
    out = selection.one_per_document(hits.withColumn("article", F.lit("")), "number", "title", "article", TT.one_list("issued"))
    return out.select("qid", "id", "rank", "position", F.col("rank_out").cast("int").alias("rank_out"), F.md5("key").alias("key"))


def payload_refs(spark: SparkSession, d: str) -> DataFrame:
    """Numbers, header, title and article that chunks give in several ways."""
    c = _chunks(spark, d).join(_meta(spark, d).select(F.col("id").alias("document_id"), "document_number", "title"), "document_id", "left")
    old = F.regexp_replace("document_number", "NĐ-CP", "nd-cp")
    known = TT.numbers(F.array("document_number", old, F.lit(" 5/2020/qd-ttg "), F.lit("")))
    text = F.concat_ws("", F.coalesce("document_number", F.lit("")), F.lit(" "), "heading", F.lit(":\n"), "text")
    head = TT.header(text)
    art = TT.first_article(TT.one_list("article_no", "heading"))
    return c.select(
        "chunk_id", F.array_join(known, ";").alias("numbers"), F.md5(head).alias("head"), F.md5(TT.header_title(head, art)).alias("head_title"), TT.first_number_in(head, known).alias("number"), art.alias("article"),
        TT.bare_article("article_no").alias("bare"), F.md5(TT.reasonable_title(TT.one_list("heading", "title"))).alias("title"), TT.chunk_key("document_id", "chunk_id", "chunk_id", F.lit("")).alias("key"), F.md5(TT.shortened("text", 80)).alias("short"),
    )


def valid_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Of each act's chunks with a number and a usable title (their heading) the first five, ranked anew."""
    c = _chunks(spark, d).join(_meta(spark, d).select(F.col("id").alias("document_id"), "document_number"), "document_id")
    w = c.select(F.col("document_id").alias("qid"), F.col("chunk_id").alias("id"), F.col("chunk_index").alias("rank"), "document_number", "heading")
    out = selection.valid_only(w, "qid", F.col("document_number"), F.col("heading"), 5)
    return out.select("qid", "id", F.col("old_rank").cast("int").alias("old_rank"), F.col("rank").cast("int").alias("rank"))


def query_decompose(spark: SparkSession, d: str) -> DataFrame:
    """Titles planned by their tokens and taken apart by answers of three forms."""
    m = _meta(spark, d).select(F.col("id").alias("qid"), F.coalesce("title", F.lit("")).alias("text"))
    q = m.withColumn("n", selection.n_sub_queries(T.token_estimate("text"), 18, 26))
    form = F.col("qid") % 4
    plain = F.regexp_replace("text", r"[\"\\\x00-\x1f]", " ")
    answer = F.when(form == 0, F.concat(F.lit("Đây: [\""), plain, F.lit("\", \"thủ tục\"] xong"))).when(form == 1, F.concat(F.lit("- điều kiện để được cấp\n\n- hồ sơ phải nộp\n- ngắn\n- thời hạn giải quyết"))).when(form == 2, F.lit("không rõ"))
    known = m.filter("qid % 5 = 0").select(F.col("qid").cast("string").alias("qid"), F.array(F.lit("một"), F.lit(" "), F.lit("hai")).alias("sub_queries"))
    return selection.sub_queries(q, m.select("qid", answer.alias("answer")), known).select("qid", F.col("pos").cast("int").alias("pos"), F.md5("text").alias("text"))


def candidate_select(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of a stored pool by a selector's answers, of which some can't be read."""
    pool = written(retrieval.dense_top_k(*_vectors(spark, d), 8), "pool")
    form = F.col("qid") % 4
    answer = F.when(form == 0, F.lit("Chọn {\"selected\": [3, \"1\", 99, 3]} nhé")).when(form == 1, F.lit("[8, 2, 0]")).when(form == 2, F.lit("{\"answerable\": false}")).otherwise(F.lit("không"))
    chosen = pool.select("qid").distinct().select("qid", answer.alias("answer"))
    return selection.select_candidates(pool, chosen, 2).select("qid", "id", "score", "rank", "rank_out")


def branch_expand(spark: SparkSession, d: str) -> DataFrame:
    """Filters for each act: numbers in turn from its authority's and its site's acts, then topics."""
    m = _meta(spark, d).select("id", "document_number", "title", "source_site", "issuing_authority")
    x = m.select(F.col("id").alias("qid"), F.explode(F.array(F.struct(F.lit(1).alias("r"), F.col("document_number").alias("a"), F.col("source_site").alias("b")), F.struct(F.lit(2).alias("r"), F.col("source_site").alias("a"), F.col("issuing_authority").alias("b")))).alias("x"))
    ranked = x.select("qid", F.col("x.r").alias("domain_rank"), TT.text_list(F.array("x.a", "x.b", F.concat(F.lit("n"), F.col("x.r").cast("string")))).alias("numbers"), TT.text_list(F.array("x.b", "x.a")).alias("topics"))
    return selection.branches(ranked).select("qid", F.col("branch_no").cast("int").alias("branch_no"), "kind", "value")


def source_links(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d)
    made = F.to_json(F.array(F.struct(F.col("title").alias("text"), F.col("url").alias("href")), F.struct(F.lit(" ").alias("text"), F.lit(None).cast("string").alias("href"))))
    json = F.when(F.col("id") % 7 == 0, F.lit("{no json")).otherwise(made)
    links = TT.source_links(json)
    return m.select("id", F.size(links).alias("n_links"), F.md5(F.array_join(F.transform(links, lambda l: F.concat(l["text"], F.lit(">"), l["href"])), "\n")).alias("links"))


def canonical_articles(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with an article as records: id basis, repeats, name, note, and the better of two titles."""
    c = _chunks(spark, d).filter("article_no is not null")
    m = _meta(spark, d).select(F.col("id").alias("document_id"), "document_number", "title")
    sign = F.split_part("document_number", F.lit("/"), F.lit(3))
    named = corpus.title_map(m.select(sign.alias("sign"), F.concat_ws(" ", "document_number", "title").alias("t"), "document_id"), "sign", "t", F.lit(True), ["document_id"]).withColumnRenamed("title", "mapped")
    j = c.join(m, "document_id").withColumn("sign", sign).join(named, "sign", "left")
    basis = TT.article_basis(F.lit("#"), F.col("authority_code"), F.col("legal_type"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("heading"))
    j = corpus.occurrence(j, basis, [F.col("chunk_id")])
    note = F.concat_ws(" ", "heading", F.lit("(Điều này có nội dung liên quan đến Điều 5)"))
    full = TT.article_basis(F.lit("#"), F.col("authority_code"), F.col("legal_type"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("heading"), F.col("occurrence"))
    return j.select("chunk_id", X.short_hash(full, "art").alias("article_id"), TT.article_title("heading").alias("name"), F.md5(TT.without_related(note)).alias("note"), F.md5(TT.better_title(F.col("document_number"), F.col("mapped"), F.col("document_number"))).alias("title"))


def keyword_delta(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "tree_nodes").select(F.col("document_id").alias("id"))
    k = selection.keyword_delta(_meta(spark, d), F.concat_ws(" ", "title", "legal_sectors"), NEW_WORDS, OLD_WORDS, known)
    return k.select("id", "reason", F.array_join("hits", ";").alias("hits"), F.array_join("new_hits", ";").alias("new_hits"))


QUERIES = {f.__name__: f for f in (dedup_acts, payload_refs, valid_chunks, query_decompose, candidate_select, branch_expand, source_links, canonical_articles, keyword_delta)}

_VERSIONS = f"""SELECT id, CASE WHEN id % 3 = 0 THEN 'Văn bản hợp nhất năm ' || CAST(2010 + id % 7 AS VARCHAR) || ' do Chính phủ ban hành ' || title ELSE title END AS title,
    CASE WHEN id % 3 = 0 THEN CAST(id % 90 AS VARCHAR) || '/VBHN-BTC' ELSE document_number END AS number, CASE WHEN id % 3 <> 0 THEN issuance_date END AS issued FROM ({META})"""
_WORD = "[\\p{L}\\p{N}_]"
_CODE = "(^|[^\\p{L}\\p{N}_])[0-9]+\\s*/\\s*[A-Za-zĐđ][A-Za-zĐđ0-9/-]*"
_IN_DATE = "([0-9]{1,2}[/-][0-9]{1,2}[/-](?:19|20)[0-9]{2})"
_SUBJECT = S.dedup_key("regexp_replace(regexp_replace(regexp_replace(" + S.edges("substr(" + S.squeeze("title") + ", 17)") + ", '(?i)năm\\s+(?:19|20)[0-9]{2}', '', 'g'), '(?i)do\\s+.+?\\s+ban hành', '', 'g'), '(?i)của\\s+(?:văn phòng quốc hội|quốc hội|chính phủ)', '', 'g')")


def _keyed(c: str) -> str:
    return S.dedup_key(c)


_OLD = "regexp_replace(document_number, 'NĐ-CP', 'nd-cp', 'g')"
_FOLD = "regexp_replace(regexp_replace({0}, '(?i)ND-CP', 'NĐ-CP', 'g'), '(?i)QD-', 'QĐ-', 'g')"
_NUMBERS = f"list_filter(list_transform([coalesce(document_number, ''), coalesce({_OLD}, ''), ' 5/2020/qd-ttg '], lambda v: {_FOLD.format(S.squeeze('v'))}), lambda v: v <> '')"
_HEAD = "trim(coalesce(document_number, '') || ' ' || coalesce(heading, ''), ' ')"
_FIRST_ART = "coalesce(nullif(regexp_extract(coalesce(article_no, ''), '(?i)Điều\\s+[0-9]+[A-Za-z]?', 0), ''), regexp_extract(coalesce(heading, ''), '(?i)Điều\\s+[0-9]+[A-Za-z]?', 0))"
_SQ = S.squeeze("heading")
_PLAIN = "regexp_replace(text, '[\"\\\\\\x00-\\x1f]', ' ', 'g')"
_TOKENS = S.token_estimate("text")
_BASIS = f"'#|' || {S.squeeze('authority_code')} || '|' || {S.squeeze('legal_type')} || '|||' || {_SQ}"
_T = S.squeeze("concat_ws(' ', document_number, title)")

ORACLE_SQL = {
    "dedup_acts": f"""
        WITH v AS MATERIALIZED ({_VERSIONS}), h AS ({S.bm25('SELECT id, title AS text FROM v', TITLES, 30)}), j AS (SELECT h.*, v.title, v.number, v.issued, {_keyed('v.title')} AS t, {_keyed('v.number')} AS n, {_keyed('v.issued')} AS own FROM h JOIN v USING (id)),
        k AS (SELECT *, CASE WHEN own <> '' THEN own ELSE {S.dedup_key("regexp_extract(coalesce(title, ''), '" + _IN_DATE + "', 1)")} END AS d0 FROM j),
        x AS (SELECT *, CASE WHEN d0 <> '' THEN d0 ELSE lower(regexp_extract(coalesce(title, ''), '(?i)năm\\s+(?:19|20)[0-9]{{2}}', 0)) END AS d FROM k),
        y AS (SELECT *, CASE WHEN id % 3 = 0 AND title IS NOT NULL THEN 'subject|' || {_SUBJECT} WHEN t <> '' AND d <> '' THEN 'date|' || t || '|' || d WHEN t <> '' AND n <> '' THEN 'number|' || t || '|' || n WHEN t <> '' THEN 'title|' || t ELSE '' END AS doc FROM x),
        z AS (SELECT *, CASE WHEN doc = '' THEN 'point|' || CAST(id AS VARCHAR) ELSE 'doc|' || doc END AS key, CASE WHEN id % 3 = 0 THEN 2010 + id % 7 ELSE 0 END AS y FROM y),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid, key ORDER BY y DESC, score DESC, rank) AS n_, min(rank) OVER (PARTITION BY qid, key) AS position FROM z)
        SELECT qid, id, rank, position, CAST(row_number() OVER (PARTITION BY qid ORDER BY position) AS INTEGER) AS rank_out, md5(key) AS key FROM r WHERE n_ = 1
    """,
    "payload_refs": f"""
        WITH c AS (SELECT c.chunk_id, c.document_id, c.article_no, c.heading, c.text, m.document_number, m.title FROM ({CHUNKS}) c LEFT JOIN ({META}) m ON m.id = c.document_id),
        p AS (SELECT *, {_NUMBERS} AS all_n, {_HEAD} AS head, {_FIRST_ART} AS art FROM c), k AS (SELECT *, list_filter(all_n, lambda v, i: list_position(list_transform(all_n, lambda u: lower(u)), lower(v)) = i) AS known FROM p)
        SELECT chunk_id, array_to_string(known, ';') AS numbers, md5(head) AS head, md5(trim(CASE WHEN art <> '' AND regexp_matches(head, '(?is)^.*?\\s+Điều\\s+[0-9]') THEN regexp_extract(head, '(?is)^(.*?)\\s+Điều\\s+[0-9]+[A-Za-z]?', 1) ELSE head END, ' -:;,.')) AS head_title,
               coalesce(list_filter(known, lambda v: contains(head, v))[1], known[1], '') AS number, regexp_replace(art, '^điều', 'Điều') AS article, trim(regexp_replace(trim(coalesce(article_no, ''), ' '), '(?i)^điều ', '')) AS bare,
               md5(coalesce(list_filter(list_transform([trim(coalesce(heading, ''), ' '), trim(coalesce(title, ''), ' ')], lambda v: trim(v, '() ')), lambda v: length(v) > 12 AND NOT regexp_matches(v, '(?i)^Điều\\s+[0-9]+[A-Za-z]?$'))[1], '')) AS title,
               coalesce(CAST(document_id AS VARCHAR), '') || ':' || chunk_id AS key, md5(CASE WHEN length(trim(coalesce(text, ''), ' ')) <= 80 THEN trim(coalesce(text, ''), ' ') ELSE rtrim(trim(text, ' ')[1:77], ' ') || '...' END) AS short FROM k
    """,
    "valid_chunks": f"""
        WITH c AS (SELECT c.document_id AS qid, chunk_id AS id, chunk_index, lower(trim(coalesce(heading, ''), ' ')) AS h FROM ({CHUNKS}) c JOIN ({META}) m ON m.id = c.document_id WHERE trim(coalesce(document_number, ''), ' ') <> ''),
        r AS (SELECT qid, id, chunk_index AS old_rank, CAST(row_number() OVER (PARTITION BY qid ORDER BY chunk_index, id) AS INTEGER) AS rank FROM c WHERE trim(h, '-_ ') <> '' AND NOT starts_with(h, 'căn cứ') AND NOT starts_with(h, 'theo '))
        SELECT * FROM r WHERE rank <= 5
    """,
    "query_decompose": f"""
        WITH m AS (SELECT id AS qid, coalesce(title, '') AS text FROM ({META})), q AS (SELECT *, CASE WHEN {_TOKENS} < 18 THEN 1 WHEN {_TOKENS} < 26 THEN 2 ELSE 3 END AS n FROM m),
        p AS (SELECT qid, CASE WHEN qid % 5 = 0 THEN ['một', 'hai'] WHEN n = 1 OR qid % 4 >= 2 THEN [text]
                WHEN qid % 4 = 0 THEN list_filter([trim({_PLAIN}), 'thủ tục', text], lambda v, i: i <= n) ELSE list_filter(['điều kiện để được cấp', 'hồ sơ phải nộp', 'thời hạn giải quyết'], lambda v, i: i <= n) END AS parts FROM q)
        SELECT qid, CAST(unnest(range(len(parts))) AS INTEGER) AS pos, md5(unnest(parts)) AS text FROM p
    """,
    "candidate_select": f"""
        WITH h AS ({_dense_sql(8)})
        SELECT qid, id, score, rank, CAST(CASE WHEN qid % 4 = 0 THEN CASE rank WHEN 3 THEN 1 ELSE 2 END WHEN qid % 4 = 1 THEN CASE rank WHEN 8 THEN 1 ELSE 2 END ELSE rank END AS INTEGER) AS rank_out FROM h
        WHERE CASE WHEN qid % 4 = 0 THEN rank IN (3, 1) WHEN qid % 4 = 1 THEN rank IN (8, 2) ELSE rank <= 2 END
    """,
    "branch_expand": f"""
        WITH m AS ({META}), d AS (SELECT id AS qid, 1 AS r, document_number AS a, source_site AS b FROM m UNION ALL SELECT id, 2, source_site, issuing_authority FROM m),
        l AS (SELECT qid, r, list_filter(list_transform([a, b, 'n' || CAST(r AS VARCHAR)], lambda v: trim(v, ' ')), lambda v: v <> '') AS ns, list_filter(list_transform([b, a], lambda v: trim(v, ' ')), lambda v: v <> '') AS ts FROM d),
        n AS (SELECT qid, r, unnest(ns) AS value, generate_subscripts(ns, 1) AS i FROM l), t AS (SELECT qid, r, unnest(ts) AS value, generate_subscripts(ts, 1) AS i FROM l),
        nn AS (SELECT qid, 'number' AS kind, value, row_number() OVER (PARTITION BY qid ORDER BY min((i, r))) AS k FROM n GROUP BY qid, value), tt AS (SELECT qid, 'topic' AS kind, value, row_number() OVER (PARTITION BY qid ORDER BY min((r, i))) AS k FROM t GROUP BY qid, value),
        u AS (SELECT * FROM nn WHERE k <= 3 UNION ALL SELECT * FROM tt WHERE k <= 1)
        SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY kind, k) AS INTEGER) AS branch_no, kind, value FROM u
    """,
    "source_links": f"""
        SELECT id, CAST(CASE WHEN id % 7 = 0 OR (t = '' AND h = '') THEN 0 ELSE 1 END AS INTEGER) AS n_links, md5(CASE WHEN id % 7 = 0 OR (t = '' AND h = '') THEN '' ELSE t || '>' || h END) AS links
        FROM (SELECT id, {S.squeeze('title')} AS t, {S.squeeze('url')} AS h FROM ({META}))
    """,
    "canonical_articles": f"""
        WITH m AS (SELECT id AS document_id, document_number, title, split_part(document_number, '/', 3) AS sign, {_T} AS t FROM ({META})),
        g AS (SELECT sign, arg_min(t, document_id) AS f, arg_min(t, (-length(t), document_id)) AS b FROM m WHERE {S.squeeze('sign')} <> '' AND t <> '' GROUP BY sign), n AS (SELECT sign, CASE WHEN length(b) > length(f) THEN b ELSE f END AS mapped FROM g),
        j AS (SELECT c.chunk_id, c.heading, m.document_number, n.mapped, {_BASIS} AS basis FROM ({CHUNKS}) c JOIN m USING (document_id) LEFT JOIN n USING (sign) WHERE c.article_no IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY basis ORDER BY chunk_id) - 1 AS k, {S.squeeze('document_number')} AS own, {S.squeeze('mapped')} AS map FROM j)
        SELECT chunk_id, 'art_' || sha1(CASE WHEN k > 0 THEN basis || '|duplicate:' || CAST(k AS VARCHAR) ELSE basis END)[1:20] AS article_id, trim(ltrim(regexp_extract({_SQ}, '(?i)^Điều\\s+\\S+\\s*(.*)$', 1), '. ')) AS name, md5({_SQ}) AS note,
               md5(CASE WHEN map = '' THEN own WHEN own = '' THEN map WHEN instr(upper(map), upper(own)) > 0 AND trim(map[instr(upper(map), upper(own)) + length(own):], ' ,.;:-') <> '' THEN map ELSE own END) AS title FROM o
    """,
    "keyword_delta": f"""
        WITH x AS (SELECT id, lower(concat_ws(' ', title, legal_sectors)) AS t, id IN (SELECT document_id FROM tree_nodes) AS known FROM ({META})),
        h AS (SELECT *, list_filter([{', '.join(S.q(w) for w in NEW_WORDS)}], lambda w: contains(t, w)) AS hits FROM x), n AS (SELECT *, list_filter(hits, lambda w: NOT list_contains([{', '.join(S.q(w) for w in OLD_WORDS)}], w)) AS new_hits FROM h)
        SELECT id, CASE WHEN known THEN 'already_known' WHEN len(hits) = 0 THEN 'no_extra_keyword' WHEN len(new_hits) = 0 THEN 'only_active_keywords' ELSE 'delta' END AS reason, array_to_string(hits, ';') AS hits, array_to_string(new_hits, ';') AS new_hits FROM n
    """,
}
