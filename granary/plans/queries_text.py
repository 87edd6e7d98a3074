"""Queries over the text and extraction functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T
from granary.plans import sql as S
from granary.session import table

URL_NS = uuid.NAMESPACE_URL
NUMBER = r"(\d{1,4}/\d{4}/[\p{L}]{1,4}-[\p{L}\d]+)"
ARTICLE_SQL = r"(?i)Điều\s+([0-9]+(?:\.[0-9A-Za-zĐđ]+)*)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_metadata")


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    x = _docs(spark, d)
    return x.select("doc_id", F.md5(T.squeeze("text")).alias("squeezed"), F.md5(T.folded("text")).alias("folded"), F.md5(T.squeeze_lines("text")).alias("lines"), T.labeled("Văn bản", "legal_type").alias("labeled"))


def clean_content(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "doc_content").dropDuplicates(["id"])
    out = T.clean_lines("content", [r"(?iu)^Nguồn tin:"])
    return c.select("id", F.length(out).alias("n_chars"), F.md5(out).alias("digest"))


def marker_ratio(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.round(T.marked_ratio("text"), 6).alias("ratio"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", T.token_estimate("text").alias("tokens")).distinct()


def term_counts(spark: SparkSession, d: str) -> DataFrame:
    t = T.terms("text")
    return _docs(spark, d).select("doc_id", F.size(t).alias("n_terms"), F.size(F.array_distinct(t)).alias("n_distinct"))


def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    ids = X.law_ids("text", NUMBER)
    return c.select("chunk_id", F.md5("text").alias("digest"), F.array_join(ids, ";").alias("law_ids"), F.array_join(X.article_numbers("text"), ";").alias("articles"), F.array_join(X.article_numbers("text", ordered=True), ";").alias("articles_in_order"))


def law_id_extract(spark: SparkSession, d: str) -> DataFrame:
    """Document numbers in chunks and in numbers that another sign is tied to, which are none."""
    c = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    tied = F.regexp_replace("text", r"(\d{4}/[\p{L}]+-[\p{L}]+)", "$1 45/2019/CPX 123456/2020/QH14 7/2021/QH15,")
    return c.select("chunk_id", F.md5("text").alias("digest"), F.array_join(X.law_ids("text"), ";").alias("law_ids"), F.array_join(X.law_ids(tied), ";").alias("with_tied"))


def citation_confidence(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select("id", "document_number", "title", "url").distinct()
    note = F.concat_ws(" ", "document_number", "title")
    ids = X.law_ids(note, NUMBER)
    titles = X.title_candidates(note, F.array_compact(F.array("title")), ids)
    return m.select("id", "document_number", "url", F.array_join(ids, ";").alias("ids"), F.array_join(titles, "\n").alias("titles"), X.citation_confidence(note, ids, titles).alias("confidence"))


def year_date_parse(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select("id", "issuance_date", "effectless_date").distinct()
    p = X.date_parts("issuance_date")
    return m.select("id", "issuance_date", "effectless_date", X.last_year("issuance_date").alias("year"), p["y"].alias("y"), p["m"].alias("m"), p["d"].alias("d"), X.last_year("effectless_date").alias("end_year"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks").select("chunk_id", "document_id", "chunk_index", "text").distinct()
    return c.select("chunk_id", X.short_hash("text", "txt").alias("text_id"), F.sha1(F.encode("text", "UTF-8")).alias("text_sha1"), X.chunk_key("document_id", "chunk_index", "act").alias("key"))


def uuid5_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id").distinct().select("chunk_id", X.uuid5(URL_NS, "chunk_id").alias("point_id"))


def citation_titles(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select("id", "document_number", "title", T.squeeze("legal_type").alias("kind")).distinct()
    full = F.concat_ws(" ", F.nullif("kind", F.lit("")), F.lit("số"), T.squeeze("document_number"), T.squeeze("title"))
    return m.select("id", "document_number", "title", "kind", T.citation_title(full, "document_number").alias("plain"), T.citation_title(full, "document_number", "numbered").alias("numbered"))


def document_contexts(spark: SparkSession, d: str) -> DataFrame:
    m = _meta(spark, d).select("id", "document_number", "title").distinct()
    return m.select("id", "document_number", "title", T.document_context("document_number", "title").alias("context"), X.doc_ref("document_number", "title").alias("ref"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = F.from_json("props", "map<string,string>")
    return e.select("event_id", F.array_join(F.array_sort(F.map_keys(p)), ",").alias("keys"), F.size(F.map_keys(p)).alias("n_keys"))


QUERIES = {f.__name__: f for f in (normalize_text, clean_content, marker_ratio, token_estimates, term_counts, citation_extract, law_id_extract, citation_confidence, year_date_parse, stable_ids, uuid5_ids, citation_titles, document_contexts, json_props)}

_LINES = f"regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), {S.q(T.INLINE + '+')}, ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
_CLEAN = _LINES.replace("(text,", "(content,")
_CLEANED = f"array_to_string(list_filter(list_transform(string_split({_CLEAN}, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^\\.{{3,}}$') AND NOT regexp_matches(x, '(?i)^Nguồn tin:')), chr(10))"
_EDGE = "(^|[^\\p{L}\\p{N}_])"
_END = "($|[^\\p{L}\\p{N}_])"
_DA = _EDGE + "(\\d{1,2})[/-](\\d{1,2})[/-]((?:19|20)\\d{2})" + _END
_DB = "(?i)" + _EDGE + "ngày\\s+(\\d{1,2})\\s+tháng\\s+(\\d{1,2})\\s+năm\\s+((?:19|20)\\d{2})" + _END


def _part(i: int) -> str:
    s = S.squeeze("issuance_date")
    return f"coalesce(TRY_CAST(CASE WHEN regexp_matches({s}, '{_DA}') THEN regexp_extract({s}, '{_DA}', {i}) WHEN regexp_matches({s}, '{_DB}') THEN regexp_extract({s}, '{_DB}', {i}) END AS INTEGER), 0)"


def _year(c: str) -> str:
    return f"(SELECT CASE WHEN y BETWEEN 1800 AND 2100 THEN y END FROM (SELECT TRY_CAST(list_extract(regexp_extract_all(coalesce({c}, ''), '(\\d{{4}})', 1), -1) AS INTEGER) AS y))"


_IDS = f"list_sort(list_distinct(list_transform(regexp_extract_all(text, '{NUMBER}', 1), lambda x: upper(x))))"
_ART = f"list_transform(regexp_extract_all(text, '{ARTICLE_SQL}', 1), lambda x: 'Điều ' || x)"
# no look-around here: each number is taken with the sign before it, and what follows is checked by taking one sign more
_CODES = "QH[0-9]+|NĐ-CP|ND-CP|TT-[A-ZĐa-zđ]+|QĐ-[A-ZĐa-zđ]+|QD-[A-ZĐa-zđ]+|VBHN-[A-ZĐa-zđ]+|NQ-[A-ZĐa-zđ]+|CP|TTLT-[A-ZĐa-zđ-]+|PL-UBTVQH[0-9]+|UBTVQH[0-9]+"
_TIED = "regexp_replace(text, '([0-9]{4}/[\\p{L}]+-[\\p{L}]+)', '\\1 45/2019/CPX 123456/2020/QH14 7/2021/QH15,', 'g')"


def _law_ids(x: str) -> str:
    """Runs of number signs, then those that are a document number as a whole."""
    runs = f"regexp_extract_all(upper({x}), '[\\p{{L}}\\p{{N}}_/-]+')"
    number = f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,4}}/(?:[0-9]{{4}}/)?(?:{_CODES}))(?:$|[^\\p{{L}}\\p{{N}}_])"
    return f"array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform({runs}, lambda r: regexp_extract_all(r, '{number}', 1))), lambda v: v <> ''))), ';')"


_NOTE = "concat_ws(' ', document_number, title)"
_UPPER1 = "upper(t[1:1]) || t[2:]"
_UUID = f"sha1(unhex('{URL_NS.hex}') || encode(chunk_id))"

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, md5({S.squeeze('text')}) AS squeezed, md5(lower({S.squeeze('text')})) AS folded, md5({_LINES}) AS lines, CASE WHEN {S.squeeze('legal_type')} = '' THEN '' ELSE 'Văn bản ' || {S.squeeze('legal_type')} END AS labeled FROM documents",
    "clean_content": f"SELECT id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT DISTINCT id, {_CLEANED} AS x FROM doc_content)",
    "marker_ratio": f"SELECT doc_id, round(CAST({S.marked_ratio('text')} AS DOUBLE), 6) AS ratio FROM documents",
    "token_estimates": f"SELECT DISTINCT chunk_id, {S.token_estimate('text')} AS tokens FROM chunks",
    "term_counts": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_terms, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct FROM (SELECT doc_id, {S.terms('text')} AS t FROM documents)",
    "citation_extract": f"""
        SELECT chunk_id, md5(text) AS digest, array_to_string({_IDS}, ';') AS law_ids, array_to_string(list_sort(list_distinct({_ART})), ';') AS articles,
               array_to_string(list_filter({_ART}, lambda x, i: list_position({_ART}, x) = i), ';') AS articles_in_order FROM (SELECT DISTINCT chunk_id, text FROM chunks)
    """,
    "law_id_extract": f"SELECT chunk_id, md5(text) AS digest, {_law_ids('text')} AS law_ids, {_law_ids(_TIED)} AS with_tied FROM (SELECT DISTINCT chunk_id, text FROM chunks)",
    "citation_confidence": f"""
        WITH m AS (SELECT DISTINCT id, document_number, title, url, {S.squeeze(_NOTE)} AS note FROM doc_metadata),
        i AS (SELECT *, list_sort(list_distinct(list_transform(regexp_extract_all({_NOTE}, '{NUMBER}', 1), lambda x: upper(x)))) AS ids FROM m),
        c AS (SELECT *, list_filter(list_transform(list_concat(CASE WHEN title IS NULL THEN [] ELSE [title] END,
                list_transform(ids, lambda x: {S.edges("note[greatest(instr(upper(note), x) - 120, 1):instr(upper(note), x) + length(x) + 219]", " .;,:-")})),
                lambda x: {S.squeeze('x')}), lambda x: x <> '') AS t FROM i),
        u AS (SELECT *, list_transform(t, lambda x: lower(x)) AS low FROM c),
        f AS (SELECT *, list_filter(t, lambda x, n: list_position(low, lower(x)) = n) AS titles FROM u)
        SELECT id, document_number, url, array_to_string(ids, ';') AS ids, array_to_string(titles, chr(10)) AS titles,
               CASE WHEN len(ids) > 0 AND len(titles) > 0 THEN 'high' WHEN note <> '' THEN 'medium' ELSE 'low' END AS confidence FROM f
    """,
    "year_date_parse": f"SELECT DISTINCT id, issuance_date, effectless_date, {_year('issuance_date')} AS year, {_part(4)} AS y, {_part(3)} AS m, {_part(2)} AS d, {_year('effectless_date')} AS end_year FROM doc_metadata",
    "stable_ids": "SELECT DISTINCT chunk_id, 'txt_' || sha1(text)[1:20] AS text_id, sha1(text) AS text_sha1, format('act:{}:chunk:{:05d}', document_id, chunk_index) AS key FROM chunks",
    "uuid5_ids": f"""
        SELECT chunk_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17:17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17:17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17:17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END
               || h[18:20] || '-' || h[21:32] AS point_id FROM (SELECT DISTINCT chunk_id, {_UUID} AS h FROM chunks)
    """,
    "document_contexts": f"""
        SELECT id, document_number, title, CASE WHEN n <> '' AND contains(lower(t), lower(n)) THEN t ELSE trim(n || ' ' || t) END AS context, CASE WHEN n = '' OR t = '' THEN '' ELSE n || '|' || t END AS ref
        FROM (SELECT DISTINCT id, document_number, title, {S.squeeze('document_number')} AS n, {S.squeeze('title')} AS t FROM doc_metadata)
    """,
    "json_props": "SELECT event_id, array_to_string(list_sort(coalesce(json_keys(props), [])), ',') AS keys, CAST(CASE WHEN props IS NULL THEN -1 ELSE len(json_keys(props)) END AS INTEGER) AS n_keys FROM events",
}
