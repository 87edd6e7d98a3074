"""Queries of the corpus operators: name -> (spark, folder of tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import budget, encode, letterform, markup, mixing, neardup, pieces, sitelines, subjects
from granary.operators.packed_values import explode_packed
from granary.session import table, written


def _content(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_content").select("id", "source_site", "content", "crawled_at")


def sector_names(spark: SparkSession, d: str) -> list[str]:
    """The fixed list of sector names; explode_packed checks its size."""
    return [r.sector_name for r in table(spark, d, "sector_list").select("sector_name").limit(100_001).collect()]


def _act_fields(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_metadata").select(F.explode(F.array("issuing_authority", "legal_type", "document_number", "title")).alias("text"))


def _site_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sitelines.site_lines(_content(spark, d), fields=_act_fields(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _site_lines(spark, d)[0]


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    return sitelines.without_lines(_content(spark, d), _site_lines(spark, d)[1])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_items(pieces.oversized_items(*(table(spark, d, t) for t in ("chunks", "doc_content", "tree_nodes"))))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("item_kind", "item_key").distinct()


def _near_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return neardup.near_pairs(_content(spark, d), sitelines.site_keys(_content(spark, d), fields=_act_fields(spark, d)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.id_pairs(*_near_pairs(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(*_near_pairs(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    meta = letterform.consistent_text(table(spark, d, "doc_metadata"), "id", ["title", "issuing_authority"], texts=False)
    body = letterform.consistent_text(table(spark, d, "doc_content"), "id", ["content"], texts=False)
    return meta.unionByName(body).distinct()


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    meta = letterform.consistent_text(table(spark, d, "doc_metadata"), "id", ["title", "issuing_authority"])
    return meta.unionByName(letterform.consistent_text(table(spark, d, "doc_content"), "id", ["content"])).distinct()


def _budget(spark: SparkSession, d: str, exact: bool) -> DataFrame:
    chunks = table(spark, d, "chunks")
    values = explode_packed(chunks.select("chunk_id", "legal_sectors"), "chunk_id", {"legal_sectors": {"names": sector_names(spark, d), "dash": True}})
    sectors = values.select("chunk_id", F.lower("val").alias("sector"))
    return budget.token_budget(chunks, table(spark, d, "doc_metadata"), sectors, exact=exact)


def p6_budget(spark: SparkSession, d: str) -> DataFrame:
    return _budget(spark, d, False)


def p6_error(spark: SparkSession, d: str) -> DataFrame:
    """The estimated totals of each slice against the vocabulary's own pair-merge counts."""
    b = _budget(spark, d, True)
    return b.select("slice", "key1", "key2", "n_chunks", "n_tokens", "n_exact", F.round(F.col("n_tokens") / F.col("n_exact") - 1, 6).alias("error"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = markup.markup_items(table(spark, d, "doc_content"), table(spark, d, "tree_nodes"))
    return markup.without_markup(items, texts=False).select("item_kind", "item_key", F.explode("markup").alias("markup")).distinct()


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    items = markup.markup_items(table(spark, d, "doc_content"), table(spark, d, "tree_nodes"))
    return markup.without_markup(items)


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts rebuilt from their ids and from the places of their tokens."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    coded = encode.token_ids(docs, "doc_id", "text", offsets=True)
    out = encode.decode(coded.select("doc_id", "ids"), "doc_id", "ids").join(coded.select("doc_id", F.size("ids").alias("n"), F.size("ends").alias("n_ends"), F.coalesce(F.get("ends", F.size("ends") - 1), F.lit(0)).alias("n_bytes")), "doc_id")
    return out.select("doc_id", F.md5("text").alias("digest"), (F.col("n") == F.col("n_ends")).alias("placed"), "n_bytes")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.lower("lang").alias("lang"), F.lower(F.trim("legal_type")).alias("topic"), F.md5("text").alias("text_key"), "text")
    return encode.token_counts(docs, "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(_counts(spark, d), table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    """How near the mix comes to the wanted shares of sources, languages and topics."""
    counts, targets = written(_counts(spark, d), "counts"), table(spark, d, "mix_targets")
    return mixing.marginals(counts, mixing.mix_sources(counts, targets)[0], targets)


#: Fixed values of these data: the subject area each sector code is filed under.
SECTOR_SUBJECT = {
    "land": ["S01", "S02", "S03"], "labour": ["S04", "S05", "S06"], "tax": ["S07", "S08", "S09"], "enterprise": ["S10", "S11", "S12"], "health": ["S13", "S14", "S15"], "education": ["S16", "S17", "S18"],
    "environment": ["S19", "S20", "S21"], "transport": ["S22", "S23", "S24"], "justice": ["S25", "S26", "S27"], "software": ["S28", "S29", "S30"], "sport": ["S31", "S32"], "science": ["S33", "S34", "S35"],
}


def sector_subjects(spark: SparkSession, d: str) -> DataFrame:
    """(sector_name, subject): the table of what each sector is filed under."""
    pairs = spark.createDataFrame([(c, s) for s, codes in SECTOR_SUBJECT.items() for c in codes], "sector_code string, subject string")
    return table(spark, d, "sector_list").join(F.broadcast(pairs), "sector_code").select("sector_name", "subject")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    acts = table(spark, d, "doc_metadata")
    names = sorted(r.subject for r in table(spark, d, "subject_areas").select("subject").distinct().limit(subjects.MAX_SUBJECTS + 1).collect())
    if len(names) > subjects.MAX_SUBJECTS:
        raise ValueError("more subject areas than a model may have")
    act_sectors = explode_packed(acts, "id", {"legal_sectors": {"names": sector_names(spark, d), "dash": True}}).select("id", "val")
    docs = table(spark, d, "documents")
    model = subjects.fit_subjects(table(spark, d, "doc_content"), acts, act_sectors, sector_subjects(spark, d), docs, table(spark, d, "subject_labels"), names)
    return subjects.subject_areas(docs, model)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject").distinct()


def p10_makeup(spark: SparkSession, d: str) -> DataFrame:
    return subjects.corpus_makeup(written(_subjects(spark, d), "subjects"), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_clean, p2_found, p2_pieces, p3_found, p3_groups, p4_found, p4_forms, p6_budget, p6_error, p7_found, p7_clean, p8_ids, p8_decoded, p9_mix, p9_shares, p9_marginals, p10_found, p10_makeup)}



def _forms_sql(relation: str, fields: list[str]) -> str:
    """(id, field_name, form, affected) of a table by the letter form rules, over all rows at once."""
    cols = ", ".join(f"{f} AS f{i}" for i, f in enumerate(fields))
    every = " UNION ALL ".join(f"SELECT n, {i} AS f, '{f}' AS field_name, f{i} AS old FROM batch WHERE f{i} IS NOT NULL" for i, f in enumerate(fields))
    return f"""
        WITH batch AS (SELECT row_number() OVER () AS n, id, {cols} FROM {relation}), changed AS ({letterform.consistent_sql(fields)}), every AS ({every})
        SELECT DISTINCT b.id, e.field_name, coalesce(c.form, e.old) AS form, coalesce(c.form <> e.old, false) AS affected
        FROM every e JOIN batch b USING (n) LEFT JOIN changed c ON c.n = e.n AND c.f = e.f
    """


_FORMS = f"SELECT * FROM ({_forms_sql('doc_metadata', ['title', 'issuing_authority'])}) UNION SELECT * FROM ({_forms_sql('doc_content', ['content'])})"

ORACLE_SQL = {
    "p8_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, true AS placed, CAST(octet_length(encode(coalesce(text, ''))) AS INTEGER) AS n_bytes FROM documents",
    "p4_forms": _FORMS,
    "p4_found": f"SELECT DISTINCT id, field_name FROM ({_FORMS}) WHERE affected",
    "p2_found": """
        SELECT DISTINCT item_kind, item_key FROM (
            SELECT 'chunk' AS item_kind, chunk_id AS item_key, text FROM chunks
            UNION ALL SELECT 'content', CAST(id AS VARCHAR), content FROM doc_content
            UNION ALL SELECT 'block', node_id || '/' || CAST(pos AS VARCHAR), b.text
            FROM (SELECT node_id, unnest(blocks) AS b, unnest(range(1, len(blocks) + 1)) AS pos FROM tree_nodes)
        ) WHERE len(text) > 3000
    """,
}
