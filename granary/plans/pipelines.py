"""End-to-end flows: corpus build, index, batch retrieval, submission, retrieval with answers."""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T
from granary.operators import chunking, corpus, fusion, qa, retrieval
from granary.sources import readers, writers

POINTS = uuid.UUID("6a1f3f0e-54c9-5c0b-9a3d-0d2b7f4e9c11")
#: Other names under which metadata columns come.
ALIASES = {
    "document_number": ("so_ky_hieu",), "legal_type": ("loai_van_ban",), "legal_sectors": ("nganh", "linh_vuc"), "issuing_authority": ("co_quan_ban_hanh",), "issuance_date": ("ngay_ban_hanh",),
    "signers": ("nguoi_ky",), "effect_status": ("tinh_trang_hieu_luc",), "effectless_date": ("ngay_het_hieu_luc",),
}


def _checked(kind, values: dict):
    known = {f.name for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown settings of {kind.__name__}: {', '.join(unknown)}")
    return kind(**values)


@dataclass(frozen=True)
class BuildConfig:
    max_tokens: int = 2048
    overlap_tokens: int = 256
    table_rows: int = 8
    max_chunks_per_document: int | None = None
    min_marked_ratio: float | None = None

    def __post_init__(self):
        if self.max_tokens < 1 or self.overlap_tokens < 0 or self.table_rows < 1:
            raise ValueError("budgets must be positive")


@dataclass(frozen=True)
class SearchConfig:
    mode: str = "hybrid"
    top_k: int = 5
    pool: int = 20
    weights: tuple[float, float] = (1.0, 1.0)
    rerank: bool = False
    threshold: float | None = None
    title_style: str = "plain"

    def __post_init__(self):
        if self.mode not in ("dense", "sparse", "hybrid"):
            raise ValueError("mode is dense, sparse or hybrid")
        if self.threshold is not None and not self.rerank:
            raise ValueError("a threshold needs reranking")
        if len(self.weights) != 2 or min(self.weights) < 0 or max(self.weights) <= 0:
            raise ValueError("two weights are needed, none negative and one positive")
        if self.top_k < 1 or self.pool < self.top_k:
            raise ValueError("top_k is at least 1 and at most pool")


@dataclass(frozen=True)
class FlowConfig:
    build: BuildConfig = field(default_factory=BuildConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    answer_mode: str = "retrieval"
    context_chars: int = 6000

    @classmethod
    def from_mapping(cls, values: dict) -> FlowConfig:
        """A config from nested settings; unknown ones are an error."""
        v = dict(values)
        for name, kind in (("build", BuildConfig), ("search", SearchConfig)):
            if name in v:
                inner = dict(v[name])
                if "weights" in inner:
                    inner["weights"] = tuple(float(x) for x in (inner["weights"].replace(":", ",").split(",") if isinstance(inner["weights"], str) else inner["weights"]))
                v[name] = _checked(kind, inner)
        return _checked(cls, v)

    @classmethod
    def load(cls, path: str) -> FlowConfig:
        with open(path, encoding="utf-8") as f:
            if path.endswith((".yaml", ".yml")):
                try:
                    import yaml
                except ImportError as e:
                    raise RuntimeError("reading YAML needs pyyaml; use JSON") from e
                return cls.from_mapping(yaml.safe_load(f) or {})
            return cls.from_mapping(json.load(f))


def build_corpus(meta: DataFrame, content: DataFrame, status: DataFrame | None = None, config: BuildConfig = BuildConfig(), allow: DataFrame | None = None) -> DataFrame:
    """Retrieval units of all documents: ids, chunk columns, metadata, retrieval text and its hash.

    Metadata and contents are joined on id (of repeated ids the row crawled
    last counts); blank statuses are filled from `status`; `allow` limits the ids.
    """
    m = readers.alias_columns(meta, ALIASES)
    latest = [F.col("crawled_at").desc_nulls_last()] if "crawled_at" in m.columns else [F.xxhash64(*m.columns)]
    m = corpus.latest(m, ["id"], latest)
    if status is not None:
        m = corpus.fill_status(m, status)
    if allow is not None:
        m = m.join(allow, "id", "left_semi")
    c = corpus.latest_of_few(content, "id", [F.col("crawled_at").desc_nulls_last()] if "crawled_at" in content.columns else [F.xxhash64("content")])
    if config.min_marked_ratio is not None:
        c = c.filter(T.marked_ratio("content") >= config.min_marked_ratio)
    keep = [x for x in ("id", "document_number", "title", "legal_type", "legal_sectors", "issuing_authority", "issuance_date", "url", "effect_status") if x in m.columns]
    m = m.select(*keep)
    docs = c.select("id", "content").join(m.select("id", "title", F.col("document_number").alias("number")), "id")
    units = chunking.chunk_documents(docs, "id", "content", budget=config.max_tokens, overlap=config.overlap_tokens, table_rows=config.table_rows)
    if config.max_chunks_per_document is not None:
        units = units.filter(F.col("chunk_index") < config.max_chunks_per_document)
    units = units.join(m, "id")
    full = T.join_sentences(F.array("context", "text"))
    out = units.withColumn("chunk_id", X.chunk_key("id", "chunk_index")).withColumn("retrieval_text", full)
    return out.withColumn("point_id", X.uuid5(POINTS, "chunk_id")).withColumn("text_sha1", F.sha1(F.encode("retrieval_text", "UTF-8"))).withColumn("token_estimate", T.token_estimate("retrieval_text")).withColumn("preview", F.substring("retrieval_text", 1, 500))


def build_report(units: DataFrame) -> DataFrame:
    """One row: documents, chunks, tables, empty and long texts, the most chunks of a document, repeated ids."""
    dup = units.groupBy("chunk_id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n_repeated"))
    one = units.agg(F.count_distinct("id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("chunk_type") == "table_chunk").alias("n_tables"), F.count_if(F.trim("retrieval_text") == "").alias("n_empty"), F.count_if(F.length("retrieval_text") > 3000).alias("n_long"), F.max("chunk_count").alias("max_chunks"))
    return one.join(F.broadcast(dup))


def write_index(units: DataFrame, path: str, vectors: DataFrame | None = None) -> None:
    """Units, their terms and vectors as tables under `path`; units are found by id in one partition."""
    writers.index_points(units.withColumnRenamed("id", "document_id").withColumnRenamed("chunk_id", "id"), f"{path}/units")
    retrieval.tokens(units.select(F.col("chunk_id").alias("id"), F.col("retrieval_text").alias("text"))).write.mode("overwrite").parquet(f"{path}/terms")
    if vectors is not None:
        vectors.select("id", retrieval.normalised("embedding").alias("embedding")).write.mode("overwrite").parquet(f"{path}/vectors")


def search(spark: SparkSession, path: str, questions: DataFrame, config: SearchConfig = SearchConfig(), query_vectors: DataFrame | None = None, scorer: Callable | None = None, where=None) -> DataFrame:
    """Ranked hits with payload for `questions` (qid, text).

    `query_vectors` is (qid, embedding); `where` a condition on unit columns that
    holds in both branches; `scorer(question, text)` gives a Column for
    reranking, by default the share of the question's terms that a text has.
    """
    units = spark.read.parquet(f"{path}/units")
    if where is not None:
        units = units.filter(where)
    ids = units.select("id")
    lists = {}
    if config.mode != "sparse":
        if query_vectors is None:
            raise ValueError("dense retrieval needs query vectors")
        v = spark.read.parquet(f"{path}/vectors")
        lists["dense"] = retrieval.dense_top_k(v.join(ids, "id", "left_semi") if where is not None else v, query_vectors, config.pool)
    if config.mode != "dense":
        t = spark.read.parquet(f"{path}/terms")
        docs = units.select("id", F.col("retrieval_text").alias("text"))
        lists["sparse"] = retrieval.bm25_top_k(docs, questions, config.pool, index=t.join(ids, "id", "left_semi") if where is not None else t)
    if len(lists) == 2:
        hits = fusion.rrf(lists, config.pool, {"sparse": config.weights[0], "dense": config.weights[1]})
    else:
        hits = next(iter(lists.values()))
    full = hits.select("qid", "id", "score", "rank").join(units, "id")
    if config.rerank:
        asked = full.join(questions.select("qid", F.col("text").alias("question")), "qid")
        full = fusion.rerank(asked, (scorer or fusion.overlap_score)(F.col("question"), F.col("retrieval_text")), config.top_k, config.threshold)
    return full.filter(F.col("rank") <= config.top_k)


def submission(hits: DataFrame, questions: DataFrame, style: str = "plain") -> DataFrame:
    """(id, question, answer, relevant_docs, relevant_articles) for every question, found or not."""
    h = hits.withColumn("cite", T.citation_title(F.concat_ws(" ", F.nullif(T.squeeze("legal_type"), F.lit("")), F.lit("số"), "document_number", "title"), "document_number", style))
    docs = fusion.ordered_refs(h, "qid", X.doc_ref("document_number", "cite")).withColumnRenamed("refs", "relevant_docs")
    arts = fusion.ordered_refs(h, "qid", X.article_ref("document_number", "cite", "article_no")).withColumnRenamed("refs", "relevant_articles")
    none = F.array().cast("array<string>")
    j = questions.select("qid", F.col("text").alias("question")).join(docs, "qid", "left").join(arts, "qid", "left")
    return j.select(F.col("qid").alias("id"), "question", qa.fallback_answer(qa.allowed_articles(F.coalesce("relevant_articles", none))).alias("answer"), F.coalesce("relevant_docs", none).alias("relevant_docs"), F.coalesce("relevant_articles", none).alias("relevant_articles"))


def answer(hits: DataFrame, questions: DataFrame, config: FlowConfig = FlowConfig(), model=None) -> DataFrame:
    """Answers for the questions that have hits, checked against what they may name."""
    h = hits.select("qid", "rank", "score", F.col("document_number").alias("number"), "title", F.col("article_no").alias("article"), F.col("retrieval_text").alias("text"))
    rows = qa.context_rows(h, config.context_chars).join(questions.select("qid", F.col("text").alias("question")), "qid")
    return qa.answer_questions(rows, model, config.answer_mode)
