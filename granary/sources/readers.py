"""Readers for question files, vectors, id lists and earlier results, as DataFrames."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import squeeze
from granary.sources.writers import exists

QUESTION_KEYS = ("question", "query", "text")
ID_KEYS = ("id", "question_id", "qid")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, with_order: bool = False) -> DataFrame:
    """Parquet files; with_order adds `file` and `row` so that the stored order can be kept."""
    df = spark.read.parquet(path)
    if with_order:
        df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return df.select(*columns, *(["file", "row"] if with_order else [])) if columns else df


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header, every column a string; a missing file is an empty table of `columns`."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in columns))
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def json_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One JSON object a line, blank lines left out; `limit` counts lines of the file."""
    if limit is None:
        return spark.read.json(path)
    schema = spark.read.json(path).schema
    lines = spark.read.text(path).limit(limit).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def _field(df: DataFrame, keys: tuple[str, ...]):
    have = [k for k in keys if k in df.columns]
    return F.coalesce(*(F.nullif(F.trim(F.col(k).cast("string")), F.lit("")) for k in have)) if have else F.lit(None).cast("string")


def questions(spark: SparkSession, path: str, start_id: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, question, pos) of a question file.

    .json may be a list, {"questions": [...]} or {id: question}; .jsonl and .csv
    have a row each. The first filled key of QUESTION_KEYS and ID_KEYS counts; a
    row without an id gets its position. A row without a question is an error.
    """
    if path.endswith(".csv"):
        raw = csv_text(spark, path, ["id", "question"])
    elif path.endswith(".jsonl"):
        raw = json_lines(spark, path)
    else:
        raw = spark.read.option("multiLine", True).json(path)
        if "questions" in raw.columns:
            raw = raw.select(F.explode("questions").alias("q")).select("q.*")
        elif not set(raw.columns) & set(QUESTION_KEYS):
            pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("id"), F.col(f"`{c}`").cast("string").alias("question")) for c in raw.columns)))
            raw = raw.select(pairs.alias("q")).select("q.*")
    # the reading order: one file, so its partitions follow it
    row = raw.withColumn("mono", F.monotonically_increasing_id())
    pos = row.select("mono").withColumn("pos", F.expr("row_number() over (order by mono)") - 1)
    out = row.join(pos, "mono").select(F.coalesce(_field(raw, ID_KEYS), F.col("pos").cast("string")).alias("id"), _field(raw, QUESTION_KEYS).alias("question"), F.col("pos").cast("bigint").alias("pos"))
    out = out.withColumn("question", F.when(F.col("question").isNull(), F.raise_error(F.lit("a question is missing"))).otherwise(F.col("question")))
    if start_id is not None:
        out = out.filter(F.expr("try_cast(id as bigint)") >= start_id)
    return out.orderBy("pos").limit(limit) if limit is not None else out


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(pos, embedding) of a .npy matrix; a single vector is one row."""
    m = np.load(path)
    if m.ndim == 1:
        m = m.reshape(1, -1)
    if m.ndim != 2:
        raise ValueError("a matrix of one or two dimensions is needed")
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "pos bigint, embedding array<float>")


def question_vectors(qs: DataFrame, vecs: DataFrame) -> DataFrame:
    """Questions and vectors joined by position; unequal numbers are an error."""
    a, b = qs.count(), vecs.count()
    if a != b:
        raise ValueError(f"{a} questions but {b} vectors")
    return qs.join(vecs, "pos")


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file, apart by commas, spaces or lines."""
    part = spark.read.text(path).select(F.explode(F.split("value", r"[,\s]+")).alias("id")).filter("id <> ''")
    return part.select(F.col("id").cast("bigint").alias("id")).distinct()


def sub_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, sub_queries) of {id: [..]} or of rows with id/qid and sub_queries/queries."""
    raw = spark.read.option("multiLine", True).json(path)
    if "sub_queries" in raw.columns or "queries" in raw.columns:
        lists = F.coalesce(*(F.col(c) for c in ("sub_queries", "queries") if c in raw.columns))
        return raw.select(_field(raw, ("id", "qid")).alias("qid"), lists.alias("sub_queries"))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("qid"), F.col(f"`{c}`").alias("sub_queries")) for c in raw.columns)))
    return raw.select(pairs.alias("p")).select("p.*")


def search_results(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, results) of stored results: bare lists, {"result": {"results": ..}} or wrapped in results/rows."""
    raw = json_lines(spark, path) if path.endswith(".jsonl") else spark.read.option("multiLine", True).json(path)
    for wrap in ("rows", "results"):
        if raw.columns == [wrap]:
            raw = raw.select(F.explode(wrap).alias("r")).select("r.*")
    inner = F.col("result.results") if "result" in raw.columns else F.col("results")
    return raw.select(_field(raw, ID_KEYS).alias("id"), _field(raw, QUESTION_KEYS).alias("question"), inner.alias("results"))


def large_enough(path: str, least: int = 10_000) -> bool:
    """Whether a data file is there and no mere pointer to one."""
    return os.path.isfile(path) and os.path.getsize(path) > least


def alias_columns(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds each target from the first filled of its alias columns that exist; a filled target stays."""
    out = df
    for target, names in aliases.items():
        have = [n for n in (target, *names) if n in df.columns]
        if have:
            out = out.withColumn(target, F.coalesce(*(F.when(squeeze(F.col(n).cast("string")) != "", F.col(n).cast("string")) for n in have)))
    return out
