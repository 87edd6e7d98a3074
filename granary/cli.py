"""Command line: build, index, search, submit, query."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from granary.plans import pipelines as P
from granary.session import build_session
from granary.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="granary", description=__doc__)
    p.add_argument("--master", help="Spark master; the environment's by default")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build", help="cut documents into retrieval units and write them with a report")
    b.add_argument("metadata")
    b.add_argument("content")
    b.add_argument("out")
    b.add_argument("--status", help="table of (id, effect_status)")
    b.add_argument("--ids", help="text file of the ids to keep")
    b.add_argument("--max-tokens", type=int, default=2048)
    b.add_argument("--overlap-tokens", type=int, default=256)
    i = sub.add_parser("index", help="write units, postings and vectors as tables")
    i.add_argument("units")
    i.add_argument("out")
    i.add_argument("--vectors", help="table of (id, embedding)")
    for name in ("search", "submit"):
        s = sub.add_parser(name, help="ranked hits" if name == "search" else "answers with references")
        s.add_argument("index")
        s.add_argument("questions")
        s.add_argument("out")
        s.add_argument("--mode", choices=("dense", "sparse", "hybrid"), default="sparse")
        s.add_argument("--query-vectors", help=".npy matrix, a row for each question")
        s.add_argument("--top-k", type=int, default=5)
        s.add_argument("--pool", type=int, default=20)
        s.add_argument("--weights", default="1,1", help="of sparse and dense")
        s.add_argument("--rerank", action="store_true")
        s.add_argument("--threshold", type=float)
        s.add_argument("--limit", type=int)
        s.add_argument("--title-style", choices=("plain", "numbered"), default="plain")
    q = sub.add_parser("query", help="run a registered query over a folder of tables")
    q.add_argument("name")
    q.add_argument("tables")
    q.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command in ("search", "submit"):
        try:
            config = P.SearchConfig(a.mode, a.top_k, a.pool, tuple(float(x) for x in a.weights.replace(":", ",").split(",")), a.rerank, a.threshold, a.title_style)
        except ValueError as e:
            parser().error(str(e))
    spark = build_session("granary", a.master)
    if a.command == "build":
        allow = readers.id_list(spark, a.ids) if a.ids else None
        status = spark.read.parquet(a.status) if a.status else None
        units = P.build_corpus(spark.read.parquet(a.metadata), spark.read.parquet(a.content), status, P.BuildConfig(a.max_tokens, a.overlap_tokens), allow)
        units.write.mode("overwrite").parquet(a.out)
        writers.report(P.build_report(spark.read.parquet(a.out)), f"{a.out.rstrip('/')}-report.json")
    elif a.command == "index":
        P.write_index(spark.read.parquet(a.units), a.out, spark.read.parquet(a.vectors) if a.vectors else None)
    elif a.command == "query":
        from granary.plans import registry

        registry.QUERIES[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    else:
        asked = readers.questions(spark, a.questions, limit=a.limit)
        vectors = readers.question_vectors(asked, readers.vectors(spark, a.query_vectors)).select(F.col("id").alias("qid"), "embedding") if a.query_vectors else None
        qs = asked.select(F.col("id").alias("qid"), F.col("question").alias("text"))
        hits = P.search(spark, a.index, qs, config, vectors)
        if a.command == "search":
            writers.ordered_json_lines(hits.select("qid", "rank", "score", "id", "document_number", "title", "article_no", "retrieval_text"), a.out, ["qid", "rank"], "overwrite")
        else:
            writers.submission(P.submission(hits, qs, a.title_style), a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
