import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.operators import fusion, retrieval
from granary.plans import registry


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid bigint, id string, score double, rank int")


def test_rrf_order(spark):
    dense = ranked(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 2)])
    sparse = ranked(spark, [(1, "b", 7.0, 1), (1, "c", 6.0, 2)])
    got = fusion.rrf({"dense": dense, "sparse": sparse}, 10).orderBy("rank").collect()
    assert [r.id for r in got] == ["b", "a", "c"]
    assert (got[0].dense_rank, got[0].sparse_rank) == (2, 1)


def test_rrf_weights(spark):
    got = fusion.rrf({"dense": ranked(spark, [(1, "d", 1.0, 1)]), "sparse": ranked(spark, [(1, "s", 1.0, 1)])}, 10, {"sparse": 3, "dense": 1})
    assert [r.id for r in got.orderBy("rank").collect()] == ["s", "d"]


@pytest.mark.parametrize("name", ["hybrid_rrf", "hybrid_rrf_weighted", "branch_rrf"])
def test_documents_without_a_vector_are_queries(spark, tmp_path, name):
    spark.createDataFrame([(50, "một hai"), (51, "hai ba"), (100, "ba bốn"), (150, None)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(50, [1.0, 0.0], 0), (51, [1.0, 1.0], 0), (200, [0.0, 1.0], 0)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path)).collect()
    assert {r.qid for r in got} == {50, 100, 200}
    assert [r.id for r in got if r.qid == 100] == [51] and {r.qid for r in got if r.sparse_rank} == {50, 100}


@pytest.mark.parametrize("same", [False, True])
def test_dense_matches_brute_force(spark, same):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 3) for i in range(60)] + [(60, None, 0), (61, [0.0] * 4, 1), (62, [1.0], 2)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<float>, label int").repartition(5)
    q = df.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    got = {(r.qid, r.rank): (r.id, r.score) for r in retrieval.dense_top_k(df, q, 5, same="label" if same else None).collect()}
    want = {}
    for qi, qe, ql in rows:
        if qi % 7 or qe is None or not any(qe) or len(qe) != 4:
            continue
        s = []
        for i, e, lab in rows:
            if i != qi and e is not None and len(e) == 4 and any(e) and (not same or lab == ql):
                s.append((-round(float(np.dot(qe, e) / np.linalg.norm(qe) / np.linalg.norm(e)), 6) + 0.0, i))
        for r, (v, i) in enumerate(sorted(s)[:5], 1):
            want[qi, r] = (i, -v)
    assert {k: (i, round(s, 5)) for k, (i, s) in got.items()} == {k: (i, round(s, 5)) for k, (i, s) in want.items()}


def test_dense_without_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "id bigint, embedding array<float>")
    assert retrieval.dense_top_k(df, df.withColumnRenamed("id", "qid").limit(0), 3).count() == 0


def test_bm25_matches_brute_force(spark):
    random.seed(5)
    words = "một hai ba bốn năm sáu bảy".split()
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 12)))) for i in range(40)] + [(40, None)]
    queries = [(0, "hai hai ba"), (1, "bảy"), (2, ""), (3, None), (4, "không")]
    d = spark.createDataFrame(docs, "id bigint, text string")
    got = retrieval.bm25_top_k(d, spark.createDataFrame(queries, "qid bigint, text string"), 3).collect()
    toks = {i: (t or "").split() for i, t in docs}
    avg = sum(map(len, toks.values())) / len(toks)
    want = []
    for qi, t in queries:
        s = []
        for i, ts in toks.items():
            v = 0.0
            for w in set((t or "").split()):
                tf, df = ts.count(w), sum(w in x for x in toks.values())
                v += math.log((len(toks) - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avg)) if tf else 0
            if v > 0:
                s.append((-round(v, 6), i))
        want += [(qi, i, -v, r) for r, (v, i) in enumerate(sorted(s)[:3], 1)]
    assert sorted((r.qid, r.id, round(r.score, 5), r.rank) for r in got) == sorted((a, b, round(c, 5), d) for a, b, c, d in want)


def test_rerank_threshold(spark):
    hits = ranked(spark, [(1, "x", 9.0, 1), (1, "y", 8.0, 2)])
    got = fusion.rerank(hits, F.when(F.col("id") == "x", -1.0).otherwise(5.0), 5, threshold=0.0).collect()
    assert [(r.id, r.retrieval_rank, r.rank) for r in got] == [("y", 2, 1)]


def test_newest_version_takes_first_place(spark):
    rows = [(1, "a", 9.0, 1, "k", 2015), (1, "b", 8.0, 2, "m", 2000), (1, "c", 7.0, 3, "k", 2019)]
    df = spark.createDataFrame(rows, "qid bigint, id string, score double, rank int, key string, year int")
    got = fusion.newest_version(df, ["qid"], ["key"], [F.col("year")], "score", "rank").orderBy("rank_out").collect()
    assert [(r.id, r.rank_out) for r in got] == [("c", 1), ("b", 2)]


def test_running_budget(spark):
    df = spark.createDataFrame([(1, 1, "x" * 30), (1, 2, "  "), (1, 3, "y" * 300), (1, 4, "z")], "q int, n int, t string")
    got = fusion.running_budget(df, "q", [F.col("n")], "t", 55).collect()
    assert [r.n for r in got] == [1]
    got = fusion.running_budget(df, "q", [F.col("n")], "t", 300).orderBy("n").collect()
    assert [(r.n, len(r.context)) for r in got] == [(1, 30), (3, 266)]


def test_select_listed(spark):
    hits = ranked(spark, [(q, f"{q}{i}", 1.0, i) for q in (1, 2, 3) for i in (1, 2, 3)])
    chosen = spark.createDataFrame([(1, [3, 3, 1, 9]), (2, [0])], "qid bigint, picks array<int>")
    got = fusion.select_listed(hits, chosen, 2).orderBy("qid", "rank_out").collect()
    assert [(r.id, r.rank_out) for r in got] == [("13", 1), ("11", 2), ("21", 1), ("22", 2), ("31", 1), ("32", 2)]


def test_ordered_refs(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "b"), (1, 4, "")], "q int, rank int, r string")
    assert fusion.ordered_refs(df, "q", F.col("r")).first().refs == ["b", "a"]


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(f"d{i}", " ".join(rng.choices(["chung", *(f"t{j}" for j in range(30))], k=rng.randint(0, 25)))) for i in range(120)]
    d = spark.createDataFrame(docs, "id string, text string").repartition(3)
    q = spark.createDataFrame([(f"d{i}", docs[i][1]) for i in range(40)] + [("d1", "chung t1"), ("x", None)], "qid string, text string")
    v = spark.createDataFrame([(f"v{i}", [float(rng.randint(0, 3)) for _ in range(3)]) for i in range(90)], "id string, embedding array<float>")
    asked = v.limit(30).withColumnRenamed("id", "qid")

    def both():
        return sorted(map(tuple, retrieval.bm25_top_k(d, q, 4, keep_self=False).collect())), sorted(map(tuple, retrieval.dense_top_k(v, asked, 4).collect()))

    whole = both()
    for name, value in {"QUERY_TERMS": 100, "QUERY_BYTES": 240, "BLOCK": 7, "CELLS": 50, "KEPT_ROWS": 3}.items():
        monkeypatch.setattr(retrieval, name, value)
    small = both()
    assert small == whole and len(whole[0]) > 140 and len(whole[1]) > 100
    assert retrieval.bm25_top_k(d, q, 4, keep_self=False, index=retrieval.tokens(d)).count() == len(whole[0])


def test_dimension_is_the_commonest(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 1.0])], "qid bigint, embedding array<float>")
    v = spark.createDataFrame([(7, [1.0, 1.0]), (8, [2.0])], "id bigint, embedding array<float>")
    assert {r.qid for r in retrieval.dense_top_k(v, q, 2).collect()} == {1, 3}
    assert {(r.qid, r.id) for r in retrieval.dense_top_k(v, q, 2, size=1).collect()} == {(2, 8)}
