import pytest
from pyspark.sql import functions as F

from granary.operators import corpus, payload
from granary.session import shared_dir, written


@pytest.fixture()
def rows(spark):
    return spark.createDataFrame([(1, "a", ["x", "y"], 7), (2, "a", ["x"], 8), (3, None, None, None)], "id int, k string, tags array<string>, n int")


def test_filter(rows):
    f = payload.payload_filter(equal={"k": "a"}, contains={"tags": "y"}, between={"n": (7, 7)})
    assert [r.id for r in rows.filter(f).collect()] == [1]
    assert rows.filter(payload.payload_filter()).count() == 3


def test_filter_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).filter(payload.payload_filter(equal={"k": "a"}, between={"n": (7, 9)})).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,a)" in plan and "GreaterThanOrEqual(n,7)" in plan and "tags" not in plan.split("ReadSchema")[1]


def test_keywords(spark):
    df = spark.createDataFrame([(1, "thuế và đất"), (2, "đất đai"), (3, None), (4, "")], "id int, t string")
    h = payload.keyword_hits(df, "id", "t", {"tax": ["thuế"], "land": ["đất", "đất đai", "đất"]})
    assert {(r.id, r.rule, r.hits) for r in h.collect()} == {(1, "tax", 1), (1, "land", 1), (2, "land", 2)}
    assert [(r.id, r.rule) for r in payload.top_rules(h, "id", 1).orderBy("id").collect()] == [(1, "land"), (2, "land")]


def test_counts_and_strata(rows):
    got = {(r.dimension, r.value): (r.n_all, r.n_kept) for r in corpus.counts_by(rows, {"k": F.col("k")}, F.coalesce(F.col("n") > 7, F.lit(False))).collect()}
    assert got == {("k", "a"): (2, 1), ("k", "unknown"): (1, 0)}
    assert corpus.stratified(rows, F.coalesce("k", F.lit("-")), [F.col("id")], 1).count() == 2


def test_written(spark, rows):
    assert shared_dir(spark)
    assert sorted(r.id for r in written(rows, "test").collect()) == [1, 2, 3]
    assert written(rows.limit(0), "test").count() == 0
