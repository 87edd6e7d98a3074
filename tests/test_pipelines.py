import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary import cli
from granary.plans import pipelines as P

TEXT = "Điều 1. Thuế suất\n1. Mức thuế suất áp dụng cho doanh nghiệp.\n2. Hoàn thuế cho hộ kinh doanh.\nĐiều 2. Đất đai\n1. Thửa đất và mốc giới."


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("flow")
    meta = [(1, "1/2020/QH14", "Luật Thuế", "Luật", None, "2020"), (1, "1/2020/QH14", "Luật cũ", "Luật", None, "2019"), (2, "2/2021/NĐ-CP", "Đất", None, "còn", "2020")]
    spark.createDataFrame(meta, "id bigint, so_ky_hieu string, title string, loai_van_ban string, effect_status string, crawled_at string").write.parquet(str(d / "meta"))
    spark.createDataFrame([(1, TEXT, "2020"), (2, "Điều 5. Mốc giới thửa đất\nNội dung về mốc giới.", "2020"), (3, TEXT, "2020"), (4, None, None)], "id bigint, content string, crawled_at string").write.parquet(str(d / "content"))
    spark.createDataFrame([(1, "hết")], "id bigint, effect_status string").write.parquet(str(d / "status"))
    assert cli.main(["build", str(d / "meta"), str(d / "content"), str(d / "units"), "--status", str(d / "status")]) == 0
    units = spark.read.parquet(str(d / "units"))
    vec = units.select(F.col("chunk_id").alias("id"), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    vec.write.parquet(str(d / "vec"))
    assert cli.main(["index", str(d / "units"), str(d / "index"), "--vectors", str(d / "vec")]) == 0
    return d


def test_units(spark, built):
    u = {r.chunk_id: r for r in spark.read.parquet(str(built / "units")).collect()}
    assert set(u) == {"doc:1:chunk:00000", "doc:1:chunk:00001", "doc:2:chunk:00000"}
    assert u["doc:1:chunk:00000"].title == "Luật Thuế" and u["doc:1:chunk:00000"].effect_status == "hết" and u["doc:2:chunk:00000"].effect_status == "còn"
    assert u["doc:1:chunk:00000"].retrieval_text.startswith("1/2020/QH14 Luật Thuế. Điều 1. Thuế suất. 1. Mức")
    assert json.loads((built / "units-report.json").read_text())["n_chunks"] == 3


def test_submit(spark, built):
    (built / "q.json").write_text(json.dumps({"questions": [{"id": "a", "question": "thuế suất doanh nghiệp"}, {"id": "b", "question": "zzz"}]}))
    assert cli.main(["submit", str(built / "index"), str(built / "q.json"), str(built / "out.json"), "--rerank", "--threshold", "0.5", "--top-k", "1"]) == 0
    out = {r["id"]: r for r in json.loads((built / "out.json").read_text())}
    assert out["a"]["relevant_articles"] == ["1/2020/QH14|Luật Thuế|Điều 1"] and out["a"]["answer"].endswith("Điều 1.")
    assert out["b"]["relevant_docs"] == [] and out["b"]["answer"]


def test_hybrid_and_filter(spark, built):
    np.save(built / "v.npy", np.array([[10.0, 1.0]], np.float32))
    qs = spark.createDataFrame([("0", "mốc giới")], "qid string, text string")
    v = spark.createDataFrame([("0", [10.0, 1.0])], "qid string, embedding array<float>")
    hits = P.search(spark, str(built / "index"), qs, P.SearchConfig("hybrid", 3, 5), v)
    assert hits.count() == 3
    only = P.search(spark, str(built / "index"), qs, P.SearchConfig("hybrid", 3, 5), v, where=F.col("document_id") == 2)
    assert {r.id for r in only.collect()} == {"doc:2:chunk:00000"}
    got = P.answer(only, qs).first()
    assert got.relevant_articles == ["2/2021/NĐ-CP|Đất|Điều 5"]
    assert cli.main(["search", str(built / "index"), str(built / "q.json"), str(built / "hits")]) == 0


@pytest.mark.parametrize("bad", [{"x": 1}, {"search": {"mode": "none"}}, {"search": {"threshold": 1.0}}, {"search": {"weights": "0,0"}}, {"build": {"size": 3}}])
def test_config_errors(bad):
    with pytest.raises(ValueError):
        P.FlowConfig.from_mapping(bad)


def test_config():
    c = P.FlowConfig.from_mapping({"search": {"weights": "3:1", "rerank": True}, "build": {"max_tokens": 100}})
    assert c.search.weights == (3.0, 1.0) and c.build.max_tokens == 100


def test_entry(spark, tables):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and set(e.oracle_sql()) <= set(e.queries())
