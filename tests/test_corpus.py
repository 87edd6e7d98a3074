import json

from pyspark.sql import functions as F

from granary.operators import corpus, qa
from granary.sources import readers, writers
from granary.streaming import incremental


def test_fill_status(spark):
    m = spark.createDataFrame([(1, None, "x"), (2, " ", "x"), (3, "cũ", "x"), (4, None, "x")], "id int, effect_status string, s_x string")
    s = spark.createDataFrame([(1, "mới"), (1, ""), (2, "b"), (2, "a"), (3, "khác")], "id int, effect_status string")
    assert {r.id: r.effect_status for r in corpus.fill_status(m, s).collect()} == {1: "mới", 2: "b", 3: "cũ", 4: ""}


def test_upsert_and_occurrence(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert {(r.id, r.v) for r in corpus.upsert(old, new, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    o = corpus.occurrence(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, v string"), F.col("v"), [F.col("id")])
    assert {(r.id, r.occurrence) for r in o.collect()} == {(1, 0), (2, 1), (3, 0)}


def test_latest_of_few(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", None), (3, "d", 1), (3, "e", None), (None, "f", 1), (None, "g", 2)]
    df = spark.createDataFrame(rows, "id int, v string, t int")
    order = [F.col("t").desc_nulls_last()]
    want = {(r.id, r.v) for r in corpus.latest(df, ["id"], order).collect()}
    for most in (1_000_000, 0):
        got = corpus.latest_of_few(df, "id", order, most).collect()
        assert {(r.id, r.v) for r in got} == want and len(got) == 4
    assert want == {(1, "b"), (2, "c"), (3, "d"), (None, "g")}


def test_title_map(spark):
    rows = [("L1", "Luật", 1), ("L1", "Luật số 1 tên dài", 2), ("L1", "Luật số 1 tên khác", 3), ("L2", "Một cái tên rất dài không số", 1), ("L2", "số 2 ngắn", 2), (None, "x", 1)]
    df = spark.createDataFrame(rows, "k string, t string, n int")
    got = corpus.title_map(df, "k", "t", F.col("t").contains("số 1"), ["n"]).collect()
    assert {r.k: r.title for r in got} == {"L1": "Luật số 1 tên khác", "L2": "Một cái tên rất dài không số"}


def test_matches_stored(spark):
    a = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, None)], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", "z"), (2, "x", "n"), (3, "x", "y")], "id int, p string, q string")
    assert {r.id: r.matches for r in corpus.matches_stored(a, b, "id", ["p", "q"]).collect()} == {1: True, 2: False, 3: False}


def test_questions_files(spark, tmp_path):
    for name, text in (("a.json", json.dumps({"questions": [{"id": "7", "question": "A?"}, {"question": "B?"}]})), ("b.jsonl", '{"id": "7", "query": "A?"}\n\n{"text": "B?"}\n'), ("c.csv", "id,question\n7,A?\n,B?\n")):
        p = tmp_path / name
        p.write_text(text)
        assert [(r.id, r.question) for r in readers.questions(spark, str(p)).orderBy("pos").collect()] == [("7", "A?"), ("1", "B?")], name
    p = tmp_path / "d.json"
    p.write_text(json.dumps({"1": "A?", "2": "B?"}))
    assert {(r.id, r.question) for r in readers.questions(spark, str(p), start_id=2).collect()} == {("2", "B?")}


def test_sub_queries_and_ids(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text(json.dumps({"1": ["điều kiện", "thủ tục"]}))
    assert readers.sub_queries(spark, str(p)).first().sub_queries == ["điều kiện", "thủ tục"]
    p = tmp_path / "i.txt"
    p.write_text("3, 1\n2 1\n")
    assert sorted(r.id for r in readers.id_list(spark, str(p)).collect()) == [1, 2, 3]
    assert readers.csv_text(spark, str(tmp_path / "none.csv"), ["a"]).count() == 0


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "đ")], "id int, b string")
    writers.json_lines(df.coalesce(1), str(tmp_path / "j"))
    lines = "".join(f.read_text() for f in (tmp_path / "j").glob("*.json")).splitlines()
    assert {json.loads(x)["id"]: json.loads(x)["b"] for x in lines} == {1: "đ", 2: None} and all(x.index('"b"') < x.index('"id"') for x in lines)
    writers.submission(df, str(tmp_path / "s.json"))
    assert [r["id"] for r in json.loads((tmp_path / "s.json").read_text())] == [1, 2]
    writers.flat_zip(str(tmp_path / "s.json"), str(tmp_path / "s.zip"))
    assert writers.report(df.filter("id = 1"), str(tmp_path / "r.json")) == {"id": 1, "b": "đ"}
    out = str(tmp_path / "t")
    assert writers.append_new(df, out, "id") == 2 and writers.append_new(df, out, "id") == 2
    assert spark.read.parquet(out).count() == 2
    writers.index_points(df, str(tmp_path / "p"), 4)
    assert writers.lookup(spark.read.parquet(str(tmp_path / "p")), df.filter("id = 2"), buckets=4).count() == 1


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", None)], "id int, v string, t int").write.parquet(src)
    schema = spark.read.parquet(src).schema
    for state in ("s1", "s2"):
        incremental.ingest(incremental.file_stream(spark, src, schema), out, str(tmp_path / state), "id", order="t").awaitTermination()
    assert {(r.id, r.v) for r in spark.read.parquet(out).collect()} == {(1, "b"), (2, "c")}


def test_answers(spark):
    rows = [("q1", 1, 0.9, "1/2020", "Luật A", "Điều 17", "nội dung"), ("q1", 2, 0.8, "1/2020", "Luật A", "Điều 17", "khác"), ("q2", 1, 0.5, None, None, None, "x")]
    hits = spark.createDataFrame(rows, "qid string, rank int, score double, number string, title string, article string, text string")
    ctx = qa.context_rows(hits).withColumn("question", F.lit("?"))
    r = {x.qid: x for x in ctx.collect()}
    assert r["q1"].relevant_docs == ["1/2020|Luật A"] and r["q1"].allowed_articles == ["Điều 17"] and len(r["q1"].contexts) == 2
    assert r["q2"].relevant_articles == [] and r["q2"].allowed_articles == []

    def model(chats):  # names a wrong article at first, and again in the second try
        return ["<think>x</think>Theo Điều 8" for _ in chats]

    got = {x.qid: x for x in qa.answer_questions(ctx, model).collect()}
    assert got["q1"].answer == qa.FALLBACK + "Điều 17." and got["q1"].repaired
    got = {x.qid: x for x in qa.answer_questions(ctx, lambda c: ["Theo Điều 17." for _ in c]).collect()}
    assert got["q1"].answer == "Theo Điều 17." and not got["q1"].repaired
    assert {x.answer for x in qa.answer_questions(ctx, None, "empty").collect()} == {""}


def test_picks():
    assert qa.picks_of('```json\n{"selected": [2, 2, 9]}\n```', 3) == [2]
    assert qa.picks_of("không có", 3) == [] and qa.picks_of("[1, true, \"3\"]", 3) == [1, 3]
    assert qa.fit_texts(["a" * 10, "b" * 4], 10, len) == ["a" * 6, "b" * 4]
