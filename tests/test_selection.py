import pytest
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import titles as TT
from granary.operators import selection as S


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


HITS = "qid int, id string, score double, rank int, number string, title string, article string, issued string"


@pytest.mark.parametrize(
    "rows, want",
    [
        ([("a", 9.0, 1, "1/VBHN-X", "Văn bản hợp nhất năm 2015 Luật Thuế", "Điều 1", None), ("b", 5.0, 2, "2/VBHN-X", "Văn bản hợp nhất năm 2019 Luật Thuế", "Điều 1", None)], ["b"]),
        ([("a", 9.0, 1, "1/VBHN-X", "Văn bản hợp nhất Luật Thuế", "Điều 1", "01/01/2015"), ("b", 5.0, 2, "2/VBHN-X", "Văn bản hợp nhất Luật Thuế", "Điều 1", "20/12/2019")], ["b"]),
        ([("a", 9.0, 1, "1/VBHN-X", "Văn bản hợp nhất Luật Thuế", "Điều 1", None), ("b", 5.0, 2, "1/VBHN-X", "Văn bản hợp nhất Luật Đất đai", "Điều 1", None)], ["a", "b"]),
        ([("a", 5.0, 1, "1", "Luật A", "Điều 1", None), ("b", 9.0, 2, "1", "LUẬT A;", "điều 1", None), ("c", 1.0, 3, "1", "Luật A", "Điều 2", None)], ["b", "c"]),
        ([("a", 5.0, 1, None, None, None, None), ("b", 5.0, 2, None, " ", None, None)], ["a", "b"]),
    ],
)
def test_one_per_document(spark, rows, want):
    df = spark.createDataFrame([(1, *r) for r in rows], HITS)
    got = S.one_per_document(df, "number", "title", "article", TT.one_list("issued")).orderBy("rank_out").collect()
    assert [r.id for r in got] == want


@pytest.mark.parametrize(
    "answer, n, want",
    [
        ('x ["a", " ", "b"] y', 2, ["a", "b"]), ('["a"]', 3, ["a", "hỏi", "hỏi"]), ("- điều kiện cấp phép\n\n- ngắn\n• thời hạn giải quyết", 2, ["điều kiện cấp phép", "thời hạn giải quyết"]),
        ("không", 2, ["hỏi"]), (None, 2, ["hỏi"]), ("[hỏng", 2, ["hỏi"]), ("[]", 1, ["hỏi"]),
    ],
)
def test_split_answer(answer, n, want):
    assert S.split_answer(answer, n, "hỏi") == want


def test_sub_queries(spark):
    q = spark.createDataFrame([(1, "q1", 2), (2, "q2", 1), (3, "q3", 2), (4, None, 2)], "qid int, text string, n int")
    known = spark.createDataFrame([("1", ["điều kiện", "thủ tục"])], "qid string, sub_queries array<string>")
    answers = spark.createDataFrame([(3, '["a","b","c"]'), (2, '["x"]')], "qid int, answer string")
    got = {(r.qid, r.pos): r.text for r in S.sub_queries(q, answers, known).collect()}
    assert got == {(1, 0): "điều kiện", (1, 1): "thủ tục", (2, 0): "q2", (3, 0): "a", (3, 1): "b", (4, 0): ""}
    assert {r.text for r in S.sub_queries(q).filter("qid = 1").collect()} == {"q1"}


@pytest.mark.parametrize(
    "text, want", [('{"selected": [2, "1", 9, true]}', [2, 1]), ("[3]", [3]), ('{"answerable": false}', []), ('{"selected": "x"}', None), ("không", None), (None, None), ("```json\n{\"indices\": [1]}\n```", [1])]
)
def test_choice_of(text, want):
    assert S.choice_of(text, 3) == want


def test_listwise_scores():
    docs = ["a", "b", "a"]
    assert S.listwise_scores([{"index": 1, "score": 2}, {"document": "a", "relevance_score": 3}, {"document": "a", "score": 1}], docs) == [3.0, 2.0, 1.0]
    assert S.listwise_scores([{"score": 5}, {"corpus_id": "0", "score": 9}, {"index": 7, "score": 1}, "x", {}], docs) == [5.0, 0.0, 0.0]
    assert S.listwise_scores([], []) == []


def test_prompts_and_selection(spark):
    pool = spark.createDataFrame([(1, "a", 1, "x " * 50), (1, "b", 2, "y"), (2, "c", 1, None)], "qid int, id string, rank int, text string")
    got = {r.qid: r for r in S.candidate_prompts(pool, "text", 12, lambda t: len(t.split())).collect()}
    assert got[1].n_candidates == 2 and got[1].prompt.startswith("[1]\nx x") and got[1].prompt.endswith("[2]\ny") and len(got[1].prompt.split()) <= 14 and got[2].prompt == "[1]\n"
    chosen = S.select_candidates(pool, spark.createDataFrame([(1, "[2]"), (2, "?")], "qid int, answer string"), 1).collect()
    assert {(r.qid, r.id, r.rank_out) for r in chosen} == {(1, "b", 1), (2, "c", 1)}


def test_branches_take_turns(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"], ["t"]), (1, 2, ["c", "a", "d"], ["u"])], "qid int, domain_rank int, numbers array<string>, topics array<string>")
    assert [(r.kind, r.value) for r in S.branches(df).orderBy("branch_no").collect()] == [("number", "a"), ("number", "c"), ("number", "b"), ("topic", "t")]


def test_valid_only(spark):
    df = spark.createDataFrame([(1, "a", 1, "1/2020", "Căn cứ Luật"), (1, "b", 2, "1/2020", "Luật A"), (1, "c", 3, " ", "Luật B"), (1, "d", 4, "2", "---"), (1, "e", 5, "2", "Luật C")], "qid int, id string, rank int, n string, t string")
    assert [(r.id, r.rank) for r in S.valid_only(df, "qid", F.col("n"), F.col("t"), 5).orderBy("rank").collect()] == [("b", 1), ("e", 2)]


@pytest.mark.parametrize(
    "file, number, want", [("12_2020_NĐ-CP_Về_thuế.txt", "12/2020/NĐ-CP", "Về thuế"), ("/x/a_b_Tên_luật.docx", "", "Tên luật"), ("tên_luật.txt", "9/2", "tên luật"), (None, None, "")]
)
def test_title_of_file(spark, file, number, want):
    assert one(spark, TT.title_of_file("f", "n"), f=file, n=number) == want


def test_repaired_title(spark):
    v = lambda **k: one(spark, TT.repaired_title("t", "f", "x", "n"), **k)
    assert v(t="Luật A", f=None, x=None, n="1") == "Luật A"
    assert v(t="Căn cứ B", f="1_2_Tên.txt", x=None, n="") == "Tên"
    assert v(t="--", f="", x="Luật 45/2019 Lao động\nsau", n="45/2019") == "Lao động"
    assert v(t=None, f=None, x="Dòng đầu\nhai", n=None) == "Dòng đầu"


@pytest.mark.parametrize(
    "make, values, want",
    [
        (lambda: TT.numbers(F.col("v")), {"v": ["12/2022/ND-CP", "12/2022/nđ-cp", " ", "1/QD-TTg"]}, ["12/2022/NĐ-CP", "1/QĐ-TTg"]),
        (lambda: TT.subject_title("t"), {"t": "Văn bản hợp nhất 12/VBHN-BTC ngày 01/02/2015 do Bộ Tài chính ban hành Luật Thuế của Quốc hội"}, "luật thuế"),
        (lambda: TT.first_article(F.col("v")), {"v": ["", "xem điều 12a", "Điều 3"]}, "Điều 12a"), (lambda: TT.reasonable_title(F.col("v")), {"v": ["Điều 12", "ngắn", "(Luật Doanh nghiệp)"]}, "Luật Doanh nghiệp"),
        (lambda: TT.header_title("h", "a"), {"h": "Luật Số 1 Điều 5 Phạm vi", "a": "Điều 5"}, "Luật Số 1"), (lambda: TT.bare_article("a"), {"a": "Điều 1"}, "1"), (lambda: TT.article_label("a", "t"), {"a": "", "t": "theo điều 7b"}, "Điều 7b"),
        (lambda: TT.without_related("n"), {"n": "Luật A Điều 14.2.TT.3.1. x (Điều này có nội dung liên quan đến B)"}, "Luật A"), (lambda: TT.without_related("n"), {"n": "Luật A (Điều này có nội dung liên quan đến B)"}, "Luật A"),
        (lambda: TT.article_title("a"), {"a": "Điều 1. Phạm vi"}, "Phạm vi"), (lambda: TT.better_title("a", "b", "n"), {"a": "Luật 1/2020", "b": "Luật 1/2020 Thuế", "n": "1/2020"}, "Luật 1/2020 Thuế"),
        (lambda: TT.better_title("a", "b", "n"), {"a": "Luật 1/2020 Thuế thu nhập", "b": "Luật 1/2020 Thuế", "n": "1/2020"}, "Luật 1/2020 Thuế thu nhập"), (lambda: TT.shortened("t", 8), {"t": "một hai ba"}, "một h..."), (lambda: TT.indented("t"), {"t": "a\nb"}, "  a\n  b"),
        (lambda: TT.repeats_number("t", "n"), {"t": "1/2 1/2 x", "n": "1/2"}, True), (lambda: TT.repeats_number("t", "n"), {"t": "1/2", "n": "1/2"}, False), (lambda: TT.number_hit("t", ["12/2022/nd-cp"]), {"t": "theo 12/2022/NĐ-CP"}, True),
        (lambda: F.size(TT.source_links("j")), {"j": '[{"text":"a","href":null},{"text":" ","href":""}]'}, 1), (lambda: F.size(TT.source_links("j")), {"j": "{hỏng"}, 0), (lambda: F.size(TT.source_links("j")), {"j": None}, 0),
        (lambda: TT.issue_key(F.col("v"), F.lit("năm 2012"))["y"], {"v": ["không", "31/02/2015"]}, 2015), (lambda: TT.issue_key(F.col("v"), F.lit("Luật năm 2012"))["y"], {"v": []}, 2012),
        (lambda: X.law_ids("t"), {"t": "45/2019/CPX, 123456/2020/QH14, 7/2021/QH15."}, ["2020/QH14", "7/2021/QH15"]), (lambda: TT.chunk_key("d", "c", "p", F.lit("f")), {"d": None, "c": None, "p": "x"}, "x"),
    ],
)
def test_title_functions(spark, make, values, want):
    assert one(spark, make(), **values) == want


def test_resume_on_a_uri(spark, tmp_path):
    from granary.sources import writers

    out = f"file://{tmp_path}/t"
    df = spark.createDataFrame([(1, "a"), (None, "b")], "id int, x string")
    assert writers.append_new(df, out, "id") == 2 and writers.append_new(df, out, "id") == 2
    assert spark.read.parquet(out).count() == 2
