import uuid

import pytest
from pyspark.sql import functions as F

from granary.functions import extract as X
from granary.functions import text as T


def one(spark, expr, *values):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], cols).select(expr).first()[0]


@pytest.mark.parametrize("raw, out", [(None, ""), ("", ""), ("  a \t b\n\nc ", "a b c"), ("　x y", "x y")])
def test_squeeze(spark, raw, out):
    assert one(spark, T.squeeze("c0"), raw) == out


def test_squeeze_lines_keeps_line_ends(spark):
    assert one(spark, T.squeeze_lines("c0"), " a  b\n\n\n\nc\t d \n") == "a b\n\nc d"


def test_clean_lines(spark):
    assert one(spark, T.clean_lines("c0", ["(?iu)^liên hệ"]), "a\n....\n  b \nLIÊN HỆ: x\n\nc") == "a\nb\nc"


def test_marked_ratio(spark):
    assert one(spark, T.marked_ratio("c0"), "ăb1") == 0.5
    assert one(spark, T.marked_ratio("c0"), "123") == 0.0
    assert one(spark, T.marked_ratio("c0"), None) == 0.0


@pytest.mark.parametrize("text, n", [(None, 0), ("   ", 0), ("a", 1), ("a b c", 4)])
def test_token_estimate(spark, text, n):
    assert one(spark, T.token_estimate("c0"), text) == n


@pytest.mark.parametrize(
    "title, number, plain, numbered",
    [
        ("Luật số 04/2017/QH14 hỗ trợ doanh nghiệp nhỏ và vừa", "04/2017/QH14", "Luật Hỗ trợ doanh nghiệp nhỏ và vừa", "Luật 04/2017/QH14 Hỗ trợ doanh nghiệp nhỏ và vừa"),
        ("Nghị định 12/2022/NĐ-CP quy định xử phạt", "12/2022/NĐ-CP", "Nghị định Quy định xử phạt", "Nghị định 12/2022/NĐ-CP Quy định xử phạt"),
        ("Luật Doanh nghiệp. Chương II", "59/2020/QH14", "Luật Doanh nghiệp", "Luật 59/2020/QH14 Doanh nghiệp"),
        (None, None, "", ""),
    ],
)
def test_citation_title(spark, title, number, plain, numbered):
    d = spark.createDataFrame([(title, number)], "t string, n string")
    assert tuple(d.select(T.citation_title("t", "n"), T.citation_title("t", "n", "numbered")).first()) == (plain, numbered)


def test_source_note(spark):
    r = one(spark, X.source_note("c0"), "(Điều 12 Luật số 04/2017/QH14 hỗ trợ doanh nghiệp nhỏ và vừa)")
    assert tuple(r) == ("Luật", "04/2017/QH14", "Luật số 04/2017/QH14 hỗ trợ doanh nghiệp nhỏ và vừa", "Điều 12")
    r = one(spark, X.source_note("c0"), "Điều 14 Pháp lệnh số 06 /2003/PL-UBTVQH11 Dân số, có hiệu lực từ nay")
    assert tuple(r) == ("Pháp lệnh", "06/2003/PL-UBTVQH11", "Pháp lệnh số 06/2003/PL-UBTVQH11 Dân số", "Điều 14")


def test_citations_and_confidence(spark):
    note = "Căn cứ Bộ luật Lao động số 45/2019/QH14 và Nghị định số 12/2022/NĐ-CP."
    d = spark.createDataFrame([(note,), ("Theo quy định của Luật Doanh nghiệp.",), ("",)], "t string")
    ids = X.law_ids("t")
    titles = X.title_candidates("t", F.array(), ids)
    got = d.select(ids.alias("i"), X.citation_confidence("t", ids, titles).alias("c")).collect()
    assert got[0].i == ["12/2022/NĐ-CP", "45/2019/QH14"]
    assert [r.c for r in got] == ["high", "medium", "low"]
    assert one(spark, X.article_numbers("c0"), "(Điều 17 Bộ luật, Điều 2, điều 17)") == ["Điều 17", "Điều 2"]


@pytest.mark.parametrize("text, parts", [("31/02/2020", (2020, 2, 31)), ("ngày 5 tháng 7 năm 2021", (2021, 7, 5)), ("1-2-1999 và 3/4/2000", (1999, 2, 1)), ("không", (0, 0, 0)), (None, (0, 0, 0))])
def test_date_parts(spark, text, parts):
    assert tuple(one(spark, X.date_parts("c0"), text)) == parts


def test_last_year(spark):
    assert one(spark, X.last_year("c0"), "1999 2015") == 2015
    assert one(spark, X.last_year("c0"), "số 9999") is None


@pytest.mark.parametrize("name", ["", "a", "điều 1", "x" * 200])
def test_uuid5(spark, name):
    assert one(spark, X.uuid5(uuid.NAMESPACE_URL, "c0"), name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_join_sentences(spark):
    d = spark.createDataFrame([(["a", "", "b.", " c "],), ([],)], "p array<string>")
    assert [r[0] for r in d.select(T.join_sentences(F.col("p"))).collect()] == ["a. b. c", ""]


def test_refs(spark):
    d = spark.createDataFrame([("1/2020", "Luật", "Điều 1"), ("1/2020", None, "Điều 1"), ("1/2020", "Luật", "")], "n string, t string, a string")
    assert [r[0] for r in d.select(X.article_ref("n", "t", "a")).collect()] == ["1/2020|Luật|Điều 1", "", ""]
