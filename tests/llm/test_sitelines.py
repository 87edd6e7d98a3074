import random

import pytest

from granary.llm.sitelines import site_lines, without_lines

FRAMES = ["{}", "~ {} ~", "[{}]", "<p>{}</p>", "  {}  ", "• {} •", "{} ..."]


def corpus(n=60, sites=("a", "b", "c", "d")):
    rng = random.Random(1)
    rows, truth = [], set()
    for s, site in enumerate(sites):
        for i in range(n):
            key = s * 1000 + i
            lines = ["LIÊN BANG", "Kỷ cương - Sáng tỏ", f"Số: {i}/2020/L-X", f"Điều 1. Tên {rng.random()}", f"Nội dung {rng.random()} riêng {rng.choice('xyz')}{i} của văn bản"]
            own = []
            if i % 2 == 0:
                own.append(f"Lượt xem trang {site}: {rng.randint(0, 10**6)}")
            if i % 3 == 0:
                own.append(f"Người nhập {site}: {rng.choice(['Lê Vân', 'Ban Số', 'Tổ Hai'])} {'X' * (i % 9)}")
            if i == 5:
                own.append(f"Chỉ một lần ở {site}")
            for x in own:
                at = rng.randint(0, len(lines))
                lines.insert(at, rng.choice(FRAMES).format(rng.choice([x, x.upper()])))
            for no, x in enumerate(lines, 1):
                if "lượt xem" in x.lower() or "người nhập" in x.lower():
                    truth.add((key, no))
            rows.append((key, site, "\n".join(lines), "2020-01-01"))
    return rows, truth


SCHEMA = "id bigint, source_site string, content string, crawled_at string"


def test_planted_lines(spark):
    rows, truth = corpus()
    rows += rows[:3] + [(9001, "a", None, None), (9002, "a", "  \r\n", None), (None, "a", "x", None), (9003, None, "y", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found, _ = site_lines(df)
    assert {tuple(r) for r in found.collect()} == truth


def test_threshold_needs_six(spark):
    rows = [(i, "a", "chung một dòng" if i < 5 else f"khác {chr(97 + i)}{i}", None) for i in range(10)]
    assert site_lines(spark.createDataFrame(rows, SCHEMA))[0].count() == 0
    rows = [(i, "a", "chung một dòng" if i < 6 else f"khác {chr(97 + i)}{i}", None) for i in range(10)]
    assert site_lines(spark.createDataFrame(rows, SCHEMA))[0].count() == 6


def test_hot_source_and_repeats(spark):
    rows = [(i % 50, "a", f"dòng chung\nriêng {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 5]}", None) for i in range(500)]
    assert site_lines(spark.createDataFrame(rows, SCHEMA))[0].count() == 50


def test_rebuild(spark):
    rows = [(i, "s", f"a{'bcdefghijk'[i]} riêng\r\n<p>Dòng chung: 1{i}</p>\nc", None) for i in range(10)]
    df = spark.createDataFrame([*rows, (0, "s", rows[0][2] + "\nmới", "2020"), (99, "s", None, None), (98, "s", " ", None), (97, None, "x", None)], SCHEMA)
    found, frequent = site_lines(df)
    got = {r.id: (r.content, r.n_removed) for r in without_lines(df, frequent).collect()}
    assert len(got) == 13 and got[99] == (None, 0) and got[98] == (" ", 0) and got[97] == ("x", 0)
    n = {r.id: r["count"] for r in found.groupBy("id").count().collect()}
    assert got[3] == ("ae riêng\r", 2) and n[3] == 2 and got[0][0].endswith("\nmới")


def test_many_frequent_lines_give_the_same(spark):
    rows, truth = corpus(24)
    df = spark.createDataFrame(rows, SCHEMA)
    found, frequent = site_lines(df, most=0)
    assert {tuple(r) for r in found.collect()} == truth
    one, two = ({tuple(r) for r in without_lines(df, frequent, most=m).collect()} for m in (0, 1000))
    assert one == two and sum(r[3] for r in one) == len(truth)


def test_values_of_the_documents_own_fields_stay(spark):
    rows = [(i, "a", f"BỘ HẠ TẦNG\nLượt xem: {i}\nriêng {'abcdefghij'[i]}", None) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    fields = spark.createDataFrame([("Bộ Hạ tầng",), (None,), ("Bộ Hạ tầng",)], "text string")
    assert {r.line_no for r in site_lines(df)[0].collect()} == {1, 2} and {r.line_no for r in site_lines(df, fields=fields)[0].collect()} == {2}


def test_empty(spark):
    assert site_lines(spark.createDataFrame([], SCHEMA))[0].count() == 0


@pytest.mark.parametrize("n", [1])
def test_extra_columns(spark, n):
    df = spark.createDataFrame([(1, "s", "x", None, 5)], SCHEMA + ", key int")
    assert site_lines(df)[0].count() == 0
