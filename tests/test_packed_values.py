import pytest
from hypothesis import given
from hypothesis import strategies as st

from granary.operators.packed_values import Names, explode_packed, split_values

SECTORS = Names(["Đất đai", "Đo đạc, bản đồ", "Nhà ở - Đô thị", "Thể thao", "Văn hóa - Thể thao", "Việc làm"])


@pytest.mark.parametrize(
    "field, values",
    [
        (None, []), ("", []), ("   ", []), (";;|", []),
        ("Đo đạc, bản đồ, Việc làm", ["Đo đạc, bản đồ", "Việc làm"]),
        ("Nhà ở - Đô thị - Đất đai", ["Nhà ở - Đô thị", "Đất đai"]),
        ("VĂN HÓA - THỂ THAO | việc làm", ["VĂN HÓA - THỂ THAO", "việc làm"]),
        ("1) Đất đai; 2) Đo đạc, bản đồ", ["Đất đai", "Đo đạc, bản đồ"]),
        ("(1) Đất đai (2) Việc làm", ["Đất đai", "Việc làm"]),
        ('["Đất đai", "Đo đạc, bản đồ"]', ["Đất đai", "Đo đạc, bản đồ"]),
        ("|Đất đai|«Việc làm»|", ["Đất đai", "Việc làm"]),
    ],
)
def test_sectors(field, values):
    assert split_values(field, SECTORS, dash=True) == values


@pytest.mark.parametrize(
    "field, values",
    [
        ('Vi Bích Ân , "Vi Ngọc Lãm ""Tư Ân"""', ["Vi Bích Ân", 'Vi Ngọc Lãm "Tư Ân"']),
        ('["A \\"B\\"", "C"]', ['A "B"', "C"]),
        ('“Khúc "Tư Miên"” , Viên', ['Khúc "Tư Miên"', "Viên"]),
        ('Cù Sĩ "Tư, Kha"; X', ['Cù Sĩ "Tư, Kha"', "X"]),
        ("A (Chủ tịch, ký thay), B", ["A (Chủ tịch, ký thay)", "B"]),
        ("A (Viện phó / thừa) / B & C", ["A (Viện phó / thừa)", "B", "C"]),
        ("A, B và C", ["A", "B", "C"]),
        ("'A'\r\nB\tC", ["A", "B", "C"]),
        ('"A', ['"A']),
        ("(1) A\n(2) KT. Bộ trưởng B", ["A", "KT. Bộ trưởng B"]),
    ],
)
def test_signers(field, values):
    assert split_values(field, words=("và",)) == values


@given(st.text(max_size=60))
def test_never_fails_and_never_blank(field):
    for v in split_values(field, SECTORS, dash=True, words=("và",)):
        assert v and v == v.strip()


@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\\", exclude_categories=["Z", "C"]), min_size=1, max_size=8), min_size=1, max_size=5))
def test_quoted_round_trip(values):
    field = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_values(field) == values


def test_long_text_is_linear():
    assert len(split_values(";".join(["abc"] * 100_000))) == 100_000


def test_explode(spark):
    rows = [(1, "a;b", None, 9), (1, "a;b", None, 9), (2, None, "x", 9), (3, "", "", 9), (None, "z", None, 9)]
    df = spark.createDataFrame(rows, "id bigint, s string, t string, pos int")
    got = explode_packed(df, "id", {"s": {}, "t": {}}).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "s", 1, "a"), (1, "s", 2, "b"), (2, "t", 1, "x"), (None, "s", 1, "z")], key=repr)
    assert explode_packed(df.limit(0), "id", {"s": {}}).count() == 0
