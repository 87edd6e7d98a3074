from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.pieces import cut, split_items


@given(st.lists(st.sampled_from(["a", "điều. ", "\n", "\n\n", "Điều 5. ", "\n1. ", "; ", "xyz" * 30]), max_size=300).map("".join), st.integers(20, 120), st.integers(0, 15))
@settings(max_examples=300, deadline=None)
def test_limits_overlap_and_cover(text, limit, overlap):
    p = cut(text, limit, overlap)
    if not text:
        assert p == []
        return
    assert p[0][0] == 0 and p[-1][1] == len(text)
    assert all(0 < e - s <= limit for s, e in p)
    assert all(a[1] - b[0] == overlap and b[1] > a[1] for a, b in zip(p, p[1:]))


@given(st.text("ab. \n", max_size=200), st.integers(1, 60), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_every_overlap_ends(text, limit, less):
    overlap = max(0, limit - less)
    p = cut(text, limit, overlap)
    assert all(0 < e - s <= limit for s, e in p) and all(a[1] - b[0] == overlap and b[1] > a[1] for a, b in zip(p, p[1:]))
    assert not text or (p[0][0] == 0 and p[-1][1] == len(text))


def test_overlap_of_all_but_one():
    assert len(cut("a" * 40, 10, 9)) == 31


def test_balanced_and_at_boundaries():
    text = "".join(f"Điều {i}. " + "chữ " * 100 + "\n" for i in range(20))
    p = cut(text, 3000, 200)
    assert len(p) in (3, 4) and all(text[e:].startswith("Điều") for _, e in p[:-1])
    sizes = [e - s for s, e in p]
    assert max(sizes) - min(sizes) < 900


def test_no_boundary_at_all():
    assert [e - s for s, e in cut("x" * 7000, 3000, 200)][0] <= 3000


def test_split_items(spark):
    rows = [("content", "1", "x" * 3000), ("content", "2", "x" * 3001), ("content", "2", "x" * 3001), ("chunk", "c", None), ("block", "n/1", "một hai\n" * 800)]
    df = spark.createDataFrame(rows, "item_kind string, item_key string, text string")
    got = split_items(df).collect()
    assert {(r.item_kind, r.item_key) for r in got} == {("content", "2"), ("block", "n/1")}
    assert sum(r.item_key == "2" for r in got) == 4 and split_items(df).distinct().filter("item_key = '2'").count() == 2 and all(len(r.piece) == r.end_at - r.start_at <= 3000 for r in got)
    assert split_items(df.limit(0)).count() == 0
