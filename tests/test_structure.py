import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.operators import chunking as C
from granary.operators import hierarchy as H
from granary.operators import segments

TEXT = """BỘ XÂY DỰNG
Chương I
QUY ĐỊNH CHUNG
Điều 1. Phạm vi
1. Khoản một.
a) Điểm a;
- gạch đầu dòng
2. Khoản hai.
| TT | Tên |
|---|---|
| 1 | x |
| 2 | y |
Điều 2. Hiệu lực
Nơi nhận:
- Như trên."""


def test_parse():
    n = H.parse(TEXT, "T", "1/2020")
    assert [(x.kind, x.label) for x in n] == [("document", "T"), ("chapter", "Chương I"), ("article", "Điều 1"), ("clause", "Khoản 1"), ("point", "Điểm a"), ("subpoint", "-"), ("clause", "Khoản 2"), ("article", "Điều 2"), ("footer", "Footer")]
    assert n[1].title == "QUY ĐỊNH CHUNG" and n[4].parent is n[3] and n[5].parent is n[4]
    table = n[6].blocks[-1]
    assert (table["type"], table["headers"], table["rows"]) == ("table", ["TT", "Tên"], [["1", "x"], ["2", "y"]])


def test_parse_keeps_every_word():
    n = H.parse(TEXT, "", "")
    kept = " ".join(b["text"] for x in n for b in x.blocks) + " ".join(x.title for x in n)
    assert all(w in kept for w in ("Khoản", "gạch", "Hiệu", "trên."))


@settings(max_examples=60, deadline=None)
@given(st.text("Điều 12.\n|-ab) PHỤLC", max_size=200))
def test_parse_any(text):
    n = H.parse(text)
    assert n[0].kind == "document" and all(x.parent is not None for x in n[1:])
    C.chunk_tree(n, 200, 20)


def test_parse_documents(spark):
    df = spark.createDataFrame([(1, TEXT, "T", None), (2, None, None, None), (3, "", None, "x")], "id bigint, text string, title string, number string")
    got = H.parse_documents(df, "id", "text").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 9, 3: 1}
    assert H.parse_documents(df.limit(0), "id", "text").count() == 0


def test_marked_paths():
    p = C.split_marked("1. Cha một hai ba 1.1. con thứ nhất có nhiều chữ 1.2. con thứ hai có nhiều chữ hơn nữa", 25, 5)
    assert [x[1] for x in p] == [["1", "1.1"], ["1", "1.2"]] and all(x[0].startswith("1. Cha") for x in p)
    p = C.split_marked("3. Mục ba bốn 3.1. phần con a. nội dung đầu tiên khá dài ở đây b. nội dung sau khá dài ở đây", 25, 5)
    assert [x[1] for x in p] == [["3", "3.1", "a"], ["3", "3.1", "b"]]
    p = C.split_marked("1. một hai ba bốn 2. năm sáu bảy tám 3. chín mười", 14, 0)
    assert [x[1] for x in p] == [["1", "2"], ["3"]] and p[0][2] == "tree_packed"
    assert C.split_marked("ngắn", 10) == [("ngắn", [], "article")] and C.split_marked(" ", 10) == []


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["một", "hai.", "ba,", "bốn;", "5.", "a)"]), max_size=120), st.integers(3, 40), st.integers(0, 10))
def test_split_text_budget_and_order(words, budget, overlap):
    words = [f"w{i}{w}" for i, w in enumerate(words)]  # each its own, so that a piece has one place
    text = " ".join(words)
    count = lambda t: len(t.split())
    parts = C.split_text(text, budget, overlap, count)
    assert all(count(p) <= budget for p in parts)
    at = 0
    flat = [p.split() for p in parts]
    for p in flat:  # every piece is a run of the text, and together they cover it
        start = next(i for i in range(at + 1) if words[i : i + len(p)] == p and i + len(p) > at or not p)
        at = start + len(p)
    assert at == len(words)


def test_chunk_tree_budget():
    long = "Điều 1. Tên\n" + "\n".join(f"{i}. " + "chữ " * 60 for i in range(1, 9))
    c = C.chunk_tree(H.parse(long, "T", "1"), 200, 20)
    assert len(c) > 2 and all(C.estimate(x["text"]) <= 192 for x in c) and {x["article_no"] for x in c} == {"Điều 1"}
    assert [x["chunk_index"] for x in c] == list(range(len(c))) and {x["chunk_count"] for x in c} == {len(c)}


def test_table_rows_grouped():
    t = "Điều 1. Bảng\n| A | B |\n|---|---|\n" + "\n".join(f"| {i} | x |" for i in range(10))
    c = [x for x in C.chunk_tree(H.parse(t), 500, 0, table_rows=4) if x["chunk_type"] == "table_chunk"]
    assert [(x["row_start"], x["row_end"]) for x in c] == [(1, 4), (5, 8), (9, 10)]


def test_word_windows(spark):
    df = spark.createDataFrame([(1, " ".join(map(str, range(10)))), (2, ""), (3, None), (4, "a")], "id int, t string")
    got = segments.word_windows(df, "id", "t", int(4 * 1.35) + 1, int(1 * 1.35) + 1).orderBy("id", "piece_no").collect()
    assert [(r.id, r.piece) for r in got] == [(1, "0 1 2 3"), (1, "3 4 5 6"), (1, "6 7 8 9"), (4, "a")]


def test_heading_segments(spark):
    df = spark.createDataFrame([(1, "mở đầu\nĐiều 1. A\nx\n<p>Điều 2. B</p>"), (2, None), (3, "  ")], "id int, t string")
    got = segments.heading_segments(df, "id", "t").orderBy("segment_no").collect()
    assert [(r.segment_no, r.article_no, r.segment) for r in got] == [(0, "", "mở đầu"), (1, "Điều 1", "Điều 1. A\nx"), (2, "Điều 2", "<p>Điều 2. B</p>")]


@pytest.mark.parametrize("line, yes", [("QUY ĐỊNH CHUNG", True), ("Quy định chung", False), ("DANH MỤC.", False), ("", False), ("x" * 300, False)])
def test_is_title(line, yes):
    assert H.is_title(line) is yes


def test_capital_line_near_the_top_is_a_heading():
    n = H.parse("BỘ TRƯỞNG\nĐiều 1. A")
    assert [(b["type"], b["text"]) for b in n[0].blocks] == [("heading", "BỘ TRƯỞNG")]


def test_caption_goes_back_over_tables():
    n = H.parse("TÊN BẢNG\n| a |\n| 1 |\n\n| b |\n| 2 |\nthường\n| c |")
    assert [b["caption"] for b in n[0].blocks if b["type"] == "table"] == ["TÊN BẢNG", "TÊN BẢNG", ""]


@pytest.mark.parametrize("line, yes", [("KT. BỘ TRƯỞNG", False), ("KT.BỘ TRƯỞNG", True), ("Bộ trưởng", True), ("Bộ trưởngx", False), ("Nơi nhận:", True), ("Chủ tịch,", True)])
def test_is_closing(line, yes):
    assert H.is_closing(line) is yes


def test_table_after_signatures_opens_an_appendix():
    n = H.parse("Nơi nhận:\n| Tải về | x |\n| TT | Tên |")
    assert [x.kind for x in n] == ["document", "footer", "appendix"] and n[2].label == H.AFTER_SIGNATURES
    assert n[2].blocks[0]["type"] == "attachment"


def test_marks_need_their_parents():
    assert [x.kind for x in H.parse("1. a\na) b\n- c")] == ["document"]
    assert [x.kind for x in H.parse("Phụ lục I\nMục 1\nĐiều 1\n1. a\n- b\nI. Phần\nDanh mục x")][1:] == ["appendix", "section", "article", "clause", "subpoint", "appendix_section", "appendix"]


def test_leaf_goes_down_the_separators():
    p = C.split_marked("1.1. đoạn một, đoạn hai; đoạn ba, đoạn bốn; đoạn năm, đoạn sáu", 12, 0)
    assert len(p) > 1 and all(x[0][-1] in ",;." for x in p[:-1])
    assert [x[0] for x in C.split_marked("1. " + "một " * 30, 10, 0)][1] == " ".join(["một"] * 8)
    p = C.split_marked("1.1. " + " ".join(f"nội dung {i}." for i in range(30)), 20, 3)
    assert p[0][0].startswith("1.1. nội dung")
    assert C.split_marked("1.3. Tổ chức chính trị - xã hội, tổ chức xã hội nghề nghiệp.", 8, 2)[0][1] == ["1.3"]
    p = C.split_marked("1. Cha là. 1.1. Lập hồ sơ một. 1.2. Nộp báo cáo hai. 1.3. Lưu chứng từ ba.", 18, 0)
    assert [(x[1], x[2]) for x in p] == [(["1", "1.1", "1.2"], "tree_packed"), (["1", "1.3"], "tree_subtree")]


def test_overlap_of_a_long_last_sentence_is_its_end():
    text = "a b c d e f g h. i j k l m n o p. q r s t."
    assert C.split_text(text, 9, 2, lambda t: len(t.split())) == ["a b c d e f g h.", "i j k l m n o p.", "o p. q r s t."]


def test_long_article_in_linear_time():
    text = "\n".join(f"Điều {i}. T\n1. một hai" for i in range(3000))
    assert len(C.chunk_tree(H.parse(text), 300)) == 3000


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["Điều 1. T", "1. " + "x " * 90, "2. y", "a) " + "z " * 150, "b) t", "- u", "chữ " * 40, "| A | B |", "| 1 | 2 |", ""]), max_size=30))
def test_chunks_cover_articles(lines):
    nodes = H.parse("\n".join(lines), "T", "1")
    words = lambda t: len(t.split())
    chunks = C.chunk_tree(nodes, 170, 0, 2, words)
    inside = [b["text"] for n in nodes if any(x.kind == "article" for x in n.chain) and n.kind in C.INDEXED for b in n.blocks if b["type"] == "text"]
    assert "".join("".join(C.surface(n, b["text"]).split()) for n in nodes if any(x.kind == "article" for x in n.chain) for b in n.blocks if b["type"] == "text") == "".join("".join(c["text"].split()) for c in chunks if c["chunk_type"] not in ("table_chunk", "article_title_chunk")) or not inside
    assert all(words(c["text"]) <= 170 for c in chunks)


def test_audit(spark):
    from granary.operators import audit

    d = spark.createDataFrame([(1, "Điều 1. A\n| Điều 2 |\nSố Điều 3\nMục 1\nLẠ LÙNG"), (2, None)], "id int, t string")
    n = H.parse_documents(d.selectExpr("id", "t", "'' title", "'' number"), "id", "t")
    got = {r.node_type: (r.n_lines, r.n_nodes, r.n_differing) for r in audit.raw_against_tree(d, n, "id", "t").collect()}
    assert got["article"] == (1, 1, 0) and got["section"] == (1, 1, 0) and got["part"] == (0, 0, 0)
    assert [tuple(r) for r in audit.unknown_headings(d, "id", "t", "^Điều").collect()] == [("LẠ LÙNG", 1, 1)]
    x = spark.createDataFrame([("b", 1), ("a", 2), ("a", 3), ("b", 4), ("c", 5)], "v string, p int")
    assert [(r.v, r["count"], r["rank"]) for r in audit.most_common(x, "v", ["p"], 2).orderBy("rank").collect()] == [("b", 2, 1), ("a", 2, 2)]
