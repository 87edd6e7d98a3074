import unicodedata

import numpy as np
import pytest

from granary.llm.letterform import consistent_text
from granary.llm.markup import clean_text, content_threshold, html_events, no_content, residue, smoothed_ratios, split_code, structure, without_markup

CASES = [
    ("Кhi có", "Khi có"), ("ＳỐ：１２", "SỐ:12"), ("tha\u200bm\xadgia", "thamgia"), ("a\xa0b\u3000c", "a b c"), (unicodedata.normalize("NFD", "Điều ước"), "Điều ước"),
    ("Ðiều Ɖất", "Điều Đất"), ("Chương Ⅲ", "Chương III"), ("5 \u212a", "5 K"), ("vӑn", "văn"), ("số‑1", "số-1"), ("a\x08b", "ab"),
    ("«договор о границе» và", None), ("β = 2 và α", None), ("630 m² – “x” …", None), ("dòng\r\nhai\tba", None), ("", None), ("'' ; DROP", None),
]


def test_forms(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)] + [(99, None)], "id bigint, x string")
    got = {r.id: r for r in consistent_text(df, "id", ["x"]).collect()}
    for i, (text, form) in enumerate(CASES):
        assert (got[i].form, got[i].affected) == (text if form is None else form, form is not None), text
    assert 99 not in got
    hit = {r.id for r in consistent_text(df, "id", ["x"], texts=False).collect()}
    assert hit == {i for i, (_, f) in enumerate(CASES) if f is not None}
    again = consistent_text(consistent_text(df, "id", ["x"]).select("id", "form"), "id", ["form"], texts=False)
    assert again.count() == 0
    assert consistent_text(df.limit(0), "id", ["x"]).count() == 0


@pytest.mark.parametrize(
    "text, langs",
    [
        ("thường a < 4 và b > 10, hệ số 5 * 7 * 2 (*) [6] R&D $ 239 và $ 304 BM_32_A ~ x ~ | a | - b", set()),
        ("", set()), ("<p>x", {"html"}), ("x &nbsp; y", {"html"}), ("x<!-- y -->", {"html"}), ("<truong>x</truong>", set()),
        ("### Điều 1", {"markdown"}), ("a **b** c", {"markdown"}), ("a __b c__ d", {"markdown"}), ("![a](https://x/1.png)", {"markdown"}), ("~~a~~", {"markdown"}), ("x `a` y", {"markdown"}), ("> trích", {"markdown"}),
        ("```\n<p>x</p>\n$a_1$\n```", {"markdown"}), ("== A ==", {"wiki"}), ("a [[b|c]]", {"wiki"}), ("''a''", {"wiki"}), ("{{a|b}}", {"wiki"}), ("[https://x.y a]", {"wiki"}),
        ("\\textbf{a}", {"latex"}), ("a \\\\\nb", {"latex"}), ("$x_{1}$", {"latex"}), ("\\[ x \\]", {"latex"}), ("<b>a</b> **c**", {"html", "markdown"}),
    ],
)
def test_residue(text, langs):
    assert residue(text) == langs


@pytest.mark.parametrize(
    "text, html",
    [
        ("<!DOCTYPE html>\nx", True), ('<?xml version="1.0"?> x', True), ("x &nbsp y", True), ("x&nbsp", True), ('<a title="x < y">z</a', True),
        ("R&D & AT&T", False), ("https://x.y/?a=1&copy=2&section=3", False), ("a <b và c<d, e> f", False), ("x <!-- y", False), ("a <? b > c", False),
    ],
)
def test_html_events(spark, text, html):
    df = spark.createDataFrame([("content", "1", text)], "item_kind string, item_key string, text string")
    assert [r.markup for r in without_markup(df, texts=False).collect()] == [["html"]] * html
    clean = without_markup(df).first().clean
    assert not any(x in clean for x in ("<!D", "<?xml", "&nbsp", "<a")) if html else clean == text


def test_clean_keeps_structure():
    text = "<h1>Tên</h1>\n<ul><li>một</li><li>hai</li></ul>\n<pre>a &lt; b</pre>\nx \\cite{k} $y_{1}$ \\textbf{đ}\n== Mục ==\n**đậm** [[a|b]]"
    clean, found = clean_text(text)
    assert found == {"html", "latex", "markdown", "wiki"}
    kinds = [(s["kind"], s["text"]) for s in structure(clean)]
    for want in (("heading", "Tên"), ("list", "một"), ("list", "hai"), ("code", "a < b"), ("formula", "y_{1}"), ("heading", "Mục")):
        assert want in kinds
    for gone in ("<", "\\cite", "\\textbf", "**", "[["):
        assert gone not in clean.replace("a < b", "")
    assert "đậm" in clean and "đ" in clean


def test_clean_unwraps_any_depth():
    assert clean_text("x " + "\\textbf{" * 9 + "đ" + "}" * 9)[0] == "x đ"


@pytest.mark.parametrize("text", ["không có gì", "dòng\nhai < 3", "```\nx\n```"])
def test_clean_leaves_plain(text):
    assert clean_text(text)[0] == text


def test_ratio_parts():
    r = smoothed_ratios(np.array([0.0, 3.0, 90.0, 95.0]), np.array([4, 2, 0, 1]))
    assert r[0] < r[-1] and r[0] < content_threshold(r) < r[-1]
    assert content_threshold(np.array([5.0, 5.0])) < 0 and content_threshold(np.array([5.0, 6.0])) < 0 and len(smoothed_ratios(np.zeros(0), np.zeros(0))) == 0
    assert "".join(p for _, p in split_code("a\n```\nx\n```\nb<pre>c</pre>")) == "a\n```\nx\n```\nb<pre>c</pre>"


MENU = ['<ul class="menu">', '<li><a href="/">Trang chủ</a></li>', '<li><a href="/v">Văn bản</a> | <a href="/w">Tin</a></li>', '<li><a href="/l">Liên hệ</a></li>', "</ul>"]
BODY = ["<p>" + "Nội dung của điều này dài hơn nhiều so với một mục. " * 4 + "</p>"] * 5


def test_regions_choose_content():
    text = "\n".join([*MENU, *BODY, '<p><a href="x">Xem Điều 5</a></p>', *BODY])
    on, off = clean_text(text)[0], clean_text(text, threshold=lambda r: -1.0)[0]
    assert "Trang chủ" in off and "Tin" in off
    assert not any(x in on for x in ("Trang chủ", "Văn bản", "Tin", "Liên hệ")) and "Xem Điều 5" in on
    assert on.count("Nội dung") == off.count("Nội dung") == 40
    assert no_content(html_events("\n".join(MENU))) == set()  # nothing but a menu: no second cluster to tell it from
    assert no_content(html_events("không có thẻ")) == set()


@pytest.mark.parametrize(
    "text, clean",
    [
        ("<table>\n<tr>\n<td>a</td>\n<td>b</td>\n</tr>\n<tr><td></td><td>c\nd</td></tr>\n</table>sau", "| a | b |\n|  | c d |\nsau"),
        ("<ul>\n<li>\nmột</li>\n<li><p>hai</p></li>\n</ul>", "- một\n- hai"),
        ("<script>if (a<b) { x('</b>') }</script>chữ<style>p {}</style>", "chữ"), ("<script>không đóng\n<b>đậm</b>", "không đóng\nđậm"),
        ("<tr>dở\nhai", "dở\nhai"), ("x<br>y<br/>\nz", "x\ny\nz"), ("<h2>Đầu</h2>văn &amp; R&D; AT&T &foo; &#65;", "# Đầu\nvăn & R&D; AT&T &foo; A"),
        ("1 <y 2 <z 3 &amp; 4", "1 <y 2 <z 3 & 4"), ("<b>a</b> <Truong> </Truong> </ 5 >", "a <Truong> </Truong> </ 5 >"), ("`<b>` <i>x</i>", "`<b>` x"),
    ],
)
def test_page(text, clean):
    got = "\n".join(x for x in clean_text(text)[0].split("\n") if x.strip())
    assert got == clean


def test_unclosed_constructs_take_linear_time():
    assert clean_text("a <x" * 40_000)[0] == "a <x" * 40_000


def test_frames(spark):
    df = spark.createDataFrame([("content", "1", "<p>a</p>"), ("content", "1", "<p>a</p>"), ("block", "2", None), ("block", "3", "b")], "item_kind string, item_key string, text string")
    assert sorted((r.item_key, r.clean.strip()) for r in without_markup(df).collect()) == [("1", "a"), ("1", "a"), ("3", "b")]
    assert {r.item_key for r in without_markup(df, texts=False).collect()} == {"1"}
    assert without_markup(df.limit(0)).count() == 0
