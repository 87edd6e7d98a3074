import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.words import Words, bare, word_hashes


@pytest.mark.parametrize("a, b", [("Điều ước", "ĐIỀU ƯỚC"), ("ＳỐ １２", "số 12"), ("Кhi có", "khi có"), ("tha\u200bm", "tham"), ("Ðiều", "Điều"), ("Ⅲ", "III"), ("a\xa0b", "a b")])
def test_same_words(a, b):
    assert word_hashes(a) == word_hashes(b)


@pytest.mark.parametrize("a, b", [("thuế", "thuê"), ("ab", "ba"), ("a b", "ab"), ("điều", "dieu")])
def test_other_words(a, b):
    assert word_hashes(a) != word_hashes(b)


@given(st.text("aăâeêđoôơuưáàảãạấầẩẫậ ,.\n", max_size=40))
@settings(max_examples=200, deadline=None)
def test_composition_does_not_matter(text):
    assert word_hashes(unicodedata.normalize("NFD", text)) == word_hashes(text)


def test_rows_lines_and_ngrams():
    w = Words(pa.array(["một hai\nba", None, "", ", \n", "bốn"]), plain=True, sentences=True)
    assert w.row.tolist() == [0, 0, 0, 4] and w.line.tolist() == [0, 0, 1, 0]
    g, r = w.ngrams(2)
    assert r.tolist() == [0, 0]
    assert Words(pa.array([], pa.string())).hash.tolist() == []


def test_bare_keeps_lines():
    text = "<p>a</p>\n**b** [c](http://x)\n\\textbf{d} $x_1=\\frac{1}{2}$\n[[e|f]] {{g|h|i=1}} &nbsp;&#7913;<!-- z -->"
    got = bare(text)
    assert got.count("\n") == 3 and "frac" not in got and "http" not in got and "f" in got and "h" in got and "ứ" in got
