"""Folded words of a batch of texts as hashes, computed as arrays.

Folding sets aside what does not change how a text reads: letter case, composed
or decomposed accents, full-width and look-alike letters, invisible signs. A
word is a run of letters, digits and accents. Its hash is a polynomial over base
letters; an accent adds to the value of the letter it stands on, whether it
comes composed with it or after it.
"""

from __future__ import annotations

import html
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from granary.llm.pretokens import codepoints, utf8

#: Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
}
#: Latin letters that look like D with stroke.
STROKED = {"Ð": "Đ", "Ɖ": "Đ"}
#: Signs that print nothing.
INVISIBLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]

SEPARATOR, BASE, MARK, GONE, NEWLINE, UNKNOWN = 0, 1, 2, 3, 4, 255
PRIME = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

_kind = np.full(0x110000, UNKNOWN, np.uint8)
_value = np.zeros(0x110000, np.uint64)
_plain = np.zeros(0x110000, np.uint64)
_digit = np.zeros(0x110000, bool)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _scalar(x: int) -> int:
    return int(mix(np.array([x * PRIME & MASK], np.uint64))[0])


@lru_cache(maxsize=None)
def _entry(c: int) -> tuple[int, int, int, bool]:
    """(kind, value, value without accents, is a digit) of a code point."""
    ch = chr(c)
    if c == 10:
        return NEWLINE, 0, 0, False
    if c in INVISIBLE:
        return GONE, 0, 0, False
    ch = LOOKALIKES.get(ch) or STROKED.get(ch) or ch
    if unicodedata.normalize("NFC", ch) != ch or 0xFF00 <= c < 0xFFF0 or "<compat>" in unicodedata.decomposition(ch) or "<font>" in unicodedata.decomposition(ch):
        ch = unicodedata.normalize("NFKC", ch)
    parts = unicodedata.normalize("NFD", ch.lower())
    parts = "".join("d" + "̵" if p == "đ" else p for p in parts)
    kinds = [unicodedata.category(p)[0] for p in parts]
    if not any(k in "LMN" for k in kinds):
        return SEPARATOR, 0, 0, False
    # a sign that stands for several letters carries their places in its value
    place = np.cumsum([k != "M" for k in kinds]) - 1
    each = [_scalar(ord(p) | (k == "M") << 21) * pow(PRIME, max(0, int(i)), 1 << 64) for i, p, k in zip(place, parts, kinds)]
    bare_value = sum(v for v, k in zip(each, kinds) if k != "M")
    return (MARK if kinds[0] == "M" else BASE), sum(each) & MASK, bare_value & MASK, kinds[0] == "N"


def _fill(cp: np.ndarray) -> np.ndarray:
    kind = _kind[cp]
    new = np.unique(cp[kind == UNKNOWN])
    if len(new):
        for c in new.tolist():
            _kind[c], _value[c], _plain[c], _digit[c] = _entry(c)
        kind = _kind[cp]
    return kind


_STOPS = [ord(c) for c in ".!?;…。！？；"]
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    while len(_powers) <= n:
        step = np.uint64(pow(PRIME, len(_powers), 1 << 64))
        _powers = np.concatenate([_powers, _powers * step])
    return _powers


class Words:
    """Words of a string array: hash, has-a-digit, row, line within the row.

    A word counts as having a digit if its first or last letter is one. With
    `plain` there are hashes without accents, with `sentences` the number of
    stops before each word (a stop is a line end, or a sign such as . ; ? that no
    letter follows)."""

    def __init__(self, arr: pa.Array, plain: bool = False, sentences: bool = False):
        data, rows = utf8(arr)
        cp, at = codepoints(data)
        kind = _fill(cp)
        row_at = np.searchsorted(at, rows)
        if (kind == GONE).any():
            stay = kind != GONE
            row_at = np.concatenate([[0], np.cumsum(stay)])[row_at]
            cp, kind = cp[stay], kind[stay]
        self.rows = len(arr)
        word = (kind == BASE) | (kind == MARK)
        start = word.copy()
        start[1:] &= ~word[:-1]
        first = row_at[:-1][row_at[:-1] < len(cp)]
        start[first] = word[first]
        begin = np.flatnonzero(start)
        lines = np.cumsum(kind == NEWLINE, dtype=np.int32)
        line_at = np.concatenate([[0], lines])[row_at]
        self.n_lines = np.diff(line_at) + 1
        self.first_line = line_at[:-1] + np.arange(self.rows)
        if not len(begin):
            self.hash, self.digit, self.colon = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
            self.row, self.line = np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.plain, self.sentence = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            return
        at = np.flatnonzero(word)
        cps = cp[at]
        # position of a letter within its word: letters before it, accents not counted
        base = np.cumsum(kind[at] == BASE, dtype=np.int32)
        head = np.searchsorted(at, begin)
        pos = base - np.repeat(base[head], np.diff(np.append(head, len(at))))
        power = powers(int(pos.max()) + 1)[pos]
        self.hash = mix(np.add.reduceat(_value[cps] * power, head))
        if plain:
            self.plain = mix(np.add.reduceat(_plain[cps] * power, head))
        if sentences:
            stop = np.isin(cp, _STOPS)
            stop[:-1] &= ~word[1:]
            stop |= kind == NEWLINE
            self.sentence = np.cumsum(stop, dtype=np.int32)[begin]
        tail = np.append(head[1:], len(at)) - 1
        self.digit = _digit[cps[head]] | _digit[cps[tail]]
        self.colon = np.append(cp, 0)[at[tail] + 1] == 0x3A
        self.row = np.searchsorted(row_at, begin, "right") - 1
        self.line = lines[begin] - line_at[self.row]

    def ngrams(self, n: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(hash, row) of every run of n words of one row, among the words kept."""
        h, r = (self.hash, self.row) if keep is None else (self.hash[keep], self.row[keep])
        m = len(h) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        same = r[:m] == r[n - 1 :]
        g = np.zeros(m, np.uint64)
        for i in range(n):
            g = g * np.uint64(PRIME) + h[i : i + m]
        return mix(g[same]), r[:m][same]


def word_hashes(text: str) -> list[int]:
    return Words(pa.array([text])).hash.tolist()


_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});")
_FOOTNOTE = re.compile(r"&lt;\d+&gt;|<sup>\(?\d+\)?</sup>")
_TAG = re.compile(r"<!--[^\n]*?-->|</?[a-zA-Z][^<>\n]*>")
_TEX = re.compile(r"~?\\(?:cite|ref|label|eqref)\{[^}\n]*\}|\\\[[^\n]*?\\\]|\$[^$\n]*[\\_^][^$\n]*\$|\\[a-zA-Z]+\*?")
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_WIKI = re.compile(r"\[\[(?:[^|\]\n]*\|)?([^\]\n]*)\]\]")
_URL = re.compile(r"\[https?://[^\s\]]+ ?([^\]\n]*)\]")
_TEMPLATE = re.compile(r"\{\{[^|}\n]*\|([^|}\n]*)(?:\|[^}\n]*)?\}\}")


def bare(text: str) -> str:
    """The text without markup, line by line: lines stay as many as they were."""
    if "&" in text or "<" in text:
        if "&lt;" in text or "<sup>" in text:
            text = _FOOTNOTE.sub("", text)
        if "<" in text:
            text = _TAG.sub(" ", text)
        if "&" in text:
            text = _ENTITY.sub(lambda m: html.unescape(m[0]).replace("\n", " "), text)
    if "\\" in text:
        text = _TEX.sub(" ", text)
    if "[" in text:
        text = _LINK.sub(r"\1", text)
        if "[[" in text:
            text = _WIKI.sub(r"\1", text)
        if "[http" in text:
            text = _URL.sub(r"\1", text)
    if "{{" in text:
        text = _TEMPLATE.sub(r"\1", text)
    return text


def bare_array(arr: pa.Array) -> pa.Array:
    return pa.array([bare(t) if t else t for t in arr.to_pylist()], pa.string())
