"""Markup residue: which languages are left in a text, and the text without them.

Code is set aside first. What is left runs through the standard library's
streaming HTML parser, whose events say what HTML residue there is and rebuild
the lines of text with marks for headings, list items, table rows and code. Each
line has a ratio of text to tags; the ratios are smoothed with a Gaussian and
cut between their two clusters, and lines of the low region whose words all
stand in links or buttons (menus, share bars) are no content. Markdown, wiki and
LaTeX residue is read line by line.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names of HTML that count as residue.
HTML_NAMES = frozenset(
    "a abbr address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figure figcaption font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav noscript ol option p pre q s samp script section select small span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
HEADINGS = {f"h{i}" for i in range(1, 7)} | {"title"}
#: Elements whose words lead elsewhere or act on the page.
CONTROLS = frozenset("a button nav label option select form".split())
HIDDEN = frozenset(("script", "style"))
BLOCKS = frozenset("p div br tr li ul ol table h1 h2 h3 h4 h5 h6 blockquote pre hr section article header footer dd dt title".split())

FENCE = re.compile(r"^[ \t>]*(```+|~~~+)[^\n]*$", re.M)
TAG = re.compile(r"<!--.*?-->|</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>", re.S)
CODE_TAG = re.compile(r"<(pre|code)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
WIKI_CODE = re.compile(r"<(nowiki|syntaxhighlight|source)\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", re.S)

MD_HEADING = re.compile(r"^[ \t]*#{1,6}[ \t]+(?=\S)(.*?)[ \t#]*$", re.M)
MD_QUOTE = re.compile(r"^[ \t]*>[ \t]?(?=\S)", re.M)
MD_LINK = re.compile(r"!?\[([^\]\n]*)\]\(([^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
MD_STRONG = re.compile(r"(?<![*\\])(\*{2,3})(?=[^\s*])([^*\n]+?)(?<=\S)\1(?!\*)|(?<![\w_])(__)(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?![\w_])")
MD_EM = re.compile(r"(?<![*\w\\])\*(?=[^\s*()])([^*\n]+?)(?<=[^\s*(])\*(?![*\w])|(?<![\w_])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])")
MD_STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=\S)~~(?!~)")
MD_CODE = re.compile(r"(?<!`)`(?=[^`\s])([^`\n]+?)(?<=[^\s`])`(?!`)")

WIKI_HEADING = re.compile(r"^[ \t]*(={2,6})[ \t]*(?=[^\s=])([^\n]*?[^\s=])[ \t]*\1[ \t]*\r?$", re.M)
WIKI_LINK = re.compile(r"\[\[(?:[^|\[\]\n]*\|)?([^\[\]\n]*)\]\]")
WIKI_URL = re.compile(r"\[https?://[^\s\[\]]+(?: ([^\[\]\n]*))?\](?!\()")
WIKI_TEMPLATE = re.compile(r"\{\{([^{}|\n]*)(?:\|([^{}|\n]*))?(?:\|[^{}\n]*)?\}\}")
WIKI_QUOTES = re.compile(r"(?<!')('{2,3}|'{5})(?=[^\s'])([^\n]*?[^\s'])\1(?!')")
WIKI_TABLE = re.compile(r"^[ \t]*(?:\{\||\|\}|\|-[ \t]*$)", re.M)

TEX_COMMAND = re.compile(r"\\(?:[a-zA-Z]+\*?(?=\{|\[|\b)|\\(?=[ \t]*\r?(?:\n|$))|[\[\]()](?!\())")
TEX_MATH = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$([^$]+)\$\$|\$(?=\S)([^$\n]*[\\_^{][^$\n]*)\$")
TEX_HEADING = re.compile(r"\\(?:title|part|chapter|(?:sub){0,2}section|paragraph)\*?\{([^{}\n]*)\}")
TEX_DROP = re.compile(r"~?\\(?:cite|ref|eqref|label|pageref|footnotemark|index)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}")
TEX_WRAP = re.compile(r"\\[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}")
TEX_ITEM = re.compile(r"^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*", re.M)
TEX_END = re.compile(r"[ \t]*\\\\[ \t]*(?=\r?(?:\n|$))")

SIGNAL = re.compile(r"[<&`\\\[{*_=~#']|\n[ \t]*>|^[ \t]*>")
LANGUAGES = ("html", "latex", "markdown", "wiki")


def split_code(text: str) -> list[tuple[str, str]]:
    """(kind, part) with kind `text` or the language of a code block; the parts make up the text."""
    spans: list[tuple[int, int, str]] = []
    open_at = None
    for m in FENCE.finditer(text) if "```" in text or "~~~" in text else ():
        if open_at is None:
            open_at = (m.start(), m[1])
        elif m[1][0] == open_at[1][0] and len(m[1]) >= len(open_at[1]):
            spans.append((open_at[0], m.end(), "markdown"))
            open_at = None
    if open_at is not None:
        spans.append((*((open_at[0], text.find("\n", open_at[0]) if "\n" in text[open_at[0] :] else len(text))), "markdown"))
    for p, lang, sign in ((CODE_TAG, "html", "<"), (WIKI_CODE, "wiki", "<"), (VERBATIM, "latex", "\\begin")):
        if sign in text:
            spans += [(m.start(), m.end(), lang) for m in p.finditer(text)]
    out, at = [], 0
    for a, b, lang in sorted(spans):
        if a < at:
            continue
        if a > at:
            out.append(("text", text[at:a]))
        out.append((lang, text[a:b]))
        at = b
    if at < len(text):
        out.append(("text", text[at:]))
    return out


#: Noncharacters of Unicode: around the number of a piece of code that is set aside; for a < that opens nothing.
HOLD, LET, LONE = "\ufdd0", "\ufdd1", "\ufdd2"
HELD = re.compile(f"{HOLD}(\\d+){LET}")


def without_code(text: str) -> tuple[str, list[tuple[str, str]]]:
    """(the text with a mark for each piece of code, the pieces)."""
    out, held = [], []
    for kind, part in split_code(text):
        if kind != "text":
            held.append((kind, part))
            out.append(f"{HOLD}{len(held) - 1}{LET}")
        elif "`" in part:
            at = 0
            for m in MD_CODE.finditer(part):
                held.append(("inline", m[0]))
                out += [part[at : m.start()], f"{HOLD}{len(held) - 1}{LET}"]
                at = m.end()
            out.append(part[at:])
        else:
            out.append(part)
    return "".join(out), held


class Events(HTMLParser):
    """The parser's events of one text: (line from 0, kind, value).

    Kinds: `open` and `close` of HTML elements, `note` (comments, doctypes,
    processing instructions), `reference` (the character it stands for) and
    `text`, which also has what only looks like markup, as it is written.
    """

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.source, self.events = text, []
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.feed(text + "\n")  # a reference at the very end needs a sign after it
        while rest := self.rawdata:  # a construct without an end: its first sign is text
            self.clear_cdata_mode()
            self.rawdata = ""
            self.handle_data(rest[0])
            self.offset += 1
            # without a > no other construct has an end either
            self.feed(rest[1:] if ">" in rest else rest[1:].replace("<", LONE))
        line, kind, last = self.events.pop()
        self.events.append((line, kind, last[:-1]))

    def _at(self) -> int:
        return self.starts[self.lineno - 1] + self.offset

    def _add(self, kind: str, value: str) -> None:
        self.events.append((self.lineno - 1, kind, value))

    def _raw(self, end: str) -> str:
        a = self._at()
        b = self.source.find(end, a)
        return self.source[a : b + len(end)] if b >= 0 else self.source[a:]

    def handle_starttag(self, tag, attrs):
        raw = self.get_starttag_text() or ""
        # a second < outside of quotes: two comparisons, not a tag
        if tag in HTML_NAMES and "<" not in QUOTED.sub("", raw)[1:]:
            self._add("open", tag)
        else:
            self._add("text", raw)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.events[-1][1] == "open":
            self._add("close", tag)

    def handle_endtag(self, tag):
        if tag in HTML_NAMES:
            self._add("close", tag)
        else:
            self._add("text", self._raw(">"))

    def handle_data(self, data):
        self._add("text", data.replace(LONE, "<"))

    def handle_comment(self, data):
        if self.source.startswith("<!--", self._at()):
            self._add("note", data)
        else:
            self._add("text", self._raw(">"))

    def handle_decl(self, decl):
        if decl[:7].lower() == "doctype":
            self._add("note", decl)
        else:
            self._add("text", self._raw(">"))

    def unknown_decl(self, data):
        self._add("text", self._raw(">"))

    def handle_pi(self, data):
        if data[:1].isalpha():
            self._add("note", data)
        else:
            self._add("text", self._raw(">"))

    def _reference(self, name: str) -> None:
        raw = f"&{name}"
        if self.source.startswith(raw + ";", self._at()):
            raw += ";"
        # without the closing sign only the names of old that end there
        known = name[0] == "#" and raw[-1] == ";" or raw[1:] in html5 and (raw[-1] == ";" or self.source[self._at() + len(raw) : self._at() + len(raw) + 1] != "=")
        self._add("reference" if known else "text", html.unescape(raw) if known else raw)

    def handle_charref(self, name):
        self._reference("#" + name)

    def handle_entityref(self, name):
        self._reference(name)


def html_events(text: str) -> list[tuple[int, str, str]]:
    """Events of a text; without a < or & there is nothing for the parser to tell."""
    return Events(text).events if "<" in text or "&" in text else [(0, "text", text)]


def has_html(events: list[tuple[int, str, str]]) -> bool:
    return any(kind != "text" for _, kind, _ in events)


def residue(text: str) -> set[str]:
    """The markup languages that the text holds residue of."""
    return scan(text)[0]


def scan(text: str) -> tuple[set[str], str, list[tuple[str, str]], list[tuple[int, str, str]]]:
    """(languages found, text without code, pieces of code, parser events)."""
    if not SIGNAL.search(text):
        return set(), text, [], []
    t, held = without_code(text)
    found = {"markdown" if kind == "inline" else kind for kind, _ in held}
    events = html_events(t)
    if has_html(events):
        found.add("html")
    if "\\" in t and (TEX_COMMAND.search(t)) or "$" in t and TEX_MATH.search(t):
        found.add("latex")
    x = TEX_MATH.sub(" ", t) if "$" in t or "\\" in t else t
    if "markdown" not in found:
        if "](" in x and MD_LINK.search(x) or "**" in x and MD_STRONG.search(x) or "__" in x and MD_STRONG.search(x) or "~~" in x and MD_STRIKE.search(x) or "#" in x and MD_HEADING.search(x) or ">" in x and MD_QUOTE.search(x) or ("*" in x or "_" in x) and MD_EM.search(x):
            found.add("markdown")
    if "[[" in x and WIKI_LINK.search(x) or "[http" in x and WIKI_URL.search(x) or "{{" in x and WIKI_TEMPLATE.search(x) or "''" in x and WIKI_QUOTES.search(x) or "==" in x and WIKI_HEADING.search(x) or ("{|" in x or "|}" in x or "|-" in x) and WIKI_TABLE.search(x):
        found.add("wiki")
    return found, t, held, events


def smoothed_ratios(chars: np.ndarray, tags: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Characters of text per tag of each line, smoothed with a Gaussian."""
    if not len(chars):
        return np.zeros(0)
    r = int(3 * sigma)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(chars / np.maximum(tags, 1), r, mode="edge"), k / k.sum(), "valid")


def content_threshold(ratios: np.ndarray, apart: float = 3.0) -> float:
    """Between the two clusters of ratios (two means, run to rest); below all of them if the clusters are not `apart` times each other."""
    low, high = float(ratios.min()), float(ratios.max())
    for _ in range(32):
        cut = (low + high) / 2
        a, b = ratios[ratios <= cut], ratios[ratios > cut]
        new = (float(a.mean()) if len(a) else low, float(b.mean()) if len(b) else high)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high > apart * low else -1.0


def no_content(events: list[tuple[int, str, str]], threshold=content_threshold) -> set[int]:
    """Lines outside the content regions: of a low text-to-tag ratio, with all their words in links or buttons."""
    last = max((line + value.count("\n") * (kind == "text") for line, kind, value in events), default=0)
    chars, tags, free = np.zeros(last + 1), np.zeros(last + 1), np.zeros(last + 1)
    inside = 0
    for line, kind, value in events:
        if kind in ("text", "reference"):
            for i, x in enumerate(value.split("\n")):
                n = len(x.strip())
                chars[line + i] += n
                # signs between links are no words
                free[line + i] += n if not inside and any(map(str.isalnum, x)) else 0
        else:
            tags[line] += 1
            if value in CONTROLS and kind != "note":
                inside = max(0, inside + (1 if kind == "open" else -1))
    if not tags.any():
        return set()
    ratios = smoothed_ratios(chars, tags)
    return set(np.flatnonzero((ratios <= threshold(ratios)) & (tags > 0) & (chars > 0) & (free == 0)).tolist())


class _Page:
    """Lines of text rebuilt from events; headings, items, table rows and code keep a mark."""

    def __init__(self):
        self.out: list[str] = []
        self.mark, self.fresh, self.brk = "", True, False
        self.row = self.cell = False
        self.cells = 0

    def raw(self, s: str) -> None:
        if self.brk and not self.fresh and not s.startswith("\n"):
            self.out.append("\n")
        self.out += [self.mark, s]
        self.fresh = s.endswith("\n") if s else self.fresh and not self.mark
        self.mark, self.brk = "", False

    def text(self, s: str) -> None:
        if self.row:
            if not self.cell and not s.strip():
                return
            s = s.replace("\r", "").replace("\n", " ")
        if self.mark:
            s = s.lstrip()
            if not s:
                return
        if s:
            self.raw(s)

    def open(self, tag: str, ends: bool) -> None:
        """`ends`: whether the element's end comes later."""
        if tag == "tr" and ends:
            self.row, self.cell, self.cells, self.mark, self.brk = True, False, 0, "| ", True
        elif tag in ("td", "th") and self.row:
            if self.cells:
                self.raw(" | ")
            self.cells, self.cell = self.cells + 1, True
        elif self.row and self.cell:
            if tag == "code":
                self.raw("`")
        elif tag in HEADINGS or tag == "li":
            self.mark, self.brk = "- " if tag == "li" else "# ", True
        elif tag == "code":
            self.raw("`")
        elif tag in BLOCKS:
            self.brk = True

    def close(self, tag: str) -> None:
        if tag in ("tr", "table", "tbody", "thead"):
            if self.row and self.cells:
                self.raw(" |")
            self.row = self.cell = False
            self.mark, self.brk = "", True
        elif tag in ("td", "th"):
            self.cell = False
        elif tag == "code":
            self.raw("`")
        elif tag in BLOCKS and not self.row:
            self.mark, self.brk = "" if tag in HEADINGS or tag == "li" else self.mark, True


def page_text(events: list[tuple[int, str, str]], threshold=content_threshold) -> str:
    """The text of the content regions of a text's events."""
    drop = no_content(events, threshold)
    ends = {value: i for i, (_, kind, value) in enumerate(events) if kind == "close"}
    row_end = max((ends.get(t, -1) for t in ("tr", "table")), default=-1)
    page, hidden = _Page(), None
    for i, (line, kind, value) in enumerate(events):
        if hidden:
            if kind == "close" and value == hidden:
                hidden = None
        elif kind == "open":
            if value in HIDDEN and ends.get(value, -1) > i:
                hidden = value
            else:
                page.open(value, row_end > i)
        elif kind == "close":
            page.close(value)
        elif kind == "reference":
            if line not in drop:
                page.text(value.replace("\xa0", " "))
        elif kind == "text":
            lines = value.split("\n")
            kept = [x if line + j not in drop else "" for j, x in enumerate(lines)] if drop else lines
            page.text("\n".join(kept))
    return "".join(page.out)


def _plain(text: str, found: set[str]) -> str:
    if "latex" in found:
        formulas: list[str] = []

        def keep(m: re.Match) -> str:
            formulas.append("$" + next(g for g in m.groups() if g is not None).strip() + "$")
            return f"\x00{len(formulas) - 1}\x00"

        text = TEX_MATH.sub(keep, text)
        text = TEX_HEADING.sub(r"# \1", TEX_DROP.sub("", text))
        text = TEX_ITEM.sub(lambda m: "- ", text)
        n = 1
        while n:  # each round shortens the text
            text, n = TEX_WRAP.subn(r"\1", text)
        text = TEX_COMMAND.sub("", TEX_END.sub("", text))
        text = re.sub(r"\x00(\d+)\x00", lambda m: formulas[int(m[1])], text)
        text = re.sub(r"^- - ", "- ", text, flags=re.M)
    if "wiki" in found:
        text = WIKI_HEADING.sub(r"# \2", text)
        text = WIKI_QUOTES.sub(r"\2", WIKI_TEMPLATE.sub(lambda m: m[2] or "", WIKI_URL.sub(lambda m: m[1] or "", WIKI_LINK.sub(r"\1", text))))
        text = WIKI_TABLE.sub("", text)
    if "markdown" in found:
        text = MD_LINK.sub(r"\1", MD_QUOTE.sub("", text))
        text = MD_STRONG.sub(lambda m: m[2] or m[4], text)
        text = MD_STRIKE.sub(r"\1", text)
        text = MD_EM.sub(lambda m: m[1] or m[2], text)
        text = MD_HEADING.sub(r"# \1", text)
    return text


def clean_text(text: str, threshold=content_threshold) -> tuple[str, set[str]]:
    """(clean text, languages found). Code keeps its fences or backquotes, formulas $...$, headings `# `, list items `- `."""
    found, t, held, events = scan(text)
    if not found:
        return text, found
    if "html" in found and has_html(events):
        t = page_text(events, threshold)
    return HELD.sub(lambda m: _code(*held[int(m[1])]) if int(m[1]) < len(held) else m[0], _plain(t, found)), found


def _code(kind: str, part: str) -> str:
    if kind in ("markdown", "inline"):
        return part
    if kind == "html":
        m = CODE_TAG.match(part)
        body = html.unescape(TAG.sub("", m[2]))
        return f"```\n{body.strip(chr(10))}\n```" if m[1].lower() == "pre" or "\n" in body else f"`{body}`"
    body = (WIKI_CODE if kind == "wiki" else VERBATIM).match(part)[2].strip("\n")
    return f"```\n{body}\n```"


def structure(text: str) -> list[dict]:
    """Headings, list items, code and formulas of a clean text, in order: kind and text."""
    out, code = [], None
    for line in text.split("\n"):
        s = line.strip()
        if s.startswith("```"):
            if code is None:
                code = []
            else:
                out.append({"kind": "code", "text": "\n".join(code)})
                code = None
        elif code is not None:
            code.append(line)
        else:
            if s.startswith("# "):
                out.append({"kind": "heading", "text": s[2:]})
            elif s.startswith("- "):
                out.append({"kind": "list", "text": s[2:]})
            out += [{"kind": "code", "text": m[1]} for m in MD_CODE.finditer(s)]
            out += [{"kind": "formula", "text": m[4]} for m in TEX_MATH.finditer(s) if m[4]]
    if code:
        out.append({"kind": "code", "text": "\n".join(code)})
    return out


def markup_items(content: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_kind, item_key, text) of the contents and of the text blocks of trees."""
    d = content.select(F.lit("content").alias("item_kind"), F.col("id").cast("string").alias("item_key"), F.col("content").alias("text"))
    b = nodes.select("node_id", F.posexplode("blocks").alias("pos", "block")).filter("block.type = 'text'")
    b = b.select(F.lit("block").alias("item_kind"), F.concat("node_id", F.lit("/"), (F.col("pos") + 1).cast("string")).alias("item_key"), F.col("block.text").alias("text"))
    return d.unionByName(b)


CLEAN = "item_kind string, item_key string, markup array<string>, clean string, structure array<struct<kind:string,text:string>>"


def without_markup(items: DataFrame, texts: bool = True) -> DataFrame:
    """(item_kind, item_key, markup, clean, structure) for every item with a text.

    markup lists the languages of which residue was found, in alphabetical order.
    With texts=False clean and structure are not sent back and only items with
    residue are given. Null texts give no row; texts without residue are unchanged;
    rows that repeat an item stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))]
        for b in batches:
            rows: list[list] = [[] for _ in types]
            for kind, key, text in zip(*(c.to_pylist() for c in b.columns)):
                clean, found = clean_text(text)
                if not (texts or found):
                    continue
                made = (kind, key, sorted(found), *((clean, structure(clean)) if texts else (None, None)))
                for col, v in zip(rows, made):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], ["item_kind", "item_key", "markup", "clean", "structure"])

    some = items.select(F.col("item_kind").cast("string"), F.col("item_key").cast("string"), F.col("text").cast("string")).filter("text is not null")
    if not texts:  # a text without any of these signs holds no residue
        some = some.filter(F.col("text").rlike(r"[<&`\\\[{*_=~#']|(?m)^[ \t]*>"))
    return some.mapInArrow(run, CLEAN)
