"""Parsed texts cut into retrieval units under a token budget.

An outline is an array of rows in document order, each with its place in the
tree. Cutting groups the rows one level deeper at a time: whole subtrees are
packed into runs while they fit, and a subtree that does not fit is cut in turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby, islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.hierarchy import Node, parse
from granary.session import spread

Count = Callable[[str], int]
LEAST_BUDGET, LEAST_LEAF, MARGIN = 128, 80, 8
#: Node types that show in a context, and those whose text is indexed.
SHOWN = {"part", "chapter", "section", "subsection", "article", "appendix", "appendix_section"}
INDEXED = {"article", "clause", "point", "subpoint"}
#: Where a sentence ends in parsed documents and in texts with inner numbering.
STOPS, MARKED_STOPS = ".!?。", ".!?"
#: Separators of a text without sentences, the best first.
SEPARATORS = ("\n", ". ", "; ", ", ", " ")
#: Letters that number items.
ITEM_LETTERS = frozenset("abcdđeghiklmn")


def estimate(text: str) -> int:
    """Words x 1.35, at least 1; 0 for blank."""
    n = len(text.split())
    return max(1, int(n * 1.35)) if n else 0


def squeeze(text: str | None) -> str:
    return " ".join((text or "").split())


def join_sentences(parts) -> str:
    out = ""
    for p in filter(None, map(squeeze, parts)):
        out = p if not out else f"{out} {p}" if out[-1] in ".:;?!" else f"{out}. {p}"
    return out


def sentences(text: str, stops: str = STOPS) -> list[str]:
    """A squeezed text cut after the words that end in a stop."""
    out, run = [], []
    for w in text.split():
        run.append(w)
        if w[-1] in stops:
            out.append(" ".join(run))
            run = []
    return [*out, " ".join(run)] if run else out


def ending(parts: list[str], budget: int, count: Count) -> list[str]:
    """The longest end of the parts that fits joined."""
    n = 0
    while n < len(parts) and count(" ".join(parts[-n - 1 :])) <= budget:
        n += 1
    return parts[len(parts) - n :]


def summed_ending(parts: list[str], budget: int, count: Count) -> list[str]:
    """The longest end of the parts whose sizes add up to no more than the budget."""
    n = sum(1 for _ in takewhile(lambda total: total <= budget, accumulate(map(count, reversed(parts)))))
    return parts[len(parts) - n :]


def windows(parts: list[str], budget: int, overlap: int, count: Count, lead: Callable[[list[str]], list[str]], finer: Callable[[str], list[str]]) -> list[str]:
    """Parts joined by spaces while the sum of their sizes fits; each window starts with the `lead` of the one before.

    A part beyond the budget is handed to `finer`. A lead that leaves no room
    for the next part is left out.
    """
    out: list[str] = []
    run: list[str] = []
    size = 0
    for p in parts:
        n = count(p)
        if n > budget or run and size + n > budget:
            if run:
                out.append(" ".join(run))
            run = lead(run) if n <= budget else []
            size = sum(map(count, run))
            if size + n > budget:
                run, size = [], 0
        if n > budget:
            out += finer(p)
        else:
            run.append(p)
            size += n
    return [*out, " ".join(run)] if run else out


def word_windows(text: str, budget: int, overlap: int, count: Count) -> list[str]:
    overlap = max(0, min(overlap, budget - 1))
    return windows(text.split(), budget, overlap, count, lambda ws: summed_ending(ws, overlap, count), lambda w: [w])


def split_text(text: str, budget: int, overlap: int = 0, count: Count = estimate) -> list[str]:
    """A text by sentences, long ones by words, under the budget.

    With an overlap a window starts with the last sentences of the one before,
    or with the last words of its last sentence if that is longer.
    """
    text = squeeze(text)
    if not text or count(text) <= budget:
        return [text] if text else []
    if budget < 1:
        return []
    parts = sentences(text)
    if len(parts) < 2:
        return word_windows(text, budget, overlap, count)
    overlap = max(0, min(overlap, budget - 1))

    def lead(ps: list[str]) -> list[str]:
        return summed_ending(ps, overlap, count) or word_windows(ps[-1], overlap, 0, count)[-1:] if overlap else []

    return windows(parts, budget, overlap, count, lead, lambda p: word_windows(p, budget, overlap, count))


def joined_runs(parts: list[str], budget: int, count: Count) -> list[list[str]]:
    """Parts gathered while they fit joined; a part beyond the budget is a run of its own."""
    out: list[list[str]] = []
    for p in parts:
        if out and count(" ".join([*out[-1], p])) <= budget:
            out[-1].append(p)
        else:
            out.append([p])
    return out


def at_separator(text: str, separator: str) -> list[str]:
    """The text cut after each separator."""
    if separator == " ":
        return text.split()
    *firsts, last = text.split(separator)
    return [x for x in [*(f"{p}{separator}".strip() for p in firsts if p), last.strip()] if x]


def by_separators(text: str, budget: int, count: Count, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """A text cut at the first separator, what is still too long at the next ones, at last between words."""
    text = squeeze(text)
    if not text or count(text) <= budget or not separators:
        return [text] if text else []
    return [x for run in joined_runs(at_separator(text, separators[0]), budget, count) for x in by_separators(" ".join(run), budget, count, separators[1:])]


def with_leads(pieces: list[str], budget: int, overlap: int, count: Count) -> list[str]:
    """Each piece after the end of the one before, of which as many first words are left out as the budget asks for."""
    out = pieces[:1]
    for p in pieces[1:]:
        units = at_separator(out[-1], ", ")
        units = units if len(units) > 1 else out[-1].split()
        words = " ".join(ending(units, overlap, count) or units[-1:]).split()
        while words and count(" ".join([*words, p])) > budget:
            del words[0]
        out.append(" ".join([*words, p]))
    return out


def is_item_sign(word: str) -> bool:
    """`1.`, `1.2.`, `a)` or `a.`"""
    inner, end = word[:-1], word[-1:]
    letter = len(inner) == 1 and ("a" <= inner.lower() <= "z" or inner.lower() == "đ")
    number = bool(inner) and all(x.isdecimal() for x in inner.split("."))
    return end == "." and (letter or number) or end == ")" and letter


def whole_items(parts: list[str]) -> list[str]:
    """Sentences of which those that are a lone item number go before the next one."""
    out: list[str] = []
    held = ""
    for p in parts:
        inner = p[:-1]
        if not held and p[-1] == "." and (inner.lower() in ITEM_LETTERS or inner.replace(".", "").isdecimal()):
            held = p
        else:
            out.append(f"{held} {p}".strip())
            held = ""
    return [*out, held] if held else out


def leaf_pieces(text: str, budget: int, overlap: int, count: Count) -> list[str]:
    """A text without items by sentences; one sentence by separators."""
    parts = whole_items(sentences(text, MARKED_STOPS))
    if len(parts) < 2:
        pieces = by_separators(text, budget, count)
        return with_leads(pieces, budget, overlap, count) if overlap > 0 else pieces
    runs: list[list[str]] = []
    for p in parts:
        if runs and count(" ".join([*runs[-1], p])) <= budget:
            runs[-1].append(p)
        else:
            last = runs[-1] if runs and overlap > 0 else []
            runs.append([*(ending(last, overlap, count) or last[-1:]), p])
    return [" ".join(r) for r in runs]


def marker_tree(text: str) -> list[tuple[int, str, str]]:
    """(level, label, text) of the numbered and lettered items inside one squeezed paragraph, in order.

    `1.` is level 1, `1.1.` level 2; a letter is one below the last number.
    Items without a body are skipped, as is what comes before the first item.
    """
    out: list[tuple[int, str, str]] = []
    level = 0
    words = text.split()
    signs = [i for i, w in enumerate(words[:-1]) if is_item_sign(w)]
    for i, end in zip(signs, [*signs[1:], len(words)]):
        if end - i < 2:
            continue
        label = words[i].rstrip(".")
        if label[0].isdecimal():
            level = label.count(".") + 1
        out.append((level if label[0].isdecimal() else level + 1, label, " ".join(words[i:end])))
    return out


def subtrees(levels: list[int], a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the topmost subtrees of rows a..b: one starts where no row of the span before is above it."""
    heads = [i for i, top in zip(range(a, b), accumulate(levels[a:b], min)) if levels[i] == top]
    return list(zip(heads, [*heads[1:], b]))


def split_marked(text: str, budget: int, overlap: int = 0, count: Count = estimate) -> list[tuple[str, list[str], str]]:
    """(text, path, method) of the pieces of a text with inner numbering.

    Sibling items are packed together while they fit, with the lines of their
    parents repeated before them; what doesn't fit is taken apart, at last by
    sentences. A text that fits is one piece of method `article`.
    """
    text = squeeze(text)
    if not text or count(text) <= budget:
        return [(text, [], "article")] if text else []
    items = marker_tree(text)
    levels = [i[0] for i in items]
    out: list[tuple[str, list[str], str]] = []
    # spans to cut, each with the rows of its parents; the last comes first
    todo = [(0, len(items), ())] if items else []
    if not items:
        out = [(p, [], "tree_leaf_sentence") for p in leaf_pieces(text, budget, overlap, count)]
    while todo:
        a, b, above = todo.pop()
        lines, path = [items[i][2] for i in above], [items[i][1] for i in above]
        lump = lambda s, e: "\n".join([*lines, *(items[i][2] for i in range(s, e))])
        spans = subtrees(levels, a, b)
        n = 0  # subtrees that fit together
        while n < len(spans) and count(lump(a, spans[n][1])) <= budget:
            n += 1
        if n:
            end = spans[n - 1][1]
            out.append((lump(a, end), path + [items[s][1] for s, _ in spans[:n]], "tree_packed" if n > 1 else "tree_subtree"))
        else:
            end = spans[0][1]
        if end < b:
            todo.append((end, b, above))
        if not n and end - a > 1:
            todo.append((a + 1, end, (*above, a)))
        elif not n:
            room = min(budget, max(LEAST_LEAF, budget - count("\n".join(lines))))
            out += [("\n".join([*lines, p]), [*path, items[a][1]], "tree_leaf_sentence") for p in leaf_pieces(items[a][2], room, overlap, count)]
    return out


def surface(n: Node, text: str) -> str:
    """A node's text as it stands in the document, with its marker."""
    mark = {"clause": f"{n.number}. ", "point": f"{n.number}) "}.get(n.kind, "") if n.number else ""
    return (mark or ("- " if n.kind == "subpoint" else "")) + squeeze(text)


def context(n: Node) -> str:
    """What places a node: document, headings above it, leading text of clauses and points."""
    root, *above = n.chain
    number, title = root.number, root.title
    parts = [title if number and number.lower() in title.lower() else f"{number} {title}".strip()]
    for x in above[:-1]:
        if x.kind in SHOWN:
            parts.append(x.display)
        elif x.kind in ("clause", "point"):
            first = next((b["text"] for b in x.blocks if b["type"] == "text" and squeeze(b["text"])), "")
            parts.append(surface(x, first).strip())
    if above and above[-1].kind in SHOWN and above[-1].display not in parts:
        parts.append(above[-1].display)
    return join_sentences(parts)


@dataclass
class Row:
    """A text block of an outline: its node's chain from the article down, its text and lines."""

    chain: list[Node]
    text: str
    start: int
    end: int

    def at(self, depth: int) -> Node:
        return self.chain[min(depth, len(self.chain) - 1)]


def article_rows(nodes: list[Node], article: Node) -> list[Row]:
    depth = len(article.chain) - 1
    under = takewhile(lambda n: any(x is article for x in n.chain), islice(nodes, article.seq, None))
    return [Row(n.chain[depth:], surface(n, b["text"]), b["line_start"], b["line_end"]) for n in under if n.kind in INDEXED for b in n.blocks if b["type"] == "text" and squeeze(b["text"])]


def packed(units: list[list[Row]], sizes: list[int], limit: int) -> list[list[int]]:
    """Numbers of the units that go together while their sizes add up to the limit; a unit beyond it stands alone."""
    out: list[list[int]] = []
    room = -1
    for i, n in enumerate(sizes):
        if n > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room = room - n if n <= limit else -1
    return out


def table_runs(rows: list[list[str]], head: list[str], width: int, most: int, limit: int, count: Count) -> Iterator[tuple[int, int, str]]:
    """(first row, end, text) of the runs of a table's rows, each with its head; the first row of a run always fits."""
    lines = ["| " + " | ".join((r + [""] * width)[: width or None]) + " |" for r in rows]
    a = 0
    while a < len(lines):
        e = next((e for e in range(a + 1, min(a + most, len(lines))) if count("\n".join([*head, *lines[a : e + 1]])) > limit), min(a + most, len(lines)))
        yield a, e, "\n".join([*head, *lines[a:e]])
        a = e


def chunk_tree(nodes: list[Node], budget: int, overlap: int = 256, table_rows: int = 8, count: Count = estimate) -> list[dict]:
    """Chunks of a parsed document: article texts whole where they fit, else their clauses and points packed; tables by rows."""
    out: list[dict] = []

    def room(n: Node, more: str = "") -> int:
        return max(LEAST_BUDGET, budget - count(join_sentences([context(n), more])) - MARGIN)

    def emit(n: Node, kind: str, text: str, start: int, end: int, rows: tuple[int | None, int | None] = (None, None)) -> None:
        article = next((x for x in reversed(n.chain) if x.kind == "article"), None)
        out.append({"chunk_type": kind, "text": text, "context": context(n), "node_seq": n.seq, "path": [x.display for x in n.chain if x.display], "article_no": article.label if article else None, "line_start": start, "line_end": end, "row_start": rows[0], "row_end": rows[1]})

    def text_of(rows: list[Row]) -> str:
        return "\n".join(r.text for r in rows)

    def put(n: Node, kind: str, rows: list[Row], text: str | None = None) -> None:
        emit(n, f"{n.kind}_{kind}_chunk", text_of(rows) if text is None else text, min(r.start for r in rows), max(r.end for r in rows))

    def cut(rows: list[Row], depth: int) -> None:
        """Rows that share the node at `depth`."""
        node = rows[0].at(depth)
        limit = room(node)
        if count(text_of(rows)) <= limit:
            return put(node, "text", rows)
        units = [list(g) for _, g in groupby(rows, lambda r: r.at(depth + 1).seq)]
        sizes = [count(text_of(u)) for u in units]
        for run in packed(units, sizes, limit):
            if sizes[run[0]] <= limit:
                put(node, "split", [r for i in run for r in units[i]])
                continue
            unit = units[run[0]]
            inner = unit[0].at(depth + 1)
            if inner is not node and inner.kind in ("clause", "point"):
                cut(unit, depth + 1)
            else:
                for piece in split_text(text_of(unit), room(inner), overlap, count):
                    put(inner, "text", unit, piece)

    def tables(n: Node) -> None:
        for b in (b for b in n.blocks if b["type"] == "table"):
            heads, lead = b["headers"], " ".join(x for x in [squeeze(b["caption"]), " ".join(b["headers"])] if x)
            head = [f"| {' | '.join(heads)} |", f"| {' | '.join('---' for _ in heads)} |"] if heads else []
            for a, e, body in table_runs(b["rows"], head, len(heads), table_rows, room(n, lead), count) if b["rows"] else [(None, None, squeeze(b["text"]))]:
                emit(n, "table_chunk", f"{lead}. {body}".strip(". "), b["line_start"], b["line_end"], (None if a is None else a + 1, e))

    held: list[Node] = []  # tables of an article come after its texts
    for n in nodes:
        inside = any(x.kind == "article" for x in n.chain)
        if n.kind == "article" or not inside:
            for x in held:
                tables(x)
            held = []
        if n.kind == "article":
            rows = article_rows(nodes, n)
            if rows:
                cut(rows, 0)
            elif n.title:
                emit(n, "article_title_chunk", "", n.start, n.end)
        if inside:
            held.append(n)
        else:
            tables(n)
    for x in held:
        tables(x)
    for i, c in enumerate(out):
        c["chunk_index"], c["chunk_count"] = i, len(out)
    return out


_CHUNK = pa.schema([("chunk_index", pa.int32()), ("chunk_count", pa.int32()), ("chunk_type", pa.string()), ("text", pa.string()), ("context", pa.string()), ("node_seq", pa.int32()), ("path", pa.list_(pa.string())), ("article_no", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32()), ("row_start", pa.int32()), ("row_end", pa.int32())])
CHUNK_SCHEMA = "chunk_index int, chunk_count int, chunk_type string, text string, context string, node_seq int, path array<string>, article_no string, line_start int, line_end int, row_start int, row_end int"
_PIECE = pa.schema([("chunk_index", pa.int32()), ("chunk_count", pa.int32()), ("text", pa.string()), ("path", pa.list_(pa.string())), ("method", pa.string())])
PIECE_SCHEMA = "chunk_index int, chunk_count int, text string, path array<string>, method string"


def _map_rows(df: DataFrame, key: str, cols: list[str], make: Callable[..., list[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                at, rows = [], []
                for i, values in enumerate(zip(*(c.to_pylist() for c in part.columns[1:]))):
                    made = make(*values)
                    rows += made
                    at += [i] * len(made)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int32())), *(pa.array([r[f.name] for r in rows], f.type) for f in schema)], ["k_", *schema.names])

    some = df.select(F.col(key), *(F.col(c).cast("string") for c in cols)).filter(F.col(cols[0]).isNotNull())
    return spread(some).mapInArrow(run, f"k_ {kind}, {ddl}").withColumnRenamed("k_", key)


def chunk_documents(docs: DataFrame, key: str, text: str, title: str = "title", number: str = "number", budget: int = 2048, overlap: int = 256, table_rows: int = 8, count: Count = estimate) -> DataFrame:
    """Chunks of every document: key and CHUNK_SCHEMA. Null texts have none; a text without articles or tables has none."""
    return _map_rows(docs, key, [text, title, number], lambda x, t, n: chunk_tree(parse(x, t or "", n or ""), budget, overlap, table_rows, count), _CHUNK, CHUNK_SCHEMA)


def marked_pieces(df: DataFrame, key: str, text: str, budget: int = 2048, overlap: int = 256, count: Count = estimate) -> DataFrame:
    """Pieces of texts with inner numbering: key and PIECE_SCHEMA."""

    def make(x: str) -> list[dict]:
        p = split_marked(x, budget, overlap, count)
        return [{"chunk_index": i, "chunk_count": len(p), "text": t, "path": path, "method": m} for i, (t, path, m) in enumerate(p)]

    return _map_rows(df, key, [text], make, _PIECE, PIECE_SCHEMA)


def sentence_pieces(df: DataFrame, key: str, text: str, budget: int = 2048, overlap: int = 256, count: Count = estimate) -> DataFrame:
    """Pieces of texts by sentences: key and PIECE_SCHEMA with empty paths."""

    def make(x: str) -> list[dict]:
        p = split_text(x, budget, overlap, count)
        return [{"chunk_index": i, "chunk_count": len(p), "text": t, "path": [], "method": "text"} for i, t in enumerate(p)]

    return _map_rows(df, key, [text], make, _PIECE, PIECE_SCHEMA)
