"""Items over a size limit cut into balanced pieces at natural boundaries.

The fewest pieces that can hold an item are counted, as many equal targets are
laid over it, and each cut moves from its target to the strongest boundary
nearby: a heading, a blank line, a numbered provision, a line end, a sentence
end, a clause end, a word end. If a limit fails, or nothing pauses near a
target, more pieces are planned and all is laid anew. Consecutive pieces share `overlap` characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3000, 200
#: What a line may open with before the act's own words.
_LEAD = r"[ \t>#=]*(?:<[^<>\n]{1,40}>|\\\w+\*?\{?)*[ \t]*"
#: Strength of a cut at a line's start by what the line opens with; other line starts have LINE.
_LINES = [
    (7, re.compile(_LEAD + r"(?:Chương|CHƯƠNG|Chapter|CHAPTER|Chapitre|CHAPITRE|Phần|Phụ lục|Annexe?)\b")),
    (6, re.compile(_LEAD + r"(?:Điều|ĐIỀU|Article|ARTICLE|Mục|Section)\s+\d")),
    (5, re.compile(r"[ \t\r]*\n")),
    (4, re.compile(_LEAD + r"(?:\d+[.)]|[a-zđ]\)|[-•])\s")),
]
LINE = 3
_INSIDE = [(2, re.compile(r"[.!?…][\"'”»)\]]*\s+")), (1, re.compile(r"[;:,]\s+")), (0, re.compile(r"\s+"))]
PULL = 2.5
TRIES = 4


def line_strength(text: str, at: int) -> int:
    """Strength of a cut before position `at`, which follows a line end."""
    for s, p in _LINES:
        if p.match(text, at):
            return s
    return LINE


def best_cut(text: str, low: int, high: int, target: int, reach: int) -> tuple[int, int]:
    """(position, strength) of the best cut in [low, high]; strength -1 if nothing pauses there.

    A cut scores its strength less its distance from the target; weaker kinds
    are looked for only while they can still win.
    """
    best, where, strength = float("-inf"), -1, -1
    i = text.find("\n", low - 1, high)
    while i >= 0:
        s = line_strength(text, i + 1)
        score = s - PULL * abs(i + 1 - target) / reach
        if score > best:
            best, where, strength = score, i + 1, s
        i = text.find("\n", i + 1, high)
    for s, p in _INSIDE:
        if best >= s:
            break
        for m in p.finditer(text, max(0, low - 1), high):
            e = m.end()
            if low <= e and (score := s - PULL * abs(e - target) / reach) > best:
                best, where, strength = score, e, s
    return (where, strength) if where >= 0 else (min(max(target, low), high), -1)


def plan(text: str, pieces: int, limit: int, overlap: int) -> tuple[list[int], int] | None:
    """(ends of the pieces but the last, weakest strength), or None if a limit fails."""
    n, fresh = len(text), limit - overlap
    step = (n - overlap) / pieces
    reach = max(1, int(step * 0.35))
    ends, start, weakest = [], 0, 9
    for i in range(1, pieces):
        target = round(overlap + i * step)
        # what is left must fit the pieces left, and this one its limit
        low = max(start + overlap + 1, target - reach, n - (pieces - i) * fresh)
        high = min(start + limit, target + reach)
        if low > high:
            return None
        end, strength = best_cut(text, low, high, target, reach)
        weakest = min(weakest, strength)
        ends.append(end)
        start = end - overlap
    return (ends, weakest) if n - start <= limit else None


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces; the first starts at 0, the last ends the text.

    Every piece has at most `limit` characters. A piece starts `overlap`
    characters before the end of the one before it. A text within the limit is
    one piece; an empty text none. If the fewest pieces leave no room to end at
    line ends, up to three more are tried and the plan whose weakest cut is
    strongest is taken, with as few pieces as it needs.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    n = len(text)
    if not n:
        return []
    if n <= limit:
        return [(0, n)]
    fewest = -(-(n - overlap) // (limit - overlap))
    best = None
    # every piece adds at least one character of its own
    for pieces in range(fewest, min(fewest + TRIES, n - overlap + 1)):
        made = plan(text, pieces, limit, overlap)
        if made and (best is None or made[1] > best[1]):
            best = made
        if best and best[1] >= LINE:
            break
    ends = [*(best[0] if best else range(limit, n, limit - overlap)), n]
    return list(zip([0, *(e - overlap for e in ends[:-1])], ends))


def split_items(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_kind, item_key, piece_no, n_pieces, start_at, end_at, piece) of the items over `limit`.

    `items` has item_kind, item_key, text. Items within the limit, null and
    empty ones give no rows and never leave the JVM, and no text is shuffled.
    Rows that repeat an item give its pieces again. Positions count code points
    from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for kind, key, text in zip(*(c.to_pylist() for c in b.columns)):
                spans = cut(text, limit, overlap)
                for i, (s, e) in enumerate(spans):
                    for col, v in zip(out, (kind, key, i + 1, len(spans), s, e, text[s:e])):
                        col.append(v)
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["item_kind", "item_key", "piece_no", "n_pieces", "start_at", "end_at", "piece"])

    big = items.select(F.col("item_kind").cast("string"), F.col("item_key").cast("string"), F.col("text").cast("string")).filter(F.length("text") > limit)
    return big.mapInArrow(run, "item_kind string, item_key string, piece_no int, n_pieces int, start_at int, end_at int, piece string")


def oversized_items(chunks: DataFrame, content: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item_kind, item_key, text) of the chunks, contents and text blocks of trees."""
    c = chunks.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), "text")
    d = content.select(F.lit("content").alias("item_kind"), F.col("id").cast("string").alias("item_key"), F.col("content").alias("text"))
    b = nodes.select("node_id", F.posexplode("blocks").alias("pos", "block"))
    b = b.select(F.lit("block").alias("item_kind"), F.concat("node_id", F.lit("/"), (F.col("pos") + 1).cast("string")).alias("item_key"), F.col("block.text").alias("text"))
    return c.unionByName(d).unionByName(b)
