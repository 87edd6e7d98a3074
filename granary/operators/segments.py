"""Segments of texts: word windows, headings, table lines. All without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import let, squeeze
from granary.session import spread

PER_WORD = 1.35
#: A line that opens an article, markup before it set aside.
HEADING = r"^\s*(?:<[^<>]{1,40}>|[#=>*]+|\\\w+\{)*\s*(?:Điều|Article)\s+\d+"


def word_windows(df: DataFrame, key: str, text: str, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """(key, piece_no, piece, n_words): windows of words with overlap; the last reaches the end.

    Budgets are in estimated tokens (PER_WORD to a word). Blank texts have none.
    """
    size, back = max(1, int(max_tokens / PER_WORD)), max(0, int(overlap_tokens / PER_WORD))
    step = max(1, size - back)

    def windows(w: Column) -> Column:
        n = F.when(F.size(w) <= size, F.lit(0)).otherwise(F.ceil((F.size(w) - size) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(w, i * step + 1, F.lit(size)))

    # windows are made before they become rows, so that no row carries the words of all
    parts = let(F.split(squeeze(text), " "), windows)
    s = spread(df.select(key, text)).filter(squeeze(text) != "").select(key, F.posexplode(parts).alias("i", "part"))
    return s.select(key, (F.col("i") + 1).cast("int").alias("piece_no"), F.array_join("part", " ").alias("piece"), F.size("part").alias("n_words"))


def heading_segments(df: DataFrame, key: str, text: str, heading: str = HEADING) -> DataFrame:
    """(key, segment_no, heading, article_no, segment): the text cut before each heading line; segment 0 is what comes first.

    Works within each row, without a window over the lines of one very long
    document. Blank segments are left out; null texts have none.
    """
    lines = F.split(F.col(text), "\n")
    # one scan: a mark before every heading line, then a split at the marks
    marked = F.array_join(F.transform(lines, lambda x: F.when(x.rlike(heading), F.concat(F.lit("\x00"), x)).otherwise(x)), "\n")
    parts = F.split(marked, "\x00")
    # each part but the last ends with the line end before the next mark
    bare = let(parts, lambda ps: F.transform(ps, lambda x, i: F.when((i < F.size(ps) - 1) & F.endswith(x, F.lit("\n")), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x)))
    w = spread(df.select(key, text).filter(F.col(text).isNotNull())).select(key, F.posexplode(bare).alias("segment_no", "segment"))
    head = F.when(F.col("segment_no") > 0, squeeze(F.split_part("segment", F.lit("\n"), F.lit(1)))).otherwise(F.lit(""))
    return w.filter(squeeze("segment") != "").select(key, F.col("segment_no").cast("int").alias("segment_no"), head.alias("heading"), F.regexp_extract(head, r"((?:Điều|Article)\s+\d+[A-Za-z]?)", 1).alias("article_no"), "segment")


def table_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_start, line_end, n_lines): runs of consecutive table lines (`| ... |`)."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    t = lines.filter(squeeze("line").rlike(r"^\|.*\|$") & (F.length(squeeze("line")) > 1)).select(key, (F.col("n") + 1).alias("n"))
    g = t.withColumn("g", F.col("n") - F.row_number().over(Window.partitionBy(key).orderBy("n")))
    return g.groupBy(key, "g").agg(F.min("n").alias("line_start"), F.max("n").alias("line_end"), F.count(F.lit(1)).cast("int").alias("n_lines")).drop("g")


def table_markdown(headers: Column, rows: Column) -> Column:
    """A table as pipe lines; rows are padded or cut to the headers."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    fit = lambda r: F.transform(F.sequence(F.lit(0), F.size(headers) - 1), lambda i: F.coalesce(F.get(r, i), F.lit("")))
    full = F.concat(F.array(line(headers), line(F.transform(headers, lambda _: F.lit("---")))), F.transform(rows, lambda r: line(fit(r))))
    return F.array_join(F.when(F.size(headers) > 0, full).otherwise(F.transform(rows, line)), "\n")
