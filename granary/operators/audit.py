"""Checks of parsed trees and corpora against the texts they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.hierarchy import DIGITS_CLASS, LABELS

#: Types whose heads are told by their label word alone.
TYPES = ["part", "chapter", "section", "subsection", "article"]
BLANKS = r"[ \t\r\f\x0B\xA0]+"
LINE_ENDS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no from 1, line) with the white space of each line squeezed."""
    x = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(F.col(text), LINE_ENDS)).alias("n", "line"))
    return x.select(key, (F.col("n") + 1).alias("line_no"), F.trim(F.regexp_replace("line", BLANKS, " ")).alias("line"))


def raw_heads(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node_type, n): lines that begin like the head of a type, table lines aside; counted within each row, so nothing is shuffled."""
    lines = F.transform(F.split(F.col(text), LINE_ENDS), lambda x: F.trim(F.regexp_replace(x, BLANKS, " ")))
    lines = F.filter(lines, lambda x: ~x.rlike(r"^\|.*\|$"))

    def count(pattern: str) -> Column:
        return F.size(F.filter(lines, lambda x: x.rlike(pattern)))

    each = F.array(*(F.struct(F.lit(kind).alias("node_type"), count(rf"^(?:{word}|{word.upper()}) +{DIGITS_CLASS[digits]}").alias("n")) for word, kind, digits, _ in LABELS if kind in TYPES))
    return docs.filter(F.col(text).isNotNull()).select(key, F.explode(each).alias("e")).select(key, "e.node_type", "e.n")


def raw_against_tree(docs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """(node_type, n_lines, n_nodes, n_differing): heads in the texts, nodes in the trees, documents in which their numbers differ."""
    tree = nodes.filter(F.col("node_type").isin(TYPES)).groupBy(key, "node_type").agg(F.count(F.lit(1)).alias("m"))
    j = raw_heads(docs, key, text).join(tree, [key, "node_type"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return j.groupBy("node_type").agg(F.sum("n").alias("n_lines"), F.sum("m").alias("n_nodes"), F.count_if(F.col("n") != F.col("m")).alias("n_differing"))


def unknown_headings(docs: DataFrame, key: str, text: str, known: str) -> DataFrame:
    """(heading, n, first_id): short lines mostly in capitals that no pattern of `known` takes, with how often they stand."""
    x = lines_of(docs, key, text)
    letters = F.length(F.regexp_replace("line", r"\P{L}", ""))
    capitals = F.length(F.regexp_replace("line", r"\P{Lu}", ""))
    odd = x.filter((F.length("line").between(4, 120)) & (letters > 0) & (capitals > 0.72 * letters) & ~F.col("line").rlike(known) & ~F.col("line").rlike(r"[.;,|]$"))
    return odd.groupBy(F.col("line").alias("heading")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_id"))


def most_common(df: DataFrame, value: str, pos: list[str], n: int) -> DataFrame:
    """(value, count, rank): the n values that occur most; of equals the one seen first in the order of `pos`."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct(*pos)).alias("p_"))
    top = g.orderBy(F.desc("count"), "p_").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "p_")).cast("int")).drop("p_")
