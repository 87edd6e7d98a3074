"""Filters on payload columns and keyword rules, as plain expressions that reach the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def payload_filter(equal: dict | None = None, contains: dict | None = None, between: dict | None = None) -> Column:
    """All conditions together: equal values, array members, ranges with both ends."""
    parts = [F.col(c) == F.lit(v) for c, v in (equal or {}).items()]
    parts += [F.array_contains(F.col(c), v) for c, v in (contains or {}).items()]
    parts += [F.col(c).between(a, b) for c, (a, b) in (between or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def keyword_hits(df: DataFrame, key: str, text: str, rules: dict[str, list[str]]) -> DataFrame:
    """(key, rule, hits): how many keywords of a rule a text has; rules without a hit are left out.

    The rules are literals in the expression, so nothing is joined.
    """
    hit = lambda words: reduce(lambda a, b: a + b, [F.contains(F.col(text), F.lit(w)).cast("int") for w in sorted(set(words))])
    each = F.array(*(F.struct(F.lit(n).alias("rule"), hit(w).alias("hits")) for n, w in rules.items()))
    return df.filter(F.col(text).isNotNull()).select(key, F.explode(each).alias("e")).select(key, "e.rule", "e.hits").filter("hits > 0")


def top_rules(hits: DataFrame, key: str, k: int) -> DataFrame:
    """The k rules with the most hits per key; ties by name."""
    w = Window.partitionBy(key).orderBy(F.col("hits").desc(), F.col("rule"))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
