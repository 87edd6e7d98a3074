"""Joins, upserts and reports over document collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import squeeze
from granary.session import plain_unions, written


def row_hash(df: DataFrame) -> Column:
    """A tie-break among rows that differ: the hash of all columns (maps aside)."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()))


def latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first in `order`. Null keys form a group of their own."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("n_", F.row_number().over(w)).filter("n_ = 1").drop("n_")


def latest_of_few(df: DataFrame, key: str, order: list[Column], most: int = 1_000_000) -> DataFrame:
    """As `latest`, for wide rows of which few repeat a key: only those are shuffled.

    The keys that repeat are found from the key column alone. If there are more
    than `most`, all rows go through `latest`.
    """
    plain_unions(df.sparkSession)
    repeated = written(df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1").select(key), "repeated")
    if repeated.count() > most:
        return latest(df, [key], order)
    again = df.join(F.broadcast(repeated), key, "left_semi").unionByName(df.filter(F.col(key).isNull()))
    return df.filter(F.col(key).isNotNull()).join(F.broadcast(repeated), key, "left_anti").unionByName(latest(again, [key], order))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both by key; the new ones win, of equals those with the lower hash."""
    plain_unions(old.sparkSession)
    both = old.withColumn("gen_", F.lit(0)).unionByName(new.withColumn("gen_", F.lit(1)), allowMissingColumns=True)
    return latest(both, key, [F.col("gen_").desc(), row_hash(both)]).drop("gen_")


def fill_status(meta: DataFrame, status: DataFrame, key: str = "id", column: str = "effect_status") -> DataFrame:
    """Blank statuses of `meta` filled from `status`, whose greatest non-blank value per key counts."""
    s = status.filter(squeeze(column) != "").groupBy(key).agg(F.max(column).alias("s_"))
    own = squeeze(column)
    return meta.join(s, key, "left").withColumn(column, F.coalesce(F.when(own != "", own), squeeze(F.col("s_")))).drop("s_")


def occurrence(df: DataFrame, basis: Column, order: list[Column]) -> DataFrame:
    """Adds `occurrence`: how many rows with the same basis come before, from 0."""
    return df.withColumn("b_", basis).withColumn("occurrence", F.row_number().over(Window.partitionBy("b_").orderBy(*order)) - 1).drop("b_")


def title_map(rows: DataFrame, key: str, title: str, named: Column, pos: list[str]) -> DataFrame:
    """(key, title): the first title of a key, or its longest named one if that is longer."""
    r = rows.filter((squeeze(key) != "") & (squeeze(title) != "")).select(key, squeeze(title).alias("t"), named.alias("named"), F.struct(*pos).alias("p"))
    first = F.min(F.struct("p", "t"))
    # the longest named title, the earliest of equals: a total order on (-length, position)
    best = F.min(F.when(F.col("named"), F.struct((-F.length("t")).alias("n"), F.col("p"), F.col("t"))))
    g = r.groupBy(key).agg(first.alias("f"), best.alias("b"))
    return g.select(key, F.when(F.length("b.t") > F.length("f.t"), F.col("b.t")).otherwise(F.col("f.t")).alias("title"))


def matches_stored(rows: DataFrame, stored: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, matches): whether all fields present on both sides agree as text, and at least one is present."""
    s = stored.select(key, *(F.col(f).cast("string").alias(f"s_{f}") for f in fields))
    j = rows.join(s, key)
    present = [F.col(f).isNotNull() & F.col(f"s_{f}").isNotNull() for f in fields]
    same = [~p | F.col(f).cast("string").eqNullSafe(F.col(f"s_{f}")) for p, f in zip(present, fields)]
    some, every = present[0], same[0]
    for p, q in zip(present[1:], same[1:]):
        some, every = some | p, every & q
    return j.select(key, F.coalesce(some & every, F.lit(False)).alias("matches"))


def counts_by(df: DataFrame, dimensions: dict[str, Column], keep: Column) -> DataFrame:
    """(dimension, value, n_all, n_kept) of several dimensions in one pass; blank values count as `unknown`."""
    named = lambda c: F.when(squeeze(c) == "", F.lit("unknown")).otherwise(squeeze(c))
    entries = F.array(*(F.struct(F.lit(n).alias("dimension"), named(c.cast("string")).alias("value")) for n, c in dimensions.items()))
    return df.select(F.explode(entries).alias("e"), keep.alias("k")).groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("k").alias("n_kept"))


def stratified(df: DataFrame, bucket: Column, order: list[Column], per_bucket: int) -> DataFrame:
    """The first `per_bucket` rows of each bucket."""
    return df.withColumn("bucket", bucket).withColumn("n_in_bucket", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).filter(F.col("n_in_bucket") <= per_bucket)
