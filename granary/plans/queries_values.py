"""Queries over packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from granary.operators.packed_values import MAX_NAMES, explode_packed
from granary.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    names = [r.sector_name for r in table(spark, d, "sector_list").select("sector_name").limit(MAX_NAMES + 1).collect()]
    return explode_packed(table(spark, d, "doc_metadata"), "id", {"legal_sectors": {"names": names, "dash": True}, "signers": {"words": ("và",)}})


QUERIES = {"p5_found": p5_found}
ORACLE_SQL: dict[str, str] = {}
