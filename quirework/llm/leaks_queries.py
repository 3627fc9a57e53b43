"""Queries on evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .leaks import find_leaks


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the items they hold, exactly or with one edited word in thirteen."""
    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"), "doc_id", "text", "item_id", "item_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_leaks(spark, folder).where("edits = 0").select("doc_id", "item_id")


QUERIES = {"p6_found": p6_found, "p6_leaks": p6_leaks}
SQL: dict[str, str] = {}
