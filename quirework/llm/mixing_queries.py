"""Queries on the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .mixing import mix_sources


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(table(spark, folder, "documents"), table(spark, folder, "mix_targets"), "doc_id", "text", "source")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sources that stayed under their target with every document repeated as often as allowed."""
    return _mix(spark, folder)[1].where("short and used_tokens < target_tokens").select("source")


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p7_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


QUERIES = {"p7_found": p7_found, "p7_shares": p7_shares, "p7_repeats": p7_repeats}
SQL: dict[str, str] = {}
