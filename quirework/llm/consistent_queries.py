"""Queries on texts that look alike but differ in characters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .consistent import consistent_form

_TEXTS = (("objects", "row_id", "caption"), ("papers", "row_id", "title"), ("questions", "query_id", "question"))


def _forms(spark: SparkSession, folder: str) -> DataFrame:
    texts = [
        table(spark, folder, name).where(F.col(text).isNotNull()).select(F.lit(name).alias("src_table"), F.col(key).cast("string").alias("row_key"), F.col(text).alias("text"))
        for name, key, text in _TEXTS
    ]
    return consistent_form(reduce(DataFrame.unionByName, texts), "text", "form")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _forms(spark, folder).where("text <> form").select("src_table", "row_key")


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The texts that are equal in their consistent form but were spelled in several ways, with their counts."""
    return _forms(spark, folder).groupBy("src_table", "form").agg(F.count_distinct("text").alias("n_spellings"), F.count("*").alias("n_rows")).where("n_spellings > 1")


QUERIES = {"p4_found": p4_found, "p4_forms": p4_forms}
SQL: dict[str, str] = {}
