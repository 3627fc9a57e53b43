"""Queries on papers that are largely the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.graph import components
from ..sources.tables import table
from .near import expand_pairs, near_duplicates

#: As the statement of the problem has them.
_WORDS, _THRESHOLD = 3, 0.55


def _near(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, folder, "papers"), "paper_id", ["title", "abstract"], _WORDS, _THRESHOLD)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return expand_pairs(*_near(spark, folder)).select(F.col("a").alias("paper_a"), F.col("b").alias("paper_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each paper with its class of equal content, the number of that class's links, and its group of linked classes."""
    classes, pairs = _near(spark, folder)
    links = pairs.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("n_links"))
    groups = components(classes.select(F.col("class").alias("node")).distinct(), pairs.select("a", "b")).withColumnRenamed("node", "class")
    return classes.join(links, "class", "left").join(groups, "class").select(F.col("key").alias("paper_id"), "class", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("component").alias("group"))


QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
SQL: dict[str, str] = {}
