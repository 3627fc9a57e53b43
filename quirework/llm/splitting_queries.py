"""Queries on texts over the size limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import table
from .splitting import split_oversized

#: Table, its key, words at most, words repeated.
_TABLES = (("documents", "doc_id", 300, 30), ("bib_entries", "entry_id", 80, 10))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    a, b = (
        split_oversized(table(spark, folder, name), "text", limit, overlap, [key]).withColumnRenamed(key, "item_id").withColumn("src_table", F.lit(name))
        for name, key, limit, overlap in _TABLES
    )
    return a.unionByName(b)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that the splitter cut."""
    return _split(spark, folder).where("size(pieces) > 1").select("src_table", "item_id", "cut_kind")


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder).select("src_table", "item_id", F.inline("pieces")).select("src_table", "item_id", "piece_no", F.expr("concat(overlap, fresh)").alias("text"), F.expr(r"regexp_count(overlap, r'(?U)\S+')").alias("n_repeated"), "cut")


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}

_FOUND = r"""
    SELECT '{name}' AS src_table, {key} AS item_id,
           CASE WHEN len(list_filter(stretches, lambda x: len(regexp_extract_all(x, '[^{s}]+')) > {limit})) > 0
                THEN 'forced' ELSE 'natural' END AS cut_kind
    FROM (SELECT {key}, string_split(regexp_replace(regexp_replace(text, '\n[^\n\S]*\n', chr(1), 'g'), '([.!?])[{s}]+', '\1' || chr(1), 'g'), chr(1)) AS stretches,
                 len(regexp_extract_all(text, '[^{s}]+')) AS n FROM {name})
    WHERE n > {limit}"""
SQL = {
    "p3_found": " UNION ALL ".join(_FOUND.format(name=name, key=key, limit=limit, s=r"\s\p{Z}\x0B\x{85}") for name, key, limit, _ in _TABLES)
}
