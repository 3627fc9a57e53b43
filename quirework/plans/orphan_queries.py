"""Queries of the orphan-reference operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.orphans import orphan_references, orphan_report
from ..sources.tables import table


def _orphans(spark: SparkSession, folder: str) -> DataFrame:
    refs = [
        table(spark, folder, name).select(F.lit(name).alias("src_table"), "row_id", "paper_id", F.col(at).alias("at"))
        for name, at in (("objects", "extracted_at"), ("candidates", "proposed_at"))
    ]
    papers = table(spark, folder, "papers").select("paper_id", "added_at", "withdrawn_at")
    return orphan_references(refs[0].unionByName(refs[1]), papers, "paper_id", "at", ["src_table", "row_id"], "paper_id", "added_at", "withdrawn_at")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _orphans(spark, folder).select("src_table", "row_id", "reason")


def p1_report(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_report(_orphans(spark, folder), ["src_table"])


_KEY = r"lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_ORPHANS = f"""
    refs AS (
        SELECT 'objects' AS src_table, row_id, {_KEY.format('paper_id')} AS k, extracted_at AS t FROM objects
        UNION ALL
        SELECT 'candidates', row_id, {_KEY.format('paper_id')}, proposed_at FROM candidates),
    parents AS (SELECT {_KEY.format('paper_id')} AS k, added_at, withdrawn_at FROM papers),
    judged AS (
        SELECT r.src_table, r.row_id, r.t, count(p.k) AS n, min(p.added_at) AS earliest,
               coalesce(bool_or(p.added_at <= r.t AND (p.withdrawn_at IS NULL OR p.withdrawn_at > r.t)), FALSE) AS present
        FROM refs r LEFT JOIN parents p ON p.k = r.k WHERE r.k IS NOT NULL GROUP BY ALL),
    orphans AS (
        SELECT src_table, row_id, t,
               CASE WHEN n = 0 THEN 'missing' WHEN earliest > t THEN 'late' ELSE 'deleted' END AS reason
        FROM judged WHERE n = 0 OR (t IS NOT NULL AND NOT present))
"""

QUERIES = {"p1_found": p1_found, "p1_report": p1_report}
SQL = {
    "p1_found": f"WITH {_ORPHANS} SELECT src_table, row_id, reason FROM orphans",
    "p1_report": f"WITH {_ORPHANS} SELECT src_table, strftime(t, '%Y-%m') AS month, reason, count(*) AS n_rows FROM orphans GROUP BY ALL",
}
