"""Sinks: stores of records, append-only logs, and submissions that are checked before they are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.evidence import SOURCE_TYPES
from ..operators.score import violations


def write_store(records: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Parquet, sorted within files by the columns that later reads filter on, so that their row groups are pruned.

    An existing store is an error: the committer leaves either the whole new store or none.
    """
    (records.sortWithinPartitions(*by) if by else records).write.mode("errorifexists").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to a log; readers take the last row of each key (`manifest.latest`)."""
    rows.write.mode("append").parquet(path)


def write_submission(lines: DataFrame, questions: DataFrame, path: str) -> None:
    """JSON lines, one a question; refused, with the rules and counts, if the lines break the contract or the path exists."""
    broken = violations(lines, questions, SOURCE_TYPES).groupBy("rule").agg(F.sum("n").alias("n")).orderBy("rule").collect()  # at most one row a rule
    if broken:
        raise ValueError("not written: " + ", ".join(f"{r['rule']} {r['n']}" for r in broken))
    lines.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
