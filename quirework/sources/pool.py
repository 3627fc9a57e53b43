"""The pool of papers, one row an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def load_pool(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """Of several rows with one paper_id the first by `order`; missing texts are empty, missing authors an empty array."""
    kept = [c for c in rows.columns if c != "paper_id"]
    first = rows.where("paper_id is not null").groupBy("paper_id").agg(F.min_by(F.struct(*kept), order).alias("r"))
    pool = first.select("paper_id", "r.*")
    return pool.withColumns({"abstract": F.coalesce("abstract", F.lit("")), "authors": F.coalesce("authors", F.array().cast("array<string>")), "venue": F.lower("venue")})
