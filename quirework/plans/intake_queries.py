"""Queries on what comes in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import intake as I
from ..sources.pool import load_pool
from ..sources.tables import table


def _paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.split("text", r"\n\s*\n").alias("pages"))


def pages_numbered(spark: SparkSession, folder: str) -> DataFrame:
    return I.numbered_pages(_paragraphs(spark, folder), ["doc_id"], "pages")


def document_artifacts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of which some failed and some were never parsed."""
    parsed = _paragraphs(spark, folder).where("doc_id % 7 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 != 1, F.col("pages")).alias("pages"), F.when(F.col("doc_id") % 3 == 0, "torn").alias("error"))
    out = I.artifacts(_paragraphs(spark, folder), parsed, "doc_id", ["pages"])
    return out.select("doc_id", F.size("pages").alias("n_pages"), "error")


def pool_key(spark: SparkSession, folder: str) -> DataFrame:
    return I.collection_key(load_pool(table(spark, folder, "papers")), "paper_id", "row_id", "m1")


def cells_typed(spark: SparkSession, folder: str) -> DataFrame:
    """Values of lines written in several ways, as numbers, truth values and texts."""
    q, k = F.col("l_quantity").cast("int").cast("string"), (F.col("l_partkey") + F.col("l_linenumber")) % 6
    raw = F.element_at(F.array(F.concat(F.lit(" 1,"), F.lpad(q, 3, "0"), F.lit(" %")), F.lit("Yes"), F.lit("n/a"), F.concat(q, F.lit("  pcs")), F.concat(q, F.lit("e1")), F.lit("NaN")), (k + 1).cast("int"))
    kind = F.element_at(F.array(F.lit("number"), F.lit("boolean"), F.lit("string")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return I.typed_cells(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.concat(F.lit("c"), "l_linenumber").alias("name"), kind.alias("kind"), raw.alias("raw")))


def stores_preflight(spark: SparkSession, folder: str) -> DataFrame:
    stores = {"papers": (table(spark, folder, "papers"), "paper_id"), "objects": (table(spark, folder, "objects"), "paper_id"), "embeddings": (table(spark, folder, "embeddings"), "vec_id"), "documents": (table(spark, folder, "documents"), "doc_id"), "none": (table(spark, folder, "documents").where("doc_id < 0"), "doc_id")}
    return I.preflight(stores, [("objects", "papers"), ("embeddings", "documents"), ("documents", "embeddings")])


QUERIES = {f.__name__: f for f in (pages_numbered, document_artifacts, pool_key, cells_typed, stores_preflight)}
SQL = {
    "pages_numbered": r"SELECT doc_id, generate_subscripts(p, 1) AS page, unnest(p) AS text FROM (SELECT doc_id, string_split_regex(text, '\n\s*\n') AS p FROM documents)",
    "document_artifacts": r"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 1 THEN 0 ELSE len(string_split_regex(text, '\n\s*\n')) END AS n_pages, CASE WHEN doc_id % 7 = 0 THEN 'not parsed' WHEN doc_id % 3 = 0 THEN 'torn' END AS error FROM documents""",
    "pool_key": "SELECT sha256(concat_ws('|', 'm1', count(*), sum(('0x' || md5(r || ':' || paper_id)[1:12])::BIGINT::HUGEINT))) AS key FROM (SELECT paper_id, min(row_id) AS r FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id)",
    "cells_typed": """WITH l AS (SELECT l_orderkey AS row_id, 'c' || l_linenumber AS name, ['number', 'boolean', 'string'][l_suppkey % 3 + 1] AS kind, (l_partkey + l_linenumber) % 6 AS k, l_quantity::INT AS q FROM lineitem), v AS (SELECT row_id FROM l GROUP BY row_id, name HAVING count(*) > 1)
        SELECT row_id, name, kind, CASE WHEN kind = 'number' THEN CASE k WHEN 0 THEN 1000.0 + q WHEN 4 THEN q * 10.0 END END::DOUBLE AS number, CASE WHEN kind = 'boolean' AND k = 1 THEN TRUE END AS truth,
            CASE WHEN kind = 'string' THEN CASE k WHEN 0 THEN '1,' || lpad(q::VARCHAR, 3, '0') || ' %' WHEN 1 THEN 'Yes' WHEN 3 THEN q || ' pcs' WHEN 4 THEN q || 'e1' WHEN 5 THEN 'NaN' END END AS words FROM l ANTI JOIN v USING (row_id)""",
    "stores_preflight": """WITH f AS (
        SELECT 'papers' AS store, 'repeated_id' AS "check", count(*) AS n FROM (SELECT paper_id FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING count(*) > 1)
        UNION ALL SELECT 'papers', 'null_id', count(*) FILTER (paper_id IS NULL) FROM papers UNION ALL SELECT 'objects', 'null_id', count(*) FILTER (paper_id IS NULL) FROM objects
        UNION ALL SELECT 'objects', 'repeated_id', count(*) FROM (SELECT paper_id FROM objects WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING count(*) > 1)
        UNION ALL SELECT 'objects', 'not_in_papers', count(DISTINCT paper_id) FROM objects WHERE paper_id NOT IN (SELECT paper_id FROM papers WHERE paper_id IS NOT NULL)
        UNION ALL SELECT 'embeddings', 'not_in_documents', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'documents', 'not_in_embeddings', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)
        UNION ALL SELECT 'none', 'empty', 1) SELECT * FROM f WHERE n > 0""",
}
