"""Queries on missing and wrong language labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table
from .language import fit_on, label_documents, label_paragraphs


def p8_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_on(table(spark, folder, "lang_samples"), docs, "text", "lang", "doc_id")
    return label_paragraphs(docs, model, "doc_id", "text", "lang")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_paragraphs(spark, folder).where("named is null or named <> lang").select("doc_id", "para_no", "lang")


def p8_documents(spark: SparkSession, folder: str) -> DataFrame:
    return label_documents(p8_paragraphs(spark, folder))


QUERIES = {"p8_found": p8_found, "p8_paragraphs": p8_paragraphs, "p8_documents": p8_documents}
SQL: dict[str, str] = {}
