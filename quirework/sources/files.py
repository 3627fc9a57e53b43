"""Sources other than Parquet tables: JSON lines, folders of artifacts, binary documents, and question files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

PDF_MAGIC = "%PDF-"


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType, strict: bool = False) -> DataFrame:
    """Rows of a JSON-lines file or folder; blank lines are skipped. Lines that are no objects fail (strict) or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def artifacts(spark: SparkSession, folder: str, schema: str | T.StructType) -> DataFrame:
    """One row for each readable `*.json` document of a folder, with its file's name as artifact_id; unreadable ones are skipped."""
    whole = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*whole.fields, T.StructField("_broken", T.StringType())])
    rows = spark.read.schema(marked).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("pathGlobFilter", "*.json").json(folder)
    named = rows.select("*", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("artifact_id"))
    return named.where("_broken is null").drop("_broken")


def first_documents(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The n rows of least key: a bound on a source, for trials."""
    return rows.orderBy(key).limit(n)


def binary_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """doc_id, path, bytes, sha256, is_pdf, content of each file; nothing of the content is read where it isn't asked for."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1") == PDF_MAGIC
    return rows.select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("doc_id"), "path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), head.alias("is_pdf"), "content")


def fetched(asked: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """asked with the document of its key from a snapshot, or nulls: nothing is fetched from elsewhere."""
    return asked.join(documents.withColumnRenamed("doc_id", key), key, "left")


def options_of(listed: Column, mapped: Column) -> Column:
    """Multiple-choice options as a map, from a list of (label, text), of repeated labels the first, or from a map."""
    labels = F.transform(listed, lambda o: F.upper(F.trim(o["label"])))
    first = F.filter(F.transform(listed, lambda o, i: F.struct(F.upper(F.trim(o["label"])).alias("label"), o["text"].alias("text"), i.alias("i"))), lambda o: (F.array_position(labels, o["label"]) == o["i"] + 1) & (o["label"] != ""))
    return F.coalesce(F.map_from_entries(F.transform(first, lambda o: F.struct(o["label"], o["text"]))), mapped)
