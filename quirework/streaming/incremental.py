"""Index statistics and logs that are kept up to date as documents arrive.

The weights of BM25 depend on counts over all documents (their number, their lengths, how many have a term), which add up:
each micro-batch appends its own counts, marked with the batch's number, and readers add the batches. A batch that is
repeated after a failure replaces its own counts, so nothing is counted twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rank import idf, postings


def watch_documents(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream over the Parquet files of a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_statistics(stream: DataFrame, doc: str, text: str, store: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes each batch's postings, and its counts, below `store`; with `once` what is there is taken and the query ends."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        post = postings(rows, doc, text).persist()
        post.write.mode("overwrite").parquet(f"{store}/postings/batch={number}")
        post.groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{store}/terms/batch={number}")
        rows.agg(F.count_distinct(doc).alias("n")).crossJoin(post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("terms"))).write.mode("overwrite").parquet(f"{store}/size/batch={number}")
        post.unpersist()
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def statistics(spark: SparkSession, store: str) -> DataFrame:
    """term, df, idf, n, avgdl over all batches so far."""
    size = spark.read.parquet(f"{store}/size").agg(F.sum("n").alias("n"), (F.sum("terms") / F.sum("n")).alias("avgdl"))
    terms = spark.read.parquet(f"{store}/terms").groupBy("term").agg(F.sum("df").alias("df"))
    return terms.crossJoin(F.broadcast(size)).select("term", "df", F.round(idf(F.col("n"), F.col("df")), 9).alias("idf"), "n", "avgdl")


def windowed_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """by, begin, n: events in windows of time; those later than `late` behind the newest are not counted any more."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count("*").alias("n")).select(by, F.col("window.start").alias("begin"), "n")
