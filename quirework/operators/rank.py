"""Lexical, dense and fused ranking, for all queries at once.

The inverted index is three tables: postings (doc, term, tf), document lengths and term weights. Statistics may span the
collection, one group of it (a paper) or one candidate set: the group columns say which. Ranks are cut to k before they are sorted in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import cut
from ..functions.text import terms

K1, B = 1.5, 0.75
RRF_K = 60
#: Query vectors that are broadcast together.
QUERIES_AT_ONCE = 20_000


def postings(docs: DataFrame, doc: str, text: str, group: list[str] | None = None) -> DataFrame:
    """group columns, doc, term, tf, dl: each term of each document once; dl is the document's number of terms.

    Documents without terms have no rows. Rows of the same document are counted together.
    """
    group = group or []
    # One shuffle by document serves the counts and the lengths.
    rows = docs.select(*group, F.col(doc).alias("doc"), F.explode(terms(text)).alias("term")).repartition(*group, "doc")
    each = rows.groupBy(*group, "doc", "term").agg(F.count("*").alias("tf"))
    return each.withColumn("dl", F.sum("tf").over(Window.partitionBy(*group, "doc")))


def collection_size(docs: DataFrame, doc: str, text: str, group: list[str] | None = None) -> DataFrame:
    """group columns, n (documents, those without terms too), avgdl. Without groups a single row."""
    group = group or []
    rows = docs.groupBy(*group, F.col(doc).alias("doc")).agg(F.sum(F.size(terms(text))).alias("dl"))
    return rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def document_frequency(post: DataFrame, group: list[str] | None = None) -> DataFrame:
    return post.groupBy(*(group or []), "term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(queries: DataFrame, query: str, query_text: str, docs: DataFrame, doc: str, text: str, group: list[str] | None = None) -> DataFrame:
    """group columns, query, doc, score, for every query and document with a common term.

    With groups, a query meets the documents of its own group (queries has the group columns too) and all statistics are
    the group's. A query's terms count once each. Scores are rounded to nine digits, so that ties are ties anywhere.
    """
    group = group or []
    wanted = queries.select(*group, F.col(query).alias("query"), F.explode(F.array_distinct(terms(query_text))).alias("term")).distinct()
    post = postings(docs, doc, text, group)
    size = collection_size(docs, doc, text, group)
    weight = document_frequency(post, group)
    # Only terms that are asked for; the size is one row (or one a group).
    weight = weight.join(wanted.select(*group, "term").distinct(), [*group, "term"], "left_semi")
    weight = weight.join(size, group) if group else weight.crossJoin(F.broadcast(size))
    weight = weight.select(*group, "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    tf, length = F.col("tf"), F.col("dl") / F.col("avgdl")
    part = F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    scored = post.join(weight, [*group, "term"]).select(*group, "term", "doc", part.alias("part"))
    return scored.join(wanted, [*group, "term"]).groupBy(*group, "query", "doc").agg(F.round(F.sum("part"), 9).alias("score"))


def top(ranked: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each group, numbered from 1 in this order, which must leave no ties."""
    return ranked.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dense_top(queries: DataFrame, query: str, vectors: DataFrame, doc: str, vector: str, k: int) -> DataFrame:
    """query, doc, score, rank: the k nearest vectors of each query by cosine, ties by doc; the query's own row is left out.

    A block of query vectors of bounded size is broadcast at a time and multiplied with Arrow batches of all vectors; only each
    batch's own best k per query go on, so nothing of the size of queries x vectors is ever shuffled. With several blocks
    each one's part is written before the next is gathered.
    """
    import numpy as np
    import pyarrow as pa

    asked = queries.select(F.col(query).cast("long").alias("query"), F.col(vector).alias("v")).where("v is not null")
    spark = vectors.sparkSession
    rows = vectors.select(F.col(doc).cast("long").alias("doc"), F.col(vector).alias("v")).where("v is not null")
    schema = "query long, doc long, score double"

    def lengthened(m):
        m = m.astype(np.float64)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def against(block: list) -> tuple[DataFrame, object]:
        shared = spark.sparkContext.broadcast((np.array([q for q, _ in block], np.int64), lengthened(np.array([v for _, v in block]))))

        def run(batches):
            ids, asked = shared.value
            for batch in batches:
                v = batch.column(1)
                m = lengthened(v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                docs = batch.column(0).to_numpy()
                scores = np.round(asked @ m.T, 9)
                scores[ids[:, None] == docs[None, :]] = -np.inf
                n = min(k, len(docs))
                # Ties at the edge are kept: the last place is decided among all batches.
                edge = np.partition(scores, len(docs) - n, axis=1)[:, len(docs) - n]
                at, who = np.nonzero((scores >= edge[:, None]) & (scores > -np.inf))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(docs[who]), pa.array(scores[at, who])], names=["query", "doc", "score"])

        return rows.mapInArrow(run, schema), shared

    whole, block = None, []
    for row in asked.toLocalIterator():
        if len(block) == QUERIES_AT_ONCE:  # there are more: this block's part is written, and nothing of it stays on the driver
            part, shared = against(block)
            part, block = cut(part), []
            shared.destroy()
            whole = part if whole is None else whole.unionByName(part)
        block.append((row["query"], row["v"]))
    last = against(block)[0] if block else spark.createDataFrame([], schema)
    whole = last if whole is None else whole.unionByName(last)
    return top(whole, k, ["query"], [F.desc("score"), F.col("doc")])


def centroids(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """group, centroid: the mean of the vectors of each group, at length 1."""
    at = vectors.select(F.col(group).alias("group"), F.posexplode(vector).alias("i", "x"))
    mean = at.groupBy("group", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    return whole.select("group", unit(F.col("c")).alias("centroid"))


def rrf(ranked: DataFrame, by: list[str], doc: str, rank: str, k: int = RRF_K) -> DataFrame:
    """by, doc, score: reciprocal-rank fusion of lists; ranks count from 1, a document counts in every row it has."""
    return ranked.groupBy(*by, doc).agg(F.round(F.sum(1.0 / (k + F.col(rank))), 9).alias("score"))
