"""Queries of lexical, dense and fused ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import rank as R
from ..sources.tables import table
from . import sql


def postings_tf(spark: SparkSession, folder: str) -> DataFrame:
    return R.postings(table(spark, folder, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "term", "tf")


def doc_length(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.size(R.terms("text")).cast("long").alias("dl"))


def term_idf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    size = F.broadcast(R.collection_size(docs, "doc_id", "text"))  # a single row
    df = R.document_frequency(R.postings(docs, "doc_id", "text")).crossJoin(size)
    return df.select("term", "df", F.round(R.idf(F.col("n"), F.col("df")), 9).alias("idf"))


def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten documents that each evaluation item is most like."""
    scored = R.bm25(table(spark, folder, "eval_items"), "item_id", "item_text", table(spark, folder, "documents"), "doc_id", "text")
    best = R.top(scored, 10, ["query"], [F.desc("score"), F.col("doc")])
    return best.select(F.col("query").alias("item_id"), F.col("doc").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Each question with each of its candidate papers, once."""
    pairs = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return pairs.join(table(spark, folder, "questions").select("query_id", "question"), "query_id")


def bm25_within_paper(spark: SparkSession, folder: str) -> DataFrame:
    """The three captions of each candidate paper that answer the question best, by statistics of that paper alone."""
    captions = table(spark, folder, "objects").where("paper_id is not null").select("paper_id", "row_id", "caption")
    scored = R.bm25(_asked(spark, folder), "query_id", "question", captions, "row_id", "caption", ["paper_id"])
    best = R.top(scored, 3, ["paper_id", "query"], [F.desc("score"), F.col("doc")])
    return best.select(F.col("query").alias("query_id"), "paper_id", F.col("doc").alias("row_id"), "rank", F.round("score", 6).alias("score"))


def bm25_candidate_set(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates' support texts of each question, by statistics of that question's support alone."""
    support = table(spark, folder, "candidates").select("query_id", "row_id", F.posexplode("support").alias("i", "s"))
    support = support.select("query_id", F.concat_ws(":", "row_id", "i").alias("support_key"), F.col("s.text").alias("text"))
    asked = table(spark, folder, "questions").select("query_id", F.col("query_id").alias("query"), "question")
    scored = R.bm25(asked, "query", "question", support, "support_key", "text", ["query_id"])
    best = R.top(scored, 5, ["query_id"], [F.desc("score"), F.col("doc")])
    return best.select("query_id", F.col("doc").alias("support_key"), "rank", F.round("score", 6).alias("score"))


def dense_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    best = R.dense_top(vectors.where("vec_id % 100 = 0"), "vec_id", vectors, "vec_id", "embedding", 10)
    return best.select(F.col("query").alias("query_id"), F.col("doc").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def seed_centroid_knn(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors nearest to the centroid of each label's seeds (ids divisible by 100), seeds left out."""
    vectors = table(spark, folder, "embeddings")
    seeds = vectors.where("vec_id % 100 = 0")
    centre = R.centroids(seeds, "label", "embedding")
    others = vectors.join(seeds.select("vec_id"), "vec_id", "left_anti").select((F.col("vec_id") + 1).alias("doc"), "embedding")
    best = R.dense_top(centre.select((-F.col("group") - 1).alias("q"), "centroid"), "q", others.withColumnRenamed("embedding", "centroid"), "doc", "centroid", 5)
    return best.select((-F.col("query") - 1).alias("label"), (F.col("doc") - 1).alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """The ten papers of each question by all its routes' ranks."""
    signals = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", F.inline("route_signals"))
    best = signals.groupBy("query_id", "paper_id", "route").agg((F.min("rank") + 1).alias("place"))
    fused = R.rrf(best, ["query_id"], "paper_id", "place")
    return R.top(fused, 10, ["query_id"], [F.desc("score"), F.col("paper_id")]).select("query_id", "paper_id", "rank", F.round("score", 6).alias("score"))


QUERIES = {f.__name__: f for f in (postings_tf, doc_length, term_idf, bm25_topk, bm25_within_paper, bm25_candidate_set, dense_topk, seed_centroid_knn, rrf_fusion)}

_DOCS = f"d AS (SELECT doc_id, {sql.terms('text')} AS t FROM documents)"
_POST = f"{_DOCS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL)"
_COSINE = "round(list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 9)"
SQL = {
    "postings_tf": f"WITH {_POST} SELECT doc_id, term, tf FROM p",
    "doc_length": f"WITH {_DOCS} SELECT doc_id, len(t) AS dl FROM d",
    "term_idf": f"""WITH {_POST}, size AS (SELECT count(*) AS n FROM documents), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
        SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM f, size""",
    "bm25_topk": f"""WITH {sql.bm25('SELECT item_id AS query, item_text AS text FROM eval_items', 'SELECT doc_id AS doc, text FROM documents')},
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored)
        SELECT query AS item_id, doc AS doc_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "bm25_within_paper": f"""WITH {sql.bm25('SELECT DISTINCT c.paper_id, c.query_id AS query, q.question AS text FROM candidates c JOIN questions q USING (query_id) WHERE c.paper_id IS NOT NULL', 'SELECT paper_id, row_id AS doc, caption AS text FROM objects WHERE paper_id IS NOT NULL', 'paper_id')},
        r AS (SELECT *, row_number() OVER (PARTITION BY paper_id, query ORDER BY score DESC, doc) AS rank FROM scored)
        SELECT query AS query_id, paper_id, doc AS row_id, rank, round(score, 6) AS score FROM r WHERE rank <= 3""",
    "bm25_candidate_set": f"""WITH s AS (SELECT query_id, row_id, unnest(support) AS s, generate_subscripts(support, 1) - 1 AS i FROM candidates),
        {sql.bm25('SELECT query_id, query_id AS query, question AS text FROM questions', "SELECT query_id, row_id || ':' || i AS doc, s.text AS text FROM s", 'query_id')},
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored)
        SELECT query_id, doc AS support_key, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "dense_topk": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COSINE.format(a='a.e', b='b.e')} AS score FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "seed_centroid_knn": f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
        m AS (SELECT label, i, avg(e[i]) AS x FROM v, range(1, 65) t(i) WHERE vec_id % 100 = 0 GROUP BY label, i),
        c AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY label),
        s AS (SELECT c.label, v.vec_id, {_COSINE.format(a='c.e', b='v.e')} AS score FROM c, v WHERE v.vec_id % 100 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT label, vec_id, rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "rrf_fusion": """WITH s AS (SELECT query_id, paper_id, unnest(route_signals) AS g FROM candidates WHERE paper_id IS NOT NULL),
        b AS (SELECT query_id, paper_id, g.route AS route, min(g.rank) + 1 AS place FROM s GROUP BY ALL),
        f AS (SELECT query_id, paper_id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS score FROM b GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM f)
        SELECT query_id, paper_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""",
}
