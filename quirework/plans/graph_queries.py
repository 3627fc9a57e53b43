"""Queries on cohorts of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import cut
from ..functions.text import identity_text
from ..operators import graph as G
from ..operators.select import merge_routes
from ..sources.tables import table


def _selected(spark: SparkSession, folder: str) -> DataFrame:
    """All papers of each question that a relation speaks for."""
    return merge_routes(table(spark, folder, "candidates")).where("relation is not null").select("query_id", "paper_id", "position")


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    """The first paper of each question that a relation speaks for, and its next one."""
    return _selected(spark, folder).withColumn("n", F.row_number().over(G.Window.partitionBy("query_id").orderBy("position"))).where("n <= 2").select("query_id", "paper_id", "position")


def _methods(spark: SparkSession, folder: str) -> DataFrame:
    """Names of mixed case in the questions."""
    words = F.filter(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit("[A-Za-z][A-Za-z0-9]+"), 0), lambda w: w.rlike("[a-z]") & w.rlike("^.+[A-Z]"))
    return table(spark, folder, "questions").select("query_id", F.explode(words).alias("w")).select("query_id", identity_text("w").alias("method")).distinct()


def _anchors(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that ask for a table and have two papers."""
    asks = table(spark, folder, "questions").where("array_contains(answer_types, 'table')").select("query_id")
    return _papers(spark, folder).groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 2").join(asks, "query_id", "left_semi").select("query_id")


def _members(spark: SparkSession, folder: str) -> DataFrame:
    # As their SQL has it: two papers of each question, equal names. `cohort_members` has all.
    return _joined(G.cohort_edges(_papers(spark, folder), _methods(spark, folder), _anchors(spark, folder), contained=False))


def _joined(edges: DataFrame) -> DataFrame:
    edges = cut(edges)
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return G.components(nodes, edges)


def cohort_components(spark: SparkSession, folder: str) -> DataFrame:
    return _members(spark, folder)


def cohort_members(spark: SparkSession, folder: str) -> DataFrame:
    """Components over all selected papers of each question, and over names that are equal or contain one another."""
    return _joined(G.cohort_edges(_selected(spark, folder), _methods(spark, folder), _anchors(spark, folder)))


def cohort_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return G.cohort_consensus(_members(spark, folder), _papers(spark, folder), 2, 2, 5)


def paper_components(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that share a part, as components."""
    line = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey").distinct()
    least = line.groupBy("l_partkey").agg(F.min("l_orderkey").alias("b"))
    edges = line.join(least, "l_partkey").select(F.col("l_orderkey").alias("a"), "b")
    return G.components(line.select(F.col("l_orderkey").alias("node")).distinct(), edges)


QUERIES = {f.__name__: f for f in (cohort_components, cohort_members, cohort_consensus, paper_components)}

_MERGED = """c AS (SELECT * FROM candidates WHERE paper_id IS NOT NULL), b AS (SELECT query_id, paper_id, min(row_id) AS first, count(relation_support) AS rel FROM c GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS position FROM b),
    p AS (SELECT query_id, paper_id, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY position) AS n FROM m WHERE rel > 0) WHERE n <= 2)"""
_COMPONENTS = f"""{_MERGED}, w AS (SELECT DISTINCT query_id, regexp_replace(lower(w), '[^a-z0-9]', '', 'g') AS method FROM (SELECT query_id, unnest(regexp_extract_all(coalesce(question, ''), '[A-Za-z][A-Za-z0-9]+')) AS w FROM questions) WHERE regexp_matches(w, '[a-z]') AND regexp_matches(w, '^.+[A-Z]')),
    a AS (SELECT query_id FROM p JOIN questions USING (query_id) WHERE list_contains(answer_types, 'table') GROUP BY query_id HAVING count(*) >= 2),
    k AS (SELECT query_id, 'p:' || paper_id AS key FROM p UNION SELECT query_id, 'm:' || method FROM w WHERE length(method) >= 3),
    e AS (SELECT DISTINCT x.query_id AS u, y.query_id AS v FROM k x JOIN k y USING (key) WHERE x.query_id <> y.query_id AND (x.query_id IN (SELECT * FROM a) OR y.query_id IN (SELECT * FROM a))),
    reach AS (SELECT u AS node, u AS r FROM e UNION SELECT e.v, reach.r FROM reach JOIN e ON e.u = reach.node),
    members AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"""
SQL = {
    "cohort_components": f"WITH RECURSIVE {_COMPONENTS} SELECT node, component FROM members",
    "cohort_consensus": f"""WITH RECURSIVE {_COMPONENTS}, j AS (SELECT * FROM p JOIN members ON query_id = node), s AS (SELECT component FROM members GROUP BY component HAVING count(*) >= 2),
        v AS (SELECT component, paper_id, count(*) AS votes, min(position) AS best, min({{q: query_id, p: position}}) AS seen FROM j JOIN s USING (component) GROUP BY ALL HAVING count(*) >= 2),
        z AS (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM v)
        SELECT component, paper_id, votes, row_number() OVER (PARTITION BY component ORDER BY votes DESC, best, seen, paper_id) AS rank FROM z WHERE n BETWEEN 2 AND 5""",
}
