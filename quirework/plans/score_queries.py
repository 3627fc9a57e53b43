"""Queries that score and check results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import score as C
from ..operators.evidence import SOURCE_TYPES
from ..sources.tables import table
from .answer_queries import mc_value_match
from .evidence_queries import evidence_rank_cap
from .rank_queries import rrf_fusion


def _gold(spark: SparkSession, folder: str) -> DataFrame:
    """Papers that a relation of the question's candidates speaks for."""
    return table(spark, folder, "candidates").where("paper_id is not null and relation_support is not null").select("query_id", "paper_id")


def score_papers(spark: SparkSession, folder: str) -> DataFrame:
    return C.set_scores(_gold(spark, folder), rrf_fusion(spark, folder), "query_id", "paper_id")


def score_papers_macro(spark: SparkSession, folder: str) -> DataFrame:
    return C.macro(score_papers(spark, folder))


def score_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The capped evidence against all evidence of kind table and figure, by coarse keys."""
    said = evidence_rank_cap(spark, folder)
    gold = said.where("key like '%|table|%' or key like '%|figure|%'")
    return C.set_scores(gold, said.where("slot <= 3"), "query_id", "key")


def score_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as tables; of the predictions some rows are missing, some values off by little or much."""
    line = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("price"), F.max("l_linestatus").alias("status"))
    cells = F.explode(F.array(F.struct(F.lit("price").alias("column"), F.col("price").cast("string").alias("value")), F.struct(F.lit("status").alias("column"), F.col("status").alias("value")))).alias("c")
    gold = line.select("l_orderkey", F.concat(F.lit("Line "), "l_linenumber").alias("row"), cells).select("l_orderkey", "row", "c.*")
    off = line.withColumn("price", F.when(F.col("l_linenumber") % 3 == 0, F.col("price") * 1.01).when(F.col("l_linenumber") % 3 == 1, F.col("price") * (1 + 1e-12)).otherwise(F.col("price"))).where("l_linenumber % 5 <> 4").withColumn("status", F.lower("status"))
    said = off.select("l_orderkey", F.concat(F.lit(" line  "), "l_linenumber").alias("row"), cells).select("l_orderkey", "row", "c.*")
    return C.table_scores(gold, said, "l_orderkey", "row", "value")


def score_choices(spark: SparkSession, folder: str) -> DataFrame:
    gold = table(spark, folder, "questions").where("mc_options is not null").select("query_id", F.lit("C").alias("label"))
    return C.choice_accuracy(gold, mc_value_match(spark, folder).where("confidence > 0.1"))


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Submission lines of which some break each rule."""
    d = F.substr("query_id", F.lit(-2)).cast("int")
    q = table(spark, folder, "questions").select("query_id", d.alias("d"), "mc_options")
    papers = F.when(F.col("d") % 7 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    item = lambda kind, page: F.struct(F.lit("a").alias("paper_id"), kind.alias("source_type"), page.cast("int").alias("page"))
    evidence = F.array(item(F.when(F.col("d") % 11 == 0, "video").otherwise("table"), F.col("d") % 5), item(F.lit("text_span"), F.lit(2)))
    lines = q.where("d % 13 <> 0").select(F.when(F.col("d") % 17 == 0, F.concat("query_id", F.lit("x"))).otherwise(F.col("query_id")).alias("query_id"), papers.alias("gold_papers"), evidence.alias("evidence"), F.when(F.col("d") % 3 == 0, "Q").otherwise("A").alias("choice"), "d")
    return lines.unionByName(lines.where("d % 19 = 0")).drop("d")


def submission_violations(spark: SparkSession, folder: str) -> DataFrame:
    return C.violations(_lines(spark, folder), table(spark, folder, "questions"), SOURCE_TYPES)


def normalize_answer(spark: SparkSession, folder: str) -> DataFrame:
    d = F.substr("query_id", F.lit(-1)).cast("int")
    answers = table(spark, folder, "questions").where(d < 8).select("query_id", F.when(d % 2 == 0, " ").otherwise("an answer").alias("text"), F.when(d % 3 == 0, " d ").when(d % 3 == 1, "z").alias("choice"))
    out = C.repaired(answers, table(spark, folder, "questions"))
    return out.withColumn("fell_back", F.array_join("fell_back", ","))


QUERIES = {f.__name__: f for f in (score_papers, score_papers_macro, score_evidence, score_tables, score_choices, submission_violations, normalize_answer)}


def _oracle() -> dict[str, str]:
    from .answer_queries import SQL as answers
    from .evidence_queries import SQL as evidence
    from .rank_queries import SQL as ranks

    scores = """g AS (SELECT DISTINCT {by}, {key} FROM gold), p AS (SELECT DISTINCT {by}, {key} FROM said),
        n AS (SELECT {by}, count(*) AS gold FROM g GROUP BY ALL), m AS (SELECT {by}, count(*) AS said FROM p GROUP BY ALL), h AS (SELECT {by}, count(*) AS hits FROM g JOIN p USING ({by}, {key}) GROUP BY ALL),
        scores AS (SELECT {by}, round(CASE WHEN coalesce(said, 0) > 0 THEN coalesce(hits, 0) / said ELSE 0 END, 9) AS precision, round(coalesce(hits, 0) / gold, 9) AS recall,
            round(CASE WHEN coalesce(hits, 0) > 0 THEN 2 * hits / (gold + said) ELSE 0 END, 9) AS f1 FROM n LEFT JOIN m USING ({by}) LEFT JOIN h USING ({by}))"""
    papers = f"WITH gold AS (SELECT query_id, paper_id FROM candidates WHERE paper_id IS NOT NULL AND relation_support IS NOT NULL), said AS ({ranks['rrf_fusion']}), {scores.format(by='query_id', key='paper_id')}"
    return {
        "score_papers": f"{papers} SELECT * FROM scores",
        "score_papers_macro": f"{papers} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, count(*) AS n FROM scores",
        "score_evidence": f"WITH every AS ({evidence['evidence_rank_cap']}), gold AS (SELECT * FROM every WHERE key LIKE '%|table|%' OR key LIKE '%|figure|%'), said AS (SELECT * FROM every WHERE slot <= 3), {scores.format(by='query_id', key='key')} SELECT * FROM scores",
        "score_tables": f"""WITH l AS (SELECT l_orderkey, l_linenumber, max(l_extendedprice) AS price, max(l_linestatus) AS status FROM lineitem GROUP BY ALL),
            gold AS (SELECT l_orderkey, l_linenumber AS k FROM l), said AS (SELECT l_orderkey, l_linenumber AS k FROM l WHERE l_linenumber % 5 <> 4), {scores.format(by='l_orderkey', key='k')},
            c AS (SELECT l_orderkey, count(*) * 2 AS n_cells, sum(CASE WHEN l_linenumber % 5 = 4 THEN 0 WHEN l_linenumber % 3 = 0 THEN 1 ELSE 2 END) AS hit FROM l GROUP BY ALL)
            SELECT l_orderkey, f1 AS row_f1, round(hit / n_cells, 9) AS cell_accuracy, n_cells FROM scores JOIN c USING (l_orderkey)""",
        "score_choices": f"WITH p AS (SELECT * FROM ({answers['mc_value_match']}) WHERE confidence > 0.1), g AS (SELECT query_id FROM questions WHERE mc_options IS NOT NULL) SELECT round(avg(CASE WHEN p.label = 'C' THEN 1 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM g LEFT JOIN p USING (query_id)",
        "submission_violations": """WITH q AS (SELECT query_id, right(query_id, 2)::INT AS d, mc_options FROM questions), l AS (SELECT CASE WHEN d % 17 = 0 THEN query_id || 'x' ELSE query_id END AS query_id, d, CASE WHEN d % 17 = 0 THEN NULL ELSE mc_options END AS o FROM q WHERE d % 13 <> 0),
            lines AS (SELECT * FROM l UNION ALL SELECT * FROM l WHERE d % 19 = 0), c AS (SELECT query_id, count(*) AS n FROM lines GROUP BY ALL),
            v AS (SELECT query_id, 'missing_question' AS rule, 1 AS n FROM q WHERE query_id NOT IN (SELECT query_id FROM c)
                UNION ALL SELECT query_id, 'duplicate_question', n - 1 FROM c WHERE n > 1
                UNION ALL SELECT query_id, 'unknown_question', n FROM c WHERE query_id NOT IN (SELECT query_id FROM q)
                UNION ALL SELECT query_id, 'repeated_paper', 1 FROM lines WHERE d % 7 = 0
                UNION ALL SELECT query_id, 'unknown_source_type', 1 FROM lines WHERE d % 11 = 0
                UNION ALL SELECT query_id, 'page_below_one', 1 FROM lines WHERE d % 5 = 0
                UNION ALL SELECT query_id, 'choice_is_no_label', 1 FROM lines WHERE o IS NOT NULL AND NOT list_contains(map_keys(o), CASE WHEN d % 3 = 0 THEN 'Q' ELSE 'A' END))
            SELECT query_id, rule, sum(n)::BIGINT AS n FROM v GROUP BY ALL""",
        "normalize_answer": """WITH q AS (SELECT *, right(query_id, 1)::INT AS d FROM questions), a AS (SELECT query_id, answer_types, list_sort(map_keys(mc_options)) AS labels, CASE WHEN d >= 8 THEN NULL WHEN d % 2 = 0 THEN ' ' ELSE 'an answer' END AS text, CASE WHEN d >= 8 THEN NULL WHEN d % 3 = 0 THEN 'D' WHEN d % 3 = 1 THEN 'Z' END AS choice FROM q),
            w AS (SELECT *, coalesce(list_contains(answer_types, 'freeform'), FALSE) AS f, coalesce(list_contains(answer_types, 'multiple_choice'), FALSE) AS m, coalesce(trim(text) <> '', FALSE) AS t_ok, coalesce(list_contains(labels, choice), FALSE) AS c_ok FROM a)
            SELECT query_id, CASE WHEN f THEN CASE WHEN t_ok THEN text ELSE 'unknown' END END AS text, CASE WHEN m THEN CASE WHEN c_ok THEN choice ELSE coalesce(labels[1], 'A') END END AS choice,
                   concat_ws(',', CASE WHEN f AND NOT t_ok THEN 'freeform' END, CASE WHEN m AND NOT c_ok THEN 'multiple_choice' END) AS fell_back FROM w""",
    }


SQL = _oracle()
