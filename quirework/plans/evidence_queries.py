"""Queries on evidence: validation, grounding, ranking and shaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import evidence as V
from ..sources.tables import table
from . import sql


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    """The support of all candidates as located evidence, with a confidence made of its place."""
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", F.posexplode("support").alias("i", "s"))
    return rows.select("query_id", "paper_id", F.concat_ws(":", "row_id", "i").alias("evidence_id"), (F.col("row_id") * 100 + F.col("i")).alias("seq"), "s.page", "s.source_type", "s.object_id", F.col("s.text").alias("quote"), ((F.col("row_id") % 4) / 4).cast("string").alias("confidence"))


def _proposals(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes of the begins of documents, on the right page and on the next, and labels of objects, right and of the wrong kind."""
    docs = table(spark, folder, "documents").where("paper_id is not null and page is not null")
    quote = F.left("text", F.lit(90))
    texts = docs.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1)))).select(F.concat(F.lit("t"), (F.col("doc_id") * 2 + F.col("k")).cast("string")).alias("proposal"), "paper_id", (F.col("page") + F.col("k")).cast("int").alias("page"), F.lit("text_span").alias("source_type"), F.lit(None).cast("string").alias("object_id"), quote.alias("quote"))
    objects = table(spark, folder, "objects").where("paper_id is not null and page is not null").select(F.concat(F.lit("o"), F.col("row_id").cast("string")).alias("proposal"), "paper_id", "page", F.when(F.col("row_id") % 5 == 0, "video").otherwise(F.col("source_type")).alias("source_type"), F.col("parser_visible_id").alias("object_id"))
    met = objects.join(docs.groupBy("paper_id", "page").agg(F.min(F.left("text", F.lit(60))).alias("quote")), ["paper_id", "page"])
    return texts.unionByName(met)


def evidence_validate(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").select("paper_id", "page", "text")
    objects = table(spark, folder, "objects").select("paper_id", "page", F.col("scorer_visible_id").alias("visible_id"))
    return V.validate(_proposals(spark, folder), pages, objects).select("proposal", "page_exists", "known_type", "object_on_page", "quoted", "valid")


def object_labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "objects").select("row_id", V.object_label(F.col("parser_visible_id"), F.col("source_type")).alias("label"))


def value_grounding(spark: SparkSession, folder: str) -> DataFrame:
    """Which numbers up to 20 stand by themselves in each support text."""
    rows = _evidence(spark, folder).select("evidence_id", "quote", F.explode(F.sequence(F.lit(1), F.lit(20))).alias("number"))
    return rows.where(V.value_in(F.col("quote"), F.col("number").cast("string"))).select("evidence_id", "number")


def _ranked(spark: SparkSession, folder: str) -> DataFrame:
    return V.rank_evidence(_evidence(spark, folder), table(spark, folder, "questions").select("query_id", "question"))


def evidence_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return _ranked(spark, folder).select("query_id", "evidence_id", "confidence", F.round("bm25", 6).alias("bm25"), "place")


def evidence_rank_cap(spark: SparkSession, folder: str) -> DataFrame:
    return V.emit(_ranked(spark, folder)).select("query_id", "evidence_id", "key", "slot")


def evidence_rebalance(spark: SparkSession, folder: str) -> DataFrame:
    """As above; questions that name a table get each paper's best table first."""
    asked = table(spark, folder, "questions").select("query_id", F.coalesce(F.lower("question").contains("table") | F.array_contains("answer_types", "table"), F.lit(False)).alias("asks"))
    return V.emit(_ranked(spark, folder).join(asked, "query_id", "left"), 5, F.col("asks")).select("query_id", "evidence_id", "slot")


def quote_block_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Captions, whole, cut, and of the wrong kind, looked for among the captions of their paper."""
    objects = table(spark, folder, "objects").where("paper_id is not null and caption is not null")
    blocks = objects.select("paper_id", F.col("row_id").cast("string").alias("block_id"), "source_type", F.col("caption").alias("text"))
    kind = F.when(F.col("row_id") % 7 == 0, "equation_algorithm").when(F.col("row_id") % 3 == 0, F.col("source_type"))
    quote = F.when(F.col("row_id") % 2 == 0, F.expr("substring(caption, 3, greatest(4, length(caption) - 6))")).otherwise(F.upper("caption"))
    targets = objects.select(F.concat(F.lit("t"), F.col("row_id").cast("string")).alias("target_id"), "paper_id", quote.alias("quote"), kind.alias("source_type"))
    return V.resolve_quotes(targets, blocks)


QUERIES = {f.__name__: f for f in (evidence_validate, object_labels, value_grounding, evidence_ranking, evidence_rank_cap, evidence_rebalance, quote_block_resolution)}

_MATCH = r"lower(trim(regexp_replace(replace(regexp_replace(coalesce({0}, ''), '-\s*\n\s*', '', 'g'), chr(173), ''), '\s+', ' ', 'g'), ' '))"
_LABEL = r"""CASE WHEN regexp_matches(trim({id}, ' '), '(?i)^[(\[]?\s*(\d+[a-z]?)\s*[)\]]?$') THEN '{label} ' || regexp_extract(trim({id}, ' '), '(?i)^[(\[]?\s*(\d+[a-z]?)\s*[)\]]?$', 1)
    WHEN regexp_matches(trim({id}, ' '), '(?i)^(?:{short})\s*[(\[]?\s*(\d+[a-z]?)(?:[^.\w]|$)') THEN '{label} ' || regexp_extract(trim({id}, ' '), '(?i)^(?:{short})\s*[(\[]?\s*(\d+[a-z]?)(?:[^.\w]|$)', 1) ELSE trim({id}, ' ') END"""


def _label(id_: str) -> str:
    return "CASE " + " ".join(f"WHEN source_type = '{k}' THEN {_LABEL.format(id=id_, label=label, short={"table": r"table|tab\.?", "figure": r"figure|fig\.?", "equation_algorithm": r"equation|eq\.?", "citation_context": r"citation|cit\.?|reference|ref\.?"}[k])}" for k, label in V.LABELS.items()) + " END"


_EVIDENCE = """c AS (SELECT query_id, paper_id, row_id, unnest(support) AS s, generate_subscripts(support, 1) - 1 AS i FROM candidates WHERE paper_id IS NOT NULL),
    ev AS (SELECT query_id, paper_id, row_id || ':' || i AS evidence_id, row_id * 100 + i AS seq, s.page AS page, s.source_type AS source_type, s.object_id AS object_id, s.text AS quote, (row_id % 4)::DOUBLE / 4 AS confidence FROM c)"""
_RANKED = f"""{_EVIDENCE}, {sql.bm25('SELECT query_id, query_id AS query, question AS text FROM questions', "SELECT query_id, evidence_id AS doc, concat_ws(' ', quote, object_id, source_type) AS text FROM ev", 'query_id')},
    ranked AS (SELECT ev.*, coalesce(score, 0) AS bm25, row_number() OVER (PARTITION BY ev.query_id ORDER BY confidence DESC, coalesce(score, 0) DESC, seq) AS place FROM ev LEFT JOIN scored s ON s.query_id = ev.query_id AND s.doc = ev.evidence_id)"""
_FLAT = r"trim(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'), ' '), '^[\"'']+|[\"'']+$', '', 'g'), ' ')"
_EMIT = f"""{_RANKED}, shaped AS (SELECT *, concat_ws('|', paper_id, source_type, page, {_FLAT.format(_label('object_id'))}) AS key FROM ranked WHERE page >= 1 AND source_type IN ({', '.join(f"'{x}'" for x in V.SOURCE_TYPES)})),
    one AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY place) AS n FROM shaped) WHERE n = 1)"""
_TOKENS = r"regexp_extract_all({0}, '[a-z]{{3,}}|\d[\d.]*')"
SQL = {
    "object_labels": f"SELECT row_id, {_label('parser_visible_id')} AS label FROM objects",
    "value_grounding": rf"WITH {_EVIDENCE}, n AS (SELECT DISTINCT evidence_id, unnest(regexp_extract_all({_MATCH.format('quote')}, '[\pL\pN\p{{M}}_]+')) AS word FROM ev) SELECT evidence_id, number::INT AS number FROM n JOIN range(1, 21) r(number) ON word = number::VARCHAR",
    "evidence_ranking": f"WITH {_RANKED} SELECT query_id, evidence_id, confidence, round(bm25, 6) AS bm25, place FROM ranked",
    "evidence_rank_cap": f"WITH {_EMIT} SELECT query_id, evidence_id, key, slot FROM one WHERE slot <= 5",
    "evidence_rebalance": f"""WITH {_EMIT}, asked AS (SELECT query_id, coalesce(contains(lower(question), 'table'), FALSE) OR coalesce(list_contains(answer_types, 'table'), FALSE) AS asks FROM questions),
        k AS (SELECT one.*, coalesce(asks, FALSE) AS asks, count(DISTINCT CASE WHEN source_type = 'table' THEN paper_id END) OVER (PARTITION BY query_id) AS papers, count(DISTINCT CASE WHEN source_type = 'table' AND slot <= 5 THEN paper_id END) OVER (PARTITION BY query_id) AS inside,
              row_number() OVER (PARTITION BY query_id, paper_id, source_type ORDER BY slot) AS b FROM one LEFT JOIN asked USING (query_id)),
        m AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN asks AND papers >= 3 AND 2 * inside < papers AND source_type = 'table' AND b = 1 THEN 0 ELSE 1 END, slot) AS new FROM k)
        SELECT query_id, evidence_id, new AS slot FROM m WHERE new <= 5""",
    "evidence_validate": f"""WITH docs AS (SELECT * FROM documents WHERE paper_id IS NOT NULL AND page IS NOT NULL),
        p AS (SELECT 't' || (doc_id * 2 + k) AS proposal, paper_id, (page + k)::INT AS page, 'text_span' AS source_type, NULL AS object_id, left(text, 90) AS quote FROM docs, range(0, 2) r(k)
              UNION ALL SELECT 'o' || row_id, o.paper_id, o.page, CASE WHEN row_id % 5 = 0 THEN 'video' ELSE source_type END, parser_visible_id, q FROM objects o JOIN (SELECT paper_id, page, decode(min(encode(left(text, 60)))) AS q FROM docs GROUP BY ALL) d ON d.paper_id = o.paper_id AND d.page = o.page),
        t AS (SELECT paper_id, page, string_agg({_MATCH.format('text')}, ' ' ORDER BY {_MATCH.format('text')}) AS body FROM docs GROUP BY ALL),
        l AS (SELECT DISTINCT paper_id, page, lower(trim(scorer_visible_id)) AS label, TRUE AS there FROM objects WHERE paper_id IS NOT NULL AND page IS NOT NULL),
        m AS (SELECT p.*, body, coalesce(there, FALSE) AS there, {_MATCH.format('quote')} AS q FROM p LEFT JOIN t USING (paper_id, page) LEFT JOIN l ON l.paper_id = p.paper_id AND l.page = p.page AND l.label = lower({_label('p.object_id').replace('source_type', 'p.source_type')})),
        v AS (SELECT proposal, body IS NOT NULL AS page_exists, source_type IN ({', '.join(f"'{x}'" for x in V.SOURCE_TYPES)}) AS known_type, source_type NOT IN ('table', 'figure') OR there AS object_on_page,
              coalesce(q <> '' AND (contains(body, q) OR (len({_TOKENS.format('q')}) > 0 AND len(list_filter({_TOKENS.format('q')}, lambda x: list_contains({_TOKENS.format('body')}, x))) >= 0.75 * len({_TOKENS.format('q')}))), FALSE) AS quoted FROM m)
        SELECT *, page_exists AND known_type AND object_on_page AND quoted AS valid FROM v""",
    "quote_block_resolution": f"""WITH o AS (SELECT * FROM objects WHERE paper_id IS NOT NULL AND caption IS NOT NULL),
        t AS (SELECT 't' || row_id AS target_id, paper_id, {_MATCH.format("CASE WHEN row_id % 2 = 0 THEN substring(caption, 3, greatest(4, length(caption) - 6)) ELSE upper(caption) END")} AS q, CASE WHEN row_id % 7 = 0 THEN 'equation_algorithm' WHEN row_id % 3 = 0 THEN source_type END AS source_type FROM o),
        m AS (SELECT t.target_id, o.row_id::VARCHAR AS block_id, CASE WHEN {_MATCH.format('caption')} = q THEN 1 WHEN length(q) >= 4 AND contains({_MATCH.format('caption')}, q) THEN 2 END AS grade, t.source_type IS NULL OR t.source_type = o.source_type AS fits FROM t JOIN o USING (paper_id) WHERE q <> ''),
        b AS (SELECT *, min(grade) FILTER (fits) OVER (PARTITION BY target_id) AS best FROM m WHERE grade IS NOT NULL),
        f AS (SELECT target_id, count(*) FILTER (fits) AS fit, count(*) FILTER (fits AND grade = best) AS n, min(block_id) FILTER (fits AND grade = best) AS block_id FROM b GROUP BY ALL),
        s AS (SELECT target_id, CASE WHEN fit IS NULL THEN 'no_anchor' WHEN fit = 0 THEN 'wrong_source_type' WHEN n > 1 THEN 'ambiguous_anchor' ELSE 'resolved' END AS status, block_id FROM t LEFT JOIN f USING (target_id)),
        k AS (SELECT *, count(*) FILTER (status = 'resolved') OVER (PARTITION BY block_id) AS claims FROM s)
        SELECT target_id, CASE WHEN status = 'resolved' AND claims > 1 THEN 'ambiguous_anchor' ELSE status END AS status, CASE WHEN status = 'resolved' AND claims = 1 THEN block_id END AS block_id FROM k""",
}
