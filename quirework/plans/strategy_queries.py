"""Queries of the retrieval strategies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import entities as N
from ..operators import strategies as Y
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql
from .select_queries import VENUES
from .entity_queries import _ALIASES, _POOL, SQL as _ENTITY_SQL, paper_relations


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return load_pool(table(spark, folder, "papers"))


def _names(spark: SparkSession, folder: str) -> DataFrame:
    """Names to look for: the capitalised words and the pairs of words behind `study of` and `on` in questions."""
    q = table(spark, folder, "questions").where("question is not null")
    words = F.regexp_extract_all("question", F.lit(r"(?:^|[^\p{L}\p{N}])([A-Z][A-Za-z0-9]{3,})"), 1)
    pairs = F.regexp_extract_all("question", F.lit(r"(?:study of|papers on|with|for) ([a-z-]+ [a-z]+)"), 1)
    return q.select("query_id", F.explode(F.array_distinct(F.concat(words, pairs))).alias("name"))


def title_surfaces(spark: SparkSession, folder: str) -> DataFrame:
    return Y.title_surfaces(_names(spark, folder), _pool(spark, folder))


def name_strategy(spark: SparkSession, folder: str) -> DataFrame:
    pool, names = _pool(spark, folder), _names(spark, folder)
    aliases = N.title_aliases(pool)
    ranked = N.resolve_aliases(names.select("name").distinct(), "name", aliases, N.alias_scope(aliases, pool.agg(F.count("*").alias("n"))))
    met = names.join(ranked.select("name", "paper_id", F.col("rank").alias("alias_rank")), "name")
    return Y.name_strategy(Y.title_surfaces(names, pool), met)


def baseline_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Around all candidates of each question."""
    anchors = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return Y.baseline_strategy(anchors, paper_relations(spark, folder))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Each question for itself, and for each of the names it has, the others deleted."""
    q = table(spark, folder, "questions").where("question is not null").select("query_id", "question")
    named = q.withColumn("names", F.array_distinct(F.regexp_extract_all("question", F.lit(r"(?:^|[^\p{L}\p{N}])([A-Z][A-Za-z0-9]{3,})"), 1)))
    each = named.select("query_id", "question", "names", F.explode("names").alias("group_key"))
    text = Y.target_query(F.col("question"), F.col("group_key"), F.filter("names", lambda n: n != F.col("group_key")))
    return q.select("query_id", F.lit(None).cast("string").alias("group_key"), F.col("question").alias("text")).unionByName(each.select("query_id", "group_key", text.alias("text")))


def target_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder)


def _flat(found: DataFrame) -> DataFrame:
    return found.withColumn("hits", F.array_join(F.transform("hits", lambda h: h.cast("string")), ","))


def property_strategy(spark: SparkSession, folder: str) -> DataFrame:
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "paper_id", "text")
    return _flat(Y.text_strategy(_asked(spark, folder), texts))


def caption_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Captions for each question and each of its names; only tables count where a question speaks of a table."""
    texts = table(spark, folder, "objects").select(F.col("row_id").alias("text_id"), "paper_id", F.col("caption").alias("text"), "source_type")
    return _flat(Y.text_strategy(_asked(spark, folder), texts, kind=F.col("source_type") == "table", kind_for=F.lower("text").contains("table")))


def object_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """As its SQL has it: tables' captions, for questions that speak of a table, without names. `caption_strategy` has all."""
    texts = table(spark, folder, "objects").select(F.col("row_id").alias("text_id"), "paper_id", F.col("caption").alias("text"), "source_type")
    return _flat(Y.text_strategy(_asked(spark, folder).where("group_key is null and lower(text) like '%table%'"), texts, kind=F.col("source_type") == "table"))


def citation_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that mention a name of the question, the name's own papers left out."""
    names = _names(spark, folder)
    own = Y.title_surfaces(names, _pool(spark, folder)).select("query_id", "paper_id")
    asked = names.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("text")).withColumn("group_key", F.lit(None).cast("string"))
    texts = table(spark, folder, "documents").select(F.col("doc_id").alias("text_id"), "paper_id", "text")
    return _flat(Y.text_strategy(asked, texts, without=own))


def sole_owners(spark: SparkSession, folder: str) -> DataFrame:
    return Y.sole_owners(_names(spark, folder).select("name"), _pool(spark, folder))


def paper_count(spark: SparkSession, folder: str) -> DataFrame:
    """Counts in questions to which phrases of several kinds are put."""
    d = F.substr("query_id", F.lit(-1)).cast("int")
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("Which two papers agree? ", "Name THREE recent papers. ", "Both of these papers differ. ", "In four of the papers, ", "Two values in the paper differ. ", "Give two papers and three papers. ", "5 papers ", "Name two Ormil 2025 works. ", "Two-stage papers ", "Both the first paper and the other paper differ. ")]), d + 1)
    return table(spark, folder, "questions").select("query_id", Y.paper_count(F.concat(phrase, F.regexp_replace(F.coalesce("question", F.lit("")), "-[0-9]", "")), VENUES).alias("n"))


QUERIES = {f.__name__: f for f in (title_surfaces, name_strategy, baseline_strategy, target_queries, property_strategy, object_strategy, caption_strategy, citation_strategy, sole_owners, paper_count)}

_NAMES = r"""names AS (SELECT DISTINCT query_id, unnest(list_concat(regexp_extract_all(question, '(?:^|[^\p{L}\p{N}])([A-Z][A-Za-z0-9]{3,})', 1), regexp_extract_all(question, '(?:study of|papers on|with|for) ([a-z-]+ [a-z]+)', 1))) AS name FROM questions WHERE question IS NOT NULL)"""
_SURFACES = f"""{_POOL}, {_NAMES}, sf AS (SELECT DISTINCT query_id, name, paper_id, {sql.sequence_text('title')} AS t, {sql.sequence_text('name')} AS s FROM names JOIN titles ON title IS NOT NULL AND contains({sql.sequence_text('title')}, {sql.sequence_text('name')})),
    surfaces AS (SELECT query_id, name, paper_id, CASE WHEN t = s THEN 'exact' WHEN starts_with(t, s) THEN 'leading' ELSE 'interior' END AS kind, count(*) OVER (PARTITION BY query_id, name) AS n FROM sf)"""
_ASKED = r"""named AS (SELECT query_id, question, list_distinct(regexp_extract_all(question, '(?:^|[^\p{L}\p{N}])([A-Z][A-Za-z0-9]{3,})', 1)) AS names FROM questions WHERE question IS NOT NULL),
    each AS (SELECT query_id, question, names, unnest(names) AS k FROM named),
    rest AS (SELECT query_id, k, list_reduce(list_prepend(question, list_sort(list_filter(names, lambda n: n <> k))), lambda q, o: regexp_replace(q, '(?i)(^|[^A-Za-z0-9])' || o || '($|[^A-Za-z0-9])', '\1\2', 'g')) AS q FROM each),
    asked AS (SELECT query_id, NULL AS group_key, question AS text FROM questions WHERE question IS NOT NULL UNION ALL SELECT query_id, k, trim(regexp_replace(k || ' ' || q, '\s+', ' ', 'g')) FROM rest)"""
_GROUPED = """r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored),
    h AS (SELECT query, r.doc, rank, paper_id FROM r JOIN own ON own.doc = r.doc WHERE rank <= 60 AND paper_id IS NOT NULL {where}),
    g AS (SELECT query, paper_id, min(rank) AS first, array_to_string(list(doc ORDER BY rank)[1:3], ',') AS hits FROM h GROUP BY ALL)
    SELECT string_split(query, chr(1))[1] AS query_id, nullif(string_split(query, chr(1))[2], '') AS group_key, paper_id, row_number() OVER (PARTITION BY query ORDER BY first) - 1 AS rank, hits FROM g"""
_Q = "SELECT query_id || chr(1) || coalesce(group_key, '') AS query, text FROM {0}"
_RELATIONS = _ENTITY_SQL["paper_relations"].removeprefix("WITH ").removesuffix(" SELECT * FROM edges")
SQL = {
    "title_surfaces": f"WITH {_SURFACES} SELECT * FROM surfaces",
    "name_strategy": f"""WITH {_SURFACES}, {_ALIASES}, met AS (SELECT DISTINCT n.name, a.paper_id, scope, df FROM (SELECT DISTINCT name FROM names) n JOIN aliases a ON a.alias_key = {sql.alias_key('n.name')} JOIN scopes s ON s.alias_key = a.alias_key),
        ar AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scope = 'generic', df, paper_id) AS rank FROM met),
        u AS (SELECT query_id, name, paper_id, CASE WHEN kind IN ('exact', 'leading') THEN 0 ELSE 2 END AS tier, CASE WHEN kind = 'exact' THEN 0 ELSE 1 END AS at_, 'title_' || kind AS how FROM surfaces UNION ALL SELECT names.query_id, names.name, ar.paper_id, 1, rank, 'alias' FROM names JOIN ar USING (name)),
        b AS (SELECT query_id, name, paper_id, min({{a: tier, b: at_, c: how}}) AS b FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, name ORDER BY b.a, b.b, paper_id) AS rank FROM b)
        SELECT query_id, name, paper_id, b.c AS how, rank FROM r WHERE rank <= 20""",
    "baseline_strategy": f"""WITH {_RELATIONS}, an AS (SELECT DISTINCT query_id, paper_id FROM candidates WHERE paper_id IS NOT NULL),
        u AS (SELECT query_id, target_paper_id AS p, 0 AS d, relation_id FROM an JOIN edges ON source_paper_id = paper_id WHERE target_paper_id IS NOT NULL UNION ALL SELECT query_id, source_paper_id, 1, relation_id FROM an JOIN edges ON target_paper_id = paper_id),
        b AS (SELECT query_id, p, min({{d: d, r: relation_id}}) AS b FROM u GROUP BY ALL)
        SELECT query_id, p AS paper_id, CASE WHEN b.d = 0 THEN 'forward' ELSE 'reverse' END AS direction, row_number() OVER (PARTITION BY query_id ORDER BY b.d, b.r, p) - 1 AS rank FROM b""",
    "target_queries": f"WITH {_ASKED} SELECT query_id, group_key, text FROM asked",
    "property_strategy": f"WITH {_ASKED}, {sql.bm25(_Q.format('asked'), 'SELECT doc_id AS doc, text FROM documents')}, own AS (SELECT doc_id AS doc, paper_id FROM documents), {_GROUPED.format(where='')}",
    "object_strategy": f"WITH {_ASKED}, {sql.bm25(_Q.format('asked') + ' WHERE group_key IS NULL AND contains(lower(text), chr(116) || chr(97) || chr(98) || chr(108) || chr(101))', 'SELECT row_id AS doc, caption AS text FROM objects')}, own AS (SELECT row_id AS doc, paper_id, source_type FROM objects), {_GROUPED.format(where=chr(65) + 'ND source_type = ' + chr(39) + 'table' + chr(39))}",
    "citation_strategy": f"WITH {_SURFACES}, asked AS (SELECT query_id, NULL AS group_key, string_agg(name, ' ' ORDER BY name) AS text FROM names GROUP BY query_id), {sql.bm25(_Q.format('asked'), 'SELECT doc_id AS doc, text FROM documents')}, own AS (SELECT doc_id AS doc, paper_id FROM documents), {_GROUPED.format(where='AND NOT EXISTS (SELECT 1 FROM surfaces x WHERE x.query_id = string_split(query, chr(1))[1] AND x.paper_id = own.paper_id)')}",
    "sole_owners": f"WITH {_POOL}, {_NAMES}, m AS (SELECT DISTINCT name, paper_id FROM (SELECT DISTINCT name FROM names) JOIN titles ON contains({sql.sequence_text(chr(99) + 'oncat_ws(' + chr(39) + ' ' + chr(39) + ', title, abstract)')}, {sql.sequence_text('name')})) SELECT name, min(paper_id) AS paper_id FROM m GROUP BY name HAVING count(*) = 1",
    "paper_count": "SELECT query_id, [2, 3, 2, 4, NULL, NULL, 5, 2, NULL, 2][right(query_id, 1)::INT + 1] AS n FROM questions",
}
