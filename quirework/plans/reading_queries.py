"""Queries that read documents for questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import reading as G
from ..sources.tables import table
from . import sql


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return pairs.join(table(spark, folder, "questions").where("question is not null").select("query_id", "question"), "query_id")


def page_shortlist(spark: SparkSession, folder: str) -> DataFrame:
    """Three pages a paper, five with those on which the papers' tables are, where the question speaks of a table."""
    asked = _asked(spark, folder)
    pages = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", "page", "text")
    tables = table(spark, folder, "objects").where("source_type = 'table' and paper_id is not null and page is not null").select("paper_id", "page").distinct()
    anchored = asked.where("lower(question) like '%table%'").select("query_id", "paper_id").join(tables, "paper_id")
    return G.shortlist(asked, pages, anchored, 3, 5)


def context_windows(spark: SparkSession, folder: str) -> DataFrame:
    """The surroundings of a number in each document, or else of the word `table`."""
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", G.context(F.col("text"), [(F.col("doc_id") % 90 + 10).cast("string"), F.lit("TABLE")], 60, 100).alias("context"))


def paper_preview(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", "doc_id", "text")
    return G.preview(docs, "paper_id", "doc_id", "text", 900)


def _references(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "bib_entries").where("text is not null")
    index = F.row_number().over(G.Window.partitionBy("citing_paper_id").orderBy("entry_id"))
    return rows.select(F.col("citing_paper_id").alias("doc"), index.alias("index"), F.col("text").alias("raw"), "entry_id")


def reference_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Four questions on each paper's reference list, and one that is none."""
    docs = table(spark, folder, "bib_entries").where("text is not null").select(F.col("citing_paper_id").alias("doc")).distinct()
    asked = F.array(*[F.lit(x) for x in ("What number has the last reference?", "How many references are there?", "Who is the first author of the second reference?", "How many references have Selmak as an author?", "How many papers does the references section cite?")])
    q = docs.select("doc", F.posexplode(asked).alias("k", "question")).select(F.concat_ws("/", "doc", "k").alias("question_id"), "doc", "question")
    return G.reference_answers(q, _references(spark, folder).drop("entry_id"))


def cited_entry(spark: SparkSession, folder: str) -> DataFrame:
    """The middles of entries, looked for among the entries of the same paper."""
    refs = _references(spark, folder)
    quotes = refs.select(F.col("entry_id").alias("quote_id"), "doc", F.expr("substring(raw, cast(length(raw) / 3 as int), 70)").alias("quote"))
    return G.cited_entry(quotes, refs.drop("entry_id"))


def grid_projection(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as grids; of those whose number is divisible by five, the first row lacks a cell."""
    line = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("long").alias("q"), F.max("l_partkey").alias("p"), F.max("l_returnflag").alias("f"))
    cells = F.array(F.col("p").cast("string"), F.col("f"), F.col("q").cast("string"))
    cells = F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1), F.slice(cells, 1, 2)).otherwise(cells)
    grids = line.groupBy(F.col("l_orderkey").alias("grid_id")).agg(F.lit(3).alias("width"), F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", cells.alias("c")))), lambda s: s["c"]).alias("rows"))
    columns = spark.createDataFrame([("quantity", 2), ("part", 0)], "name string, position int")
    return G.project_grid(grids, grids.select("grid_id").crossJoin(F.broadcast(columns)))  # two rows


def printed_values(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    raw = F.concat(F.lit("O(K²) "), F.col("p_size").cast("string"), F.lit("  +/- "), (F.col("p_size") % 7).cast("string"), F.lit(" 10⁻³"))
    return part.select("p_partkey", G.printed_value(raw).alias("value"))


def admitted_additions(spark: SparkSession, folder: str) -> DataFrame:
    """Part names of an order that are no other name of the name of its first line, two at most."""
    line = table(spark, folder, "lineitem").join(table(spark, folder, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("t"), "l_linenumber", F.col("p_name").alias("key"))
    current = line.where("l_linenumber = 1").select("t", F.upper("key").alias("key"))
    proposed = line.where("l_linenumber > 1").select("t", F.concat("key", F.lit(" x")).alias("key"), F.col("l_linenumber").alias("seq"))
    budget = line.select("t").distinct().withColumn("budget", F.lit(2))
    return G.admitted_additions(proposed, current, "t", "key", budget)


QUERIES = {f.__name__: f for f in (page_shortlist, context_windows, paper_preview, reference_answers, cited_entry, grid_projection, printed_values, admitted_additions)}

_REFS = "refs AS (SELECT citing_paper_id AS doc, row_number() OVER (PARTITION BY citing_paper_id ORDER BY entry_id) AS index, text AS raw, entry_id FROM bib_entries WHERE text IS NOT NULL)"
_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"
_AROUND = r"CASE WHEN instr(lower(text), lower({a})) > 0 THEN rtrim(left(trim(regexp_replace(substring(text, greatest(1, instr(lower(text), lower({a})) - 60), instr(lower(text), lower({a})) - greatest(1, instr(lower(text), lower({a})) - 60) + length({a}) + 60), '\s+', ' ', 'g'), ' '), 100), ' ')"
SQL = {
    "page_shortlist": f"""WITH pg AS (SELECT paper_id, page AS doc, string_agg(text, chr(10) ORDER BY text) AS text FROM documents WHERE paper_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL), cnt AS (SELECT paper_id, count(*) AS n_pages FROM pg GROUP BY ALL),
        asked AS (SELECT DISTINCT c.query_id, c.paper_id, question FROM candidates c JOIN questions USING (query_id) WHERE c.paper_id IS NOT NULL AND question IS NOT NULL),
        {sql.bm25('SELECT paper_id, query_id AS query, question AS text FROM asked', 'SELECT paper_id, doc, text FROM pg', 'paper_id')},
        anc AS (SELECT DISTINCT a.query_id, a.paper_id, o.page FROM asked a JOIN objects o ON o.paper_id = a.paper_id WHERE contains(lower(question), 'table') AND o.source_type = 'table' AND o.page IS NOT NULL),
        r AS (SELECT a.query_id, a.paper_id, pg.doc AS page, n_pages, coalesce(s.score, 0) AS score, anc.page IS NOT NULL AS anchored FROM asked a JOIN pg ON pg.paper_id = a.paper_id JOIN cnt ON cnt.paper_id = a.paper_id LEFT JOIN scored s ON s.paper_id = a.paper_id AND s.query = a.query_id AND s.doc = pg.doc LEFT JOIN anc ON anc.query_id = a.query_id AND anc.paper_id = a.paper_id AND anc.page = pg.doc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY score DESC, page) AS place FROM r), k AS (SELECT * FROM placed WHERE n_pages <= 3 OR place <= 3 OR anchored),
        o AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY CASE WHEN anchored THEN 0 ELSE 1 END, score DESC, page) AS ord FROM k)
        SELECT query_id, paper_id, page FROM o WHERE n_pages <= 3 OR ord <= 5""",
    "context_windows": f"SELECT doc_id, {_AROUND.format(a='(doc_id % 90 + 10)::VARCHAR')} {_AROUND.format(a=chr(39) + 'TABLE' + chr(39)).removeprefix('CASE')} ELSE '' END AS context FROM documents",
    "paper_preview": """WITH n AS (SELECT paper_id, doc_id, text, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS n FROM documents WHERE paper_id IS NOT NULL),
        b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY paper_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM n WHERE n <= 2)
        SELECT paper_id, doc_id, left(text, greatest(0, 900 - used)::BIGINT) AS preview FROM b WHERE left(text, greatest(0, 900 - used)::BIGINT) <> ''""",
    "reference_answers": rf"""WITH {_REFS}, n AS (SELECT doc, count(*) AS n, count(*) FILTER (contains(lower(raw), 'selmak')) AS named, max(CASE WHEN index = 2 THEN raw END) AS second FROM refs GROUP BY doc),
        a AS (SELECT *, regexp_replace(trim(string_split_regex(regexp_replace(second, '^\s*(?:\[\d+\]|\d+[.)])\s*', ''), '(?i),|\band\b|\bet al\.?')[1], ' '), '^[.\s]+|[.\s]+$', '', 'g') AS author FROM n)
        SELECT doc || '/0' AS question_id, n::VARCHAR AS answer FROM a UNION ALL SELECT doc || '/1', n::VARCHAR FROM a UNION ALL SELECT doc || '/2', author FROM a WHERE coalesce(author, '') <> '' UNION ALL SELECT doc || '/3', named::VARCHAR FROM a""",
    "cited_entry": f"""WITH {_REFS}, q AS (SELECT entry_id AS quote_id, doc, {_WORDS.format('substring(raw, (length(raw) // 3)::INT, 70)')} AS w FROM refs), e AS (SELECT doc, index, {_WORDS.format('raw')} AS w FROM refs),
        m AS (SELECT quote_id, index, len(q.w) AS n, len(list_intersect(q.w, e.w)) AS k FROM q JOIN e USING (doc) WHERE len(q.w) >= 3), f AS (SELECT *, rank() OVER (PARTITION BY quote_id ORDER BY k DESC) AS place FROM m WHERE k >= 0.65 * n)
        SELECT quote_id, index, round(k / n, 6) AS overlap FROM (SELECT *, count(*) OVER (PARTITION BY quote_id) AS ties FROM f WHERE place = 1) WHERE ties = 1""",
    "grid_projection": """WITH l AS (SELECT l_orderkey AS grid_id, l_linenumber, max(l_quantity)::BIGINT AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY l_linenumber) - 1 AS row_no FROM l),
        k AS (SELECT * FROM n WHERE NOT (grid_id % 5 = 0 AND l_linenumber = 1))
        SELECT grid_id, row_no, 'quantity' AS name, q::VARCHAR AS value FROM k UNION ALL SELECT grid_id, row_no, 'part', p::VARCHAR FROM k""",
    "printed_values": "SELECT p_partkey, 'O(K^2) ' || p_size || '±' || p_size % 7 || ' 10^{-3}' AS value FROM part",
    "admitted_additions": f"""WITH l AS (SELECT l_orderkey AS t, l_linenumber, p_name AS key FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT DISTINCT t, {_WORDS.format('key')} AS w, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS f FROM l WHERE l_linenumber = 1),
        p AS (SELECT t, key || ' x' AS key, min(l_linenumber) AS seq FROM l WHERE l_linenumber > 1 GROUP BY ALL), x AS (SELECT *, {_WORDS.format('key')} AS w, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS f FROM p),
        known AS (SELECT DISTINCT x.t, x.key FROM x JOIN c USING (t) WHERE x.f = c.f OR len(list_intersect(x.w, c.w)) >= 0.72 * len(list_distinct(list_concat(x.w, c.w))) OR (least(len(x.w), len(c.w)) >= 2 AND len(list_intersect(x.w, c.w)) = least(len(x.w), len(c.w)))),
        o AS (SELECT t, key, row_number() OVER (PARTITION BY t ORDER BY seq, key) AS place FROM x ANTI JOIN known USING (t, key))
        SELECT t, key, place FROM o WHERE place <= 2""",
}
