"""Queries on located evidence and on what pages are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import locate as L
from ..operators.rank import bm25, top
from ..sources.tables import table
from . import sql

def _label() -> Column:
    return F.initcap("scorer_visible_id")


def visible_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of entries against texts in which they stand in several ways."""
    k = F.col("ordinal") % 5
    page = F.concat(F.lit("We follow "), F.element_at(F.array(F.lit("[ "), F.lit("Eq. "), F.lit("("), F.lit("reference "), F.lit("point ")), k + 1), "ordinal", F.element_at(F.array(F.lit(" ]"), F.lit("1"), F.lit(")"), F.lit(")"), F.lit("")), k + 1), F.lit(" here"))
    kind = F.when(F.col("entry_id") % 2 == 0, "citation_context").otherwise("equation_algorithm")
    return table(spark, folder, "bib_entries").where("ordinal is not null").select("entry_id", L.visible_id_on_page(page, F.concat(F.lit("Ref "), "ordinal"), kind).alias("there"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    pairs = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return pairs.join(table(spark, folder, "questions").select("query_id", "question"), "query_id")


def _ranked(spark: SparkSession, folder: str, texts: DataFrame) -> DataFrame:
    """The three texts (paper_id, doc, text) of each candidate paper that are most like its question."""
    scored = bm25(_pairs(spark, folder), "query_id", "question", texts, "doc", "text", ["paper_id"])
    return top(scored, 3, ["paper_id", "query"], [F.desc("score"), F.col("doc")]).withColumnRenamed("query", "query_id")


def _indexed(spark: SparkSession, folder: str) -> DataFrame:
    objects = table(spark, folder, "objects").where("paper_id is not null")
    captions = _ranked(spark, folder, objects.select("paper_id", F.col("row_id").alias("doc"), F.col("caption").alias("text")))
    captions = captions.join(objects.select(F.col("row_id").alias("doc"), "source_type", _label().alias("object_id"), "page"), "doc")
    docs = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", F.col("doc_id").alias("doc"), "text", "page")
    passages = _ranked(spark, folder, docs.select("paper_id", "doc", "text")).join(docs.select("doc", "text", "page"), "doc")
    # Every third passage prints the label of some object.
    passages = passages.withColumn("text", F.when(F.col("doc") % 3 == 0, F.concat("text", F.lit(" as in Table 1, Figure 2."))).otherwise(F.col("text")))
    return L.locate_indexed(table(spark, folder, "questions"), captions, passages, objects.select("paper_id", "page", "source_type", _label().alias("object_id")))


def _proposed(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", F.posexplode("support").alias("i", "s"))
    return rows.select("query_id", "paper_id", "s.source_type", "s.page", F.col("s.object_id").alias("object_id"), F.lit(0.6).alias("confidence"), (F.col("row_id") * 10 + F.col("i")).alias("seq"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "paper_id", "source_type", "page", "object_id", "confidence")


def evidence_indexed(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_indexed(spark, folder))


def _captions_only(spark: SparkSession, folder: str) -> DataFrame:
    """Evidence of questions that the table objects of their papers are."""
    objects = table(spark, folder, "objects").where("paper_id is not null").select("paper_id", "source_type", "page", _label().alias("object_id"), "row_id")
    return _pairs(spark, folder).join(objects, "paper_id").select("query_id", "paper_id", "source_type", "page", "object_id", F.lit(0.82).alias("confidence"), F.col("row_id").alias("seq"))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    d = F.substr("query_id", F.lit(-1)).cast("int")
    more = F.element_at(F.array(*map(F.lit, ["", " in Table 1", " by the figures", " in Fig. 2", " by the equation", " that cites it", "", " in the table", " in figure 99", ""])), d + 1)
    return table(spark, folder, "questions").select("query_id", F.concat(F.lit("What is shown"), more).alias("question"))


def evidence_hybrid(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(L.hybrid(_asked(spark, folder), _captions_only(spark, folder), _proposed(spark, folder)))


def evidence_union(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(L.united(_proposed(spark, folder), _captions_only(spark, folder)))


def evidence_requests(spark: SparkSession, folder: str) -> DataFrame:
    pairs = _pairs(spark, folder)
    k = F.length("question") % 6
    made = pairs.select("query_id", "paper_id", F.when(k.isNotNull(), F.element_at(F.array(*map(F.lit, ["target", "unrelated", "unrelated", "friend", "constraint", "target"])), k + 1)).alias("relationship"), F.when(k == 5, " ").otherwise(F.concat(F.lit(" see "), "paper_id")).alias("request"), F.when(k == 1, "0.95").when(k == 2, "NaN").otherwise("x").alias("confidence"))
    return L.targeted_requests(pairs, made)


def evidence_clues(spark: SparkSession, folder: str) -> DataFrame:
    d = F.substr("query_id", F.lit(-1)).cast("int")
    cells = F.array(F.array(F.lit("a"), F.lit(None), F.lit(" b ")), F.array(F.lit("a"), F.lit("b")), F.array(F.lit(" ")))
    answers = table(spark, folder, "questions").select("query_id", F.when(d < 5, " a ").alias("choice"), F.when(d % 2 == 0, " so ").alias("text"), F.when(d % 3 == 0, cells).alias("rows"))
    return L.clue_queries(table(spark, folder, "questions"), answers)


def _boxes(spark: SparkSession, folder: str, odd: int) -> DataFrame:
    """Boxes made of lines: an order is a document, its lines are boxes on two pages."""
    rows = table(spark, folder, "lineitem").where(F.col("l_linenumber") % 2 == odd).select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 2).alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("k"), (F.col("l_quantity") * 8).alias("x0"), (F.col("l_discount") * 5000).alias("y0"))
    rows = rows.distinct()
    name = F.concat_ws(":", "k.l_linenumber", "k.l_partkey", "k.l_suppkey", F.col("k.l_quantity").cast("int"))
    return rows.select("doc", "page", name.alias("seq"), "x0", "y0", (F.col("x0") + 60).alias("x1"), (F.col("y0") + F.when(F.col("k.l_linenumber") == 3, 0).otherwise(25)).alias("y1"))


def captions_nearby(spark: SparkSession, folder: str) -> DataFrame:
    return L.nearest_captions(_boxes(spark, folder, 1).withColumnRenamed("seq", "box"), _boxes(spark, folder, 0).withColumnRenamed("seq", "caption"))


def clips_of_tables(spark: SparkSession, folder: str) -> DataFrame:
    pages = _boxes(spark, folder, 1).select("doc", "page").distinct().select("doc", "page", F.lit(20.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(400.0).alias("x1"), F.lit(520.0).alias("y1"))
    return L.table_clips(_boxes(spark, folder, 1), _boxes(spark, folder, 0), pages)


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of papers as the lines of a document, some headed and some made into captions and equations."""
    e = table(spark, folder, "bib_entries").where("citing_paper_id is not null").select(F.col("citing_paper_id").alias("doc"), "entry_id", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ").alias("t"))
    k = F.col("entry_id") % 7
    made = F.when(k == 0, F.concat(F.lit("["), "entry_id", F.lit("] "), "t")).when(k == 1, "References").when(k == 2, F.concat(F.lit("Table 3a: "), "t")).when(k == 3, "x = y + z (4)").when(k == 4, F.concat(F.lit("Fig. 2 "), "t")).when(k == 5, "Algorithm 7 of it").otherwise(F.col("t"))
    return e.select("doc", "entry_id", made.alias("text"))


def lines_typed(spark: SparkSession, folder: str) -> DataFrame:
    return L.typed_lines(_lines(spark, folder), "doc", ["entry_id"], "text").select("entry_id", "kind", "object_id")


def blocks_of_entries(spark: SparkSession, folder: str) -> DataFrame:
    return L.entry_blocks(L.typed_lines(_lines(spark, folder), "doc", ["entry_id"], "text"), "doc", ["entry_id"], "text")


def grids_as_text(spark: SparkSession, folder: str) -> DataFrame:
    torn = F.concat(F.col("l_quantity").cast("int"), F.lit(" . "), F.col("l_linenumber"))
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.array(F.col("l_linenumber").cast("string"), torn, F.when(F.col("l_tax") > 0.04, "  a\n b")))).alias("cells"))
    empty = F.array(F.array(F.lit(" "), F.lit(None).cast("string")))
    return rows.select("l_orderkey", L.grid_text(F.concat("cells", empty)).alias("text"))


QUERIES = {f.__name__: f for f in (visible_ids, evidence_indexed, evidence_hybrid, evidence_union, evidence_requests, evidence_clues, captions_nearby, clips_of_tables, lines_typed, blocks_of_entries, grids_as_text)}

_D = "right(query_id, 1)::INT"
_INIT = "array_to_string(list_transform(string_split(scorer_visible_id, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_PAIRS = "pairs AS (SELECT DISTINCT c.query_id, c.paper_id, question FROM candidates c JOIN questions q USING (query_id) WHERE c.paper_id IS NOT NULL)"
_OBJ = f"obj AS (SELECT paper_id, row_id, source_type, page, {_INIT} AS object_id, caption FROM objects WHERE paper_id IS NOT NULL)"
_PROPOSED = "prop AS (SELECT query_id, paper_id, s.source_type AS source_type, s.page AS page, s.object_id AS object_id, 0.6::DOUBLE AS confidence, row_id * 10 + i AS seq FROM (SELECT query_id, paper_id, row_id, unnest(support) AS s, generate_subscripts(support, 1) - 1 AS i FROM candidates WHERE paper_id IS NOT NULL))"
_CAPS = "cap AS (SELECT query_id, paper_id, source_type, page, object_id, 0.82::DOUBLE AS confidence, row_id AS seq FROM pairs JOIN obj USING (paper_id))"
_FIRST = "SELECT query_id, paper_id, source_type, page, object_id, arg_min(confidence, seq) AS confidence FROM {0} GROUP BY ALL"
_BOX = "(SELECT DISTINCT l_orderkey AS doc, l_partkey % 2 AS page, l_linenumber || ':' || l_partkey || ':' || l_suppkey || ':' || l_quantity::INT AS seq, l_quantity * 8 AS x0, l_discount * 5000 AS y0, l_quantity * 8 + 60 AS x1, l_discount * 5000 + CASE l_linenumber WHEN 3 THEN 0 ELSE 25 END AS y1 FROM lineitem WHERE l_linenumber % 2 = {0})"
_LINES = r"""e AS (SELECT citing_paper_id AS doc, entry_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') AS t FROM bib_entries WHERE citing_paper_id IS NOT NULL),
    l AS (SELECT doc, entry_id, CASE entry_id % 7 WHEN 0 THEN '[' || entry_id || '] ' || t WHEN 1 THEN 'References' WHEN 2 THEN 'Table 3a: ' || t WHEN 3 THEN 'x = y + z (4)' WHEN 4 THEN 'Fig. 2 ' || t WHEN 5 THEN 'Algorithm 7 of it' ELSE t END AS text FROM e),
    h AS (SELECT *, trim(text, ' ') AS s, coalesce(max(CASE WHEN regexp_matches(trim(text, ' '), '(?i)^(\d+\.?\s*)?(references|bibliography)$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inside FROM l),
    typed AS (SELECT doc, entry_id, text, CASE WHEN regexp_matches(s, '(?i)^(table|tab\.?|figure|fig\.?)\s*(\d+[a-z]?)\b') THEN CASE WHEN lower(s[1:3]) = 'tab' THEN 'table' ELSE 'figure' END WHEN inside = 1 AND regexp_matches(s, '^(\[\d+\]|\d+\.)\s+\S') THEN 'citation_context'
            WHEN regexp_matches(s, '(?i)^algorithm\s+\d+\b') OR regexp_matches(s, '[=<>+].*\(\d+[a-z]?\)\s*$') THEN 'equation_algorithm' ELSE 'text_span' END AS kind, s FROM h),
    named AS (SELECT *, CASE kind WHEN 'table' THEN 'Table ' || regexp_extract(s, '(?i)^(table|tab\.?|figure|fig\.?)\s*(\d+[a-z]?)\b', 2) WHEN 'figure' THEN 'Figure ' || regexp_extract(s, '(?i)^(table|tab\.?|figure|fig\.?)\s*(\d+[a-z]?)\b', 2) WHEN 'citation_context' THEN 'Citation ' || regexp_extract(s, '(\d+)', 1)
            WHEN 'equation_algorithm' THEN CASE WHEN regexp_matches(s, '(?i)^algorithm\s+\d+\b') THEN 'Algorithm ' || regexp_extract(s, '(?i)^algorithm\s+(\d+)\b', 1) ELSE 'Equation ' || regexp_extract(s, '\((\d+[a-z]?)\)\s*$', 1) END END AS object_id FROM typed)"""
_BM = sql.bm25
SQL = {
    "visible_ids": "SELECT entry_id, CASE WHEN entry_id % 2 = 0 THEN ordinal % 5 IN (0, 3) ELSE ordinal % 5 = 2 END AS there FROM bib_entries WHERE ordinal IS NOT NULL",
    "evidence_hybrid": rf"""WITH {_PAIRS}, {_OBJ}, {_PROPOSED}, {_CAPS}, c AS (SELECT cap.*, {_D} AS d, lower(regexp_extract(object_id, '(?i)([0-9]+[a-z]?)\s*$', 1)) AS num FROM cap),
        ok AS (SELECT DISTINCT query_id, paper_id FROM c WHERE d IN (0, 2, 6, 9) OR (d = 1 AND source_type = 'table' AND num = '1') OR (d = 3 AND source_type = 'figure' AND num = '2') OR (d = 8 AND source_type = 'figure' AND num = '99')),
        u AS (SELECT * FROM cap UNION ALL SELECT * REPLACE (seq + 1000000 AS seq) FROM prop ANTI JOIN ok USING (query_id, paper_id)) {_FIRST.format('u')}""",
    "evidence_union": f"WITH {_PAIRS}, {_OBJ}, {_PROPOSED}, {_CAPS}, u AS (SELECT * FROM prop UNION ALL SELECT * REPLACE (seq + 1000000 AS seq) FROM cap) {_FIRST.format('u')}",
    "evidence_requests": f"WITH {_PAIRS} SELECT query_id, paper_id, CASE WHEN length(question) % 6 IN (0, 2, 4) THEN 'Question: ' || question || chr(10) || 'This paper is: ' || ['target', '', 'unrelated', '', 'constraint'][length(question) % 6 + 1] || chr(10) || 'Look for: ' || trim('see ' || paper_id, ' ') ELSE question END AS request FROM pairs WHERE coalesce(length(question) % 6, 0) <> 1",
    "evidence_clues": f"""WITH q AS (SELECT query_id, question, {_D} AS d, nullif(trim(mc_options['A'], ' '), '') AS a FROM questions), c AS (SELECT *, list_filter([CASE WHEN d < 5 THEN a END, CASE WHEN d % 2 = 0 THEN 'so' END, CASE WHEN d % 3 = 0 THEN 'a | b' END], lambda x: x IS NOT NULL) AS l FROM q)
        SELECT query_id, CASE WHEN len(l) > 0 THEN coalesce(question, '') || chr(10) || array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)) ELSE question END AS text FROM c""",
    "captions_nearby": f"""WITH m AS (SELECT b.doc, b.page, b.seq AS box, c.seq AS caption, greatest(0, greatest(b.x0, c.x0) - least(b.x1, c.x1)) AS x, least(abs(b.y0 - c.y1), abs(c.y0 - b.y1)) AS y FROM {_BOX.format(1)} b JOIN {_BOX.format(0)} c USING (doc, page))
        SELECT doc, page, box, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc, page, box ORDER BY x, y, caption) AS n FROM m) WHERE n = 1 AND x <= 72 AND y <= 180""",
    "clips_of_tables": f"""WITH m AS (SELECT t.doc, t.page, round(3 * greatest(0, t.x0 - c.x1, c.x0 - t.x1) + greatest(0, t.y0 - c.y1, c.y0 - t.y1) + 0.001 * (abs(t.x0 + t.x1 - c.x0 - c.x1) + abs(t.y0 + t.y1 - c.y0 - c.y1)), 9) AS cost, t.seq AS ts, c.seq AS cs,
            least(t.x0, c.x0) AS x0, least(t.y0, c.y0) AS y0, greatest(t.x1, c.x1) AS x1, greatest(t.y1, c.y1) AS y1 FROM {_BOX.format(1)} t JOIN {_BOX.format(0)} c USING (doc, page) WHERE t.x1 > t.x0 AND t.y1 > t.y0)
        SELECT doc, page, greatest(20.0, x0 - 12)::DOUBLE AS x0, greatest(10.0, y0 - 12)::DOUBLE AS y0, least(400.0, x1 + 12)::DOUBLE AS x1, least(520.0, y1 + 12)::DOUBLE AS y1 FROM (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY cost, ts, cs) AS n FROM m) WHERE n = 1""",
    "lines_typed": f"WITH {_LINES} SELECT entry_id, kind, object_id FROM named",
    "blocks_of_entries": f"""WITH {_LINES}, b AS (SELECT *, sum(CASE WHEN kind <> 'text_span' OR coalesce(before, '') IN ('', 'table', 'figure', 'equation_algorithm') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY entry_id) - 1 AS block FROM (SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY entry_id) AS before FROM named))
        SELECT doc, block::BIGINT AS block, min_by({{k: kind}}, entry_id).k AS kind, min_by({{o: object_id}}, entry_id).o AS object_id, string_agg(s, chr(10) ORDER BY entry_id) AS text FROM b GROUP BY doc, block""",
    "grids_as_text": """WITH c AS (SELECT DISTINCT l_orderkey, l_linenumber::VARCHAR AS a, l_quantity::INT || '.' || l_linenumber AS b, l_quantity::INT || ' . ' || l_linenumber AS o, CASE WHEN l_tax > 0.04 THEN 'a b' ELSE '' END AS c FROM lineitem)
        SELECT l_orderkey, string_agg(a || chr(9) || b || chr(9) || c, chr(10) ORDER BY a, o, c) AS text FROM c GROUP BY l_orderkey""",
    "evidence_indexed": rf"""WITH {_PAIRS}, {_OBJ}, oq AS MATERIALIZED (WITH {_BM('SELECT paper_id, query_id AS query, question AS text FROM pairs', 'SELECT paper_id, row_id AS doc, caption AS text FROM obj', 'paper_id')}
            SELECT *, row_number() OVER (PARTITION BY paper_id, query ORDER BY score DESC, doc) AS rank FROM scored),
        pq AS MATERIALIZED (WITH {_BM('SELECT paper_id, query_id AS query, question AS text FROM pairs', 'SELECT paper_id, doc_id AS doc, text FROM documents WHERE paper_id IS NOT NULL', 'paper_id')}
            SELECT *, row_number() OVER (PARTITION BY paper_id, query ORDER BY score DESC, doc) AS rank FROM scored),
        asked AS (SELECT query_id, list_transform(regexp_extract_all(coalesce(question, ''), '(?i)\b(table|figure|fig[.]?)\s*([0-9]+[a-z]?)?\b'), lambda m: lower(CASE WHEN lower(m[1:3]) = 'fig' THEN 'figure' ELSE 'table' END || ':' || regexp_extract(m, '(?i)\b(table|figure|fig[.]?)\s*([0-9]+[a-z]?)?\b', 2))) AS a FROM questions),
        x AS (SELECT q.query AS query_id, q.paper_id, source_type, page, object_id, CASE WHEN list_contains(a, source_type || ':') OR list_contains(a, source_type || ':' || lower(regexp_extract(object_id, '(?i)([0-9]+[a-z]?)\s*$', 1))) THEN 0.95 ELSE 0.82 END::DOUBLE AS confidence, rank * 2 - 1000 AS seq
            FROM oq q JOIN obj ON obj.row_id = q.doc JOIN asked ON asked.query_id = q.query WHERE rank <= 3),
        t AS (SELECT q.query AS query_id, q.paper_id, page, rank, regexp_replace(CASE WHEN doc % 3 = 0 THEN text || ' as in Table 1, Figure 2.' ELSE text END, '\s+', ' ', 'g') AS text FROM pq q JOIN documents d ON d.doc_id = q.doc WHERE rank <= 3 AND page IS NOT NULL),
        m AS (SELECT t.*, o.object_id, o.source_type FROM t JOIN (SELECT DISTINCT paper_id, page, source_type, object_id FROM obj) o USING (paper_id, page) WHERE regexp_matches(text, '(^|[^\w])' || regexp_escape(object_id) || '([^\w.]|$)')),
        z AS (SELECT query_id, paper_id, source_type, page, object_id, 0.88::DOUBLE AS confidence, rank * 2 + 1 AS seq FROM (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY rank, object_id, source_type) AS n FROM m) WHERE n = 1),
        u AS (SELECT * FROM x UNION ALL SELECT query_id, paper_id, 'text_span', page, NULL, 0.72, rank * 2 FROM t UNION ALL SELECT * FROM z) {_FIRST.format('u')}""",
}
