"""Queries on facts for cells: tables are orders, rows their lines, keys the names of parts, papers the suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import facts as A
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_type")
    return table(spark, folder, "lineitem").join(part, "l_partkey")


_PATHS = [("Test accuracy", "CIFAR 10"), ("Iters", "accuracy"), ("ImageNet", "CIFAR accuracy"), ("", "accuracy"), ("Steps", "values")]
_WANTS = [("acc", "cifar"), ("performance", "iterations"), ("accuracy", "cifar"), ("accuracy", "x"), ("value", "nfe"), ("speed", "steps"), ("of the", "x")]


def headers_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of headers against columns and terms, by the numbers of lines."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", (F.col("l_partkey") % len(_PATHS)).cast("int").alias("p"), (F.col("l_suppkey") % len(_WANTS)).cast("int").alias("w")).distinct()
    path = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in _PATHS]), F.col("p") + 1)
    want = F.element_at(F.array(*[F.array(*map(F.lit, w)) for w in _WANTS]), F.col("w") + 1)
    return rows.select("l_orderkey", "p", "w", A.header_fits(path, F.element_at(want, 1), F.array(F.element_at(want, 2))).alias("fits"))


def cell_admission(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    text = F.concat(F.lit("the "), "p_name", F.lit(" has "), q, F.lit(" units"))
    paper = F.when(q % 11 != 0, F.col("l_suppkey").cast("string"))
    rows = _lines(spark, folder).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", (q % 7 != 0).alias("target_known"), (q % 13 != 0).alias("column_known"), F.when(F.col("l_linenumber") == 1, F.array(F.lit("none"))).otherwise(F.array(paper)).alias("owners"), paper.alias("paper_id"), (F.col("l_linenumber") - 2).alias("page"), F.when(q % 5 == 0, "video").otherwise("table").alias("source_type"),
        F.when(q % 17 == 0, " ").when(q % 3 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" (x)"))).alias("key"), F.col("p_name").alias("expected"), (q % 19 != 0).alias("header_fits"), F.when(q % 23 == 0, "").when(q % 2 == 0, F.lit("no such")).otherwise(q.cast("string")).alias("value"), F.when(q % 29 != 0, "q").alias("quote"), text.alias("source_text"), F.when(q % 31 != 0, F.array(F.lit("vision"))).alias("families"))
    return A.admissions(rows.distinct()).select(F.explode_outer("reasons").alias("reason"), "admitted").groupBy("reason", "admitted").agg(F.count("*").alias("n"))


def replacement_guard(spark: SparkSession, folder: str) -> DataFrame:
    """Values with units against shorter, other and changed ones."""
    k, q = F.col("l_linenumber"), F.col("l_quantity").cast("int").cast("string")
    old = F.when(k == 1, F.concat(q, F.lit(" sessions"))).when(k == 2, F.concat(F.lit("O(K^"), q, F.lit(")"))).when(k == 3, F.concat(q, F.lit(" ± 2"))).when(k == 4, "-").otherwise(q)
    new = F.when(k == 1, q).when(k == 2, F.concat(F.lit("O(K"), q, F.lit(")"))).when(k == 3, F.concat(q, F.lit(" 2"))).when(k == 4, q).when(k == 5, F.concat(q, F.lit("0"))).when(k == 6, F.concat(F.lit(" "), q))
    kind = F.when(F.col("l_discount") > 0.05, "number").otherwise("string")
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", q.alias("q"), kind.alias("kind"), A.keeps_information(old, new, kind).alias("kept")).distinct()


def targets_present(spark: SparkSession, folder: str) -> DataFrame:
    """Names of parts in texts in which they are whole, closed up, with a slip, or of another."""
    k = F.col("p_partkey") % 5
    word = F.regexp_replace("p_name", " ", "")
    text = F.when(k == 0, F.concat(F.lit("see "), F.upper("p_name"), F.lit("."))).when(k == 1, F.concat(F.lit("a-"), word)).when(k == 2, F.concat(F.lit("the "), F.left(word, F.length(word) - 1), F.lit(" here"))).when(k == 3, F.concat(F.left("p_name", F.lit(3)), F.lit("tention"))).otherwise(F.lit(None).cast("string"))
    return table(spark, folder, "part").select("p_partkey", A.target_present(text, F.concat("p_name", F.lit(" (new)"))).alias("present"))


def keys_attested(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of words of documents' paragraphs as keys of the documents' papers."""
    docs = table(spark, folder, "documents").where("paper_id is not null")
    words = F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), 1)
    key = F.when(F.col("doc_id") % 3 == 0, F.array(F.get(words, F.lit(0)), F.get(words, F.lit(3)))).when(F.col("doc_id") % 3 == 1, F.array(F.get(words, F.lit(1)), F.lit("nowhere said"))).otherwise(F.array(F.get(words, F.lit(1)), F.lit(" ")))
    expected = docs.select(F.col("doc_id").alias("table"), "paper_id", key.alias("key"))
    out = A.attested_keys(expected, docs.select("paper_id", "text"))
    return out.select("table", F.array_join("key", "|").alias("key"))


def locators_visual(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", F.posexplode("support").alias("i", "s"))
    return A.visual_locators(rows.select("query_id", "paper_id", "s.source_type", "s.page", "s.object_id", (F.col("row_id") % 4 / 4).alias("confidence"), (F.col("row_id") * 10 + F.col("i")).alias("seq")))


def rows_last(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).select(F.col("l_orderkey").alias("t"), F.col("p_name").alias("key"), F.col("l_linenumber").alias("seq"), "l_quantity", "l_tax")
    return A.last_rows(rows, ["t", "key"], ["l_quantity", "l_tax"])


def rows_of_papers(spark: SparkSession, folder: str) -> DataFrame:
    pool = load_pool(table(spark, folder, "papers")).select("paper_id", "title")
    rows = table(spark, folder, "candidates").where("paper_id is not null").select(F.col("query_id").alias("table"), F.trim("paper_id").alias("paper_id"), F.when(F.col("row_id") % 2 == 0, F.col("paper_id")).alias("printed"), F.col("row_id").alias("seq"))
    return A.paper_rows(rows, pool)


def scalars_filled(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    rows = lines.groupBy(F.col("l_orderkey").alias("table"), F.col("l_partkey").alias("key")).agg(F.max(F.when(F.col("l_quantity") > 25, F.col("l_quantity"))).alias("value"))
    routes = lines.select(F.col("l_orderkey").alias("table"), F.col("l_partkey").alias("key"), F.col("l_suppkey").alias("paper_id"), F.when(F.col("l_linenumber") % 4 == 0, "ambiguous").otherwise("owned").alias("status"), F.when(F.col("l_linenumber") % 3 == 0, 2500).otherwise(9000).alias("score"))
    quote = F.when(F.col("l_tax") < 0.03, F.concat(F.col("l_quantity").cast("int"), F.lit(" ± 1"))).when(F.col("l_tax") < 0.06, F.concat(F.col("l_quantity").cast("int"), F.lit("%"))).otherwise("about 7")
    return A.scalar_fills(rows, routes, lines.select(F.col("l_orderkey").alias("table"), F.col("l_suppkey").alias("paper_id"), quote.alias("quote")))


def targets_of_aliases(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    first = F.substring_index("p_name", " ", 1)
    aliases = lines.select(F.col("l_orderkey").alias("table"), F.when(F.col("l_linenumber") % 3 == 0, first).when(F.col("l_linenumber") % 3 == 1, F.upper(first)).otherwise(F.concat(F.substring_index("p_name", " ", -1), F.lit(" "), first)).alias("alias"))
    return A.alias_targets(aliases, lines.select(F.col("l_orderkey").alias("table"), F.col("p_name").alias("key")))


def papers_preferred(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    rows = lines.select(F.col("l_orderkey").alias("table"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.concat("p_name", F.lit(" (ours)"))).alias("key"))
    return A.preferred_papers(rows, lines.where("l_linenumber > 1").select(F.col("l_orderkey").alias("table"), F.col("p_name").alias("expected"), F.col("l_suppkey").cast("string").alias("paper_id")))


def values_emitted(spark: SparkSession, folder: str) -> DataFrame:
    q = F.col("l_quantity").cast("int").cast("string")
    typed, candidates = F.when(F.col("l_tax") > 0.02, q), F.when(F.col("l_discount") > 0.03, F.array(F.concat(q, F.lit(".0")), q)).otherwise(F.array().cast("array<string>"))
    literal = F.concat(q, F.lit(" pcs"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[A.emitted_value(literal, typed, candidates, p).alias(p) for p in ("literal", "typed", "scorer")]).distinct()


def fills_proved(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("r")).agg(F.max("l_quantity").alias("v"))
    base = line.withColumn("v", F.when(F.col("v") > 20, F.col("v")))
    filled = line.where("t % 7 <> 0 or r <> 1").withColumn("v", F.when(F.col("t") % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return A.null_fill_proofs(base, filled, line.where("v > 2"), "t", "r", "v")


QUERIES = {f.__name__: f for f in (headers_fit, cell_admission, replacement_guard, targets_present, keys_attested, locators_visual, rows_last, rows_of_papers, scalars_filled, targets_of_aliases, papers_preferred, values_emitted, fills_proved)}

_L = "(SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey)"
_Q = "l_quantity::INT"
_FLAT = r"trim(regexp_replace(trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'), ' '), '^[\"'']+|[\"'']+$', '', 'g'), ' ')"
_BARE = r"trim(regexp_replace({0}, '\s*\([^)]*\)', '', 'g'), ' ')"
_S = sql.sequence_text
_TOL = "(x = y OR a = b OR (least(length(a), length(b)) >= 3 AND (starts_with(a, b) OR starts_with(b, a))) OR (least(length(a), length(b)) >= 5 AND levenshtein(a, b) <= 1))"
#: Of each path the wanted pairs that it fits, worked out by hand.
_FITS = {0: [0, 2], 1: [1], 2: [], 3: [], 4: [4]}
SQL = {
    "headers_fit": "SELECT DISTINCT l_orderkey, (l_partkey % 5)::INT AS p, (l_suppkey % 7)::INT AS w, (p, w) IN (" + ", ".join(f"({p}, {w})" for p, ws in _FITS.items() for w in ws) + ") AS fits FROM lineitem",
    "cell_admission": f"""WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber AS k, l_partkey, l_suppkey, {_Q} AS q, p_name, ' ' || lower(p_name) || ' ' AS s FROM {_L}),
        f AS (SELECT *, q % 17 = 0 AS blank, q % 23 = 0 AS novalue FROM r),
        x AS (SELECT list_filter([CASE WHEN q % 7 = 0 THEN 'unknown_target' END, CASE WHEN q % 13 = 0 THEN 'unknown_column' END, CASE WHEN q % 11 = 0 THEN 'no_paper' END, CASE WHEN k = 1 OR q % 11 = 0 THEN 'wrong_owner' END, CASE WHEN k < 3 THEN 'bad_page' END, CASE WHEN q % 5 = 0 THEN 'bad_source_type' END,
            CASE WHEN blank THEN 'empty_key' END, CASE WHEN blank THEN 'key_not_expected' END, CASE WHEN NOT blank AND q % 3 <> 0 THEN 'key_not_printed' END, CASE WHEN q % 19 = 0 THEN 'header_mismatch' END, CASE WHEN novalue THEN 'empty_value' END, CASE WHEN NOT novalue AND q % 2 = 0 THEN 'value_not_printed' END,
            CASE WHEN q % 29 = 0 THEN 'empty_quote' END, CASE WHEN q % 31 = 0 THEN 'no_verifier' END], lambda z: z IS NOT NULL) AS l FROM f)
        SELECT reason, reason IS NULL AS admitted, count(*) AS n FROM (SELECT unnest(CASE WHEN len(l) = 0 THEN [NULL] ELSE l END) AS reason FROM x) GROUP BY ALL""",
    "replacement_guard": f"""SELECT DISTINCT l_orderkey, l_linenumber, ({_Q})::VARCHAR AS q, CASE WHEN l_discount > 0.05 THEN 'number' ELSE 'string' END AS kind, l_discount > 0.05 OR l_linenumber > 3 AS kept FROM lineitem""",
    "targets_present": f"""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN TRUE WHEN 1 THEN length(replace(p_name, ' ', '')) >= 5 WHEN 2 THEN length(replace(p_name, ' ', '')) >= 6 ELSE FALSE END AS present FROM part""",
    "keys_attested": f"""WITH d AS (SELECT doc_id, paper_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w, {_S('text')} AS s FROM documents WHERE paper_id IS NOT NULL)
        SELECT DISTINCT a.doc_id AS table, a.w[1] || '|' || a.w[4] AS key FROM d a JOIN d b USING (paper_id) WHERE a.doc_id % 3 = 0 AND a.w[4] IS NOT NULL AND contains(b.s, ' ' || a.w[1] || ' ') AND contains(b.s, ' ' || a.w[4] || ' ')""",
    "locators_visual": """WITH e AS (SELECT query_id, paper_id, s.source_type AS k, s.page AS page, s.object_id AS object_id, (row_id % 4) / 4.0 AS c, row_id * 10 + i AS seq FROM (SELECT query_id, paper_id, row_id, unnest(support) AS s, generate_subscripts(support, 1) - 1 AS i FROM candidates WHERE paper_id IS NOT NULL)),
        o AS (SELECT query_id, paper_id, page, object_id, max(c) AS c, arg_min(seq, seq - c * 1000000000000) AS seq FROM e WHERE k IN ('table', 'figure') AND page >= 1 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id ORDER BY c DESC, seq) AS place FROM o)
        SELECT query_id, paper_id, page, object_id, place FROM r WHERE place <= 3""",
    "rows_last": f"SELECT l_orderkey AS t, p_name AS key, arg_max({{q: l_quantity, x: l_tax}}, (l_linenumber, l_quantity, l_tax)).q AS l_quantity, arg_max({{q: l_quantity, x: l_tax}}, (l_linenumber, l_quantity, l_tax)).x AS l_tax FROM {_L} GROUP BY ALL",
    "rows_of_papers": f"""WITH p AS (SELECT paper_id, min_by({{x: title}}, row_id).x AS title FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id), r AS (SELECT query_id, row_id, coalesce(nullif(trim(title, ' '), ''), CASE WHEN row_id % 2 = 0 THEN nullif(trim(c.paper_id, ' '), '') END) AS label FROM candidates c LEFT JOIN p ON p.paper_id = trim(c.paper_id, ' ') WHERE c.paper_id IS NOT NULL)
        SELECT query_id AS table, arg_min(label, row_id) AS label, min(row_id) AS seq FROM r WHERE label IS NOT NULL GROUP BY query_id, {_FLAT.format('label')}""",
    "scalars_filled": f"""WITH r AS (SELECT l_orderkey AS t, l_partkey AS key, max(CASE WHEN l_quantity > 25 THEN l_quantity END) AS value FROM lineitem GROUP BY ALL),
        n AS (SELECT l_orderkey AS t, l_suppkey AS p, max({_Q})::DOUBLE AS n FROM lineitem WHERE l_tax < 0.06 GROUP BY ALL HAVING count(DISTINCT {_Q}) = 1),
        o AS (SELECT l_orderkey AS t, l_partkey AS key, min(l_suppkey) AS p FROM lineitem WHERE l_linenumber % 4 <> 0 AND l_linenumber % 3 <> 0 GROUP BY ALL HAVING count(DISTINCT l_suppkey) = 1)
        SELECT r.t AS table, r.key, coalesce(value, n) AS value, value IS NULL AND n IS NOT NULL AS filled FROM r LEFT JOIN o ON o.t = r.t AND o.key = r.key LEFT JOIN n ON n.t = r.t AND n.p = o.p""",
    "targets_of_aliases": f"""WITH l AS (SELECT l_orderkey AS t, l_linenumber % 3 AS k, p_name, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[-1] AS z FROM {_L}),
        a AS (SELECT DISTINCT t, CASE k WHEN 0 THEN f WHEN 1 THEN upper(f) ELSE z || ' ' || f END AS alias FROM l), b AS (SELECT *, list_distinct(string_split(lower(alias), ' ')) AS w FROM a), c AS (SELECT * FROM b WHERE len(w) > 1 OR regexp_matches(alias, '[0-9]|[A-Z].*[A-Z]')),
        m AS (SELECT c.t, alias, p_name FROM c JOIN (SELECT DISTINCT t, p_name FROM l) k ON k.t = c.t WHERE len(list_filter(w, lambda x: NOT list_contains(string_split(lower(p_name), ' '), x))) = 0)
        SELECT t AS table, alias, min(p_name) AS key FROM m GROUP BY ALL HAVING count(DISTINCT p_name) = 1""",
    "papers_preferred": f"""WITH l AS (SELECT l_orderkey AS t, l_linenumber AS k, l_suppkey::VARCHAR AS p, p_name FROM {_L}), r AS (SELECT DISTINCT t, CASE WHEN k % 2 = 0 THEN upper(p_name) ELSE p_name || ' (ours)' END AS key FROM l), o AS (SELECT DISTINCT t, p_name, p FROM l WHERE k > 1),
        m AS (SELECT r.t, key, p, {_FLAT.format('key')} AS x, {_FLAT.format('p_name')} AS y FROM r JOIN o USING (t)), n AS (SELECT *, {_BARE.format('x')} AS a, {_BARE.format('y')} AS b FROM m)
        SELECT t AS table, key, array_to_string(list_sort(list(DISTINCT p)), ',') AS papers FROM n WHERE {_TOL} GROUP BY t, key""",
    "values_emitted": f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_Q} || ' pcs' AS literal, CASE WHEN l_tax > 0.02 THEN ({_Q})::VARCHAR ELSE {_Q} || ' pcs' END AS typed, CASE WHEN l_discount > 0.03 THEN {_Q} || '.0' ELSE {_Q} || ' pcs' END AS scorer FROM lineitem",
    "fills_proved": """WITH l AS (SELECT l_orderkey AS t, l_linenumber AS r, max(l_quantity) AS v FROM lineitem GROUP BY ALL)
        SELECT t, reason = 'accepted' AS accepted, reason FROM (SELECT t, CASE WHEN bool_or(t % 7 = 0 AND r = 1) THEN 'other_rows' WHEN t % 5 = 0 AND bool_or(v > 20) THEN 'changed_value' WHEN bool_or(v <= 2) THEN 'no_proof' ELSE 'accepted' END AS reason FROM l GROUP BY t)""",
}
