"""Queries on plans, seeds, attempts and answer lines. Proposals that a model would make are written out by the last digit of the question's id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import initialism, normalized_title
from ..operators import planning as P
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql

_TARGETS = '[{"key":"K1","text":"t1","role":"target"},{"key":"k1","text":"t2","role":"target"},{"text":"t3","role":" Evidence_Anchor "},{"key":"x","text":" ","role":"target"},{"key":"y","text":"t4","role":"boss"}]'
#: Of each last digit the attempts at a plan.
PLANS = [
    ['{"criterion":{"venue":" Ormil ","year":"2023","required_source_type":"Table","description":"about maps"},"strategies":["name","name","foo",3,"baseline"],"named_methods":["A","",7,"B"],"multiplicity":"single","targets":' + _TARGETS + ',"desired_paper_count":3}'],
    ['```json\n{"criterion":{"year":2022,"venue":5},"strategies":["knn","citation"],"desired_paper_count":1,"multiplicity":"multi"}\n```'],
    ["not json"],
    ['{"criterion":[],"strategies":"name","named_methods":"A","multiplicity":"many","desired_paper_count":true}'],
    ['{"criterion":{"year":true,"required_source_type":"video"},"desired_paper_count":25,"multiplicity":"multi"}'],
    ["{}"],
    ["broken {", '{"desired_paper_count":"2"}', '{"desired_paper_count":7}'],
    ["[1,2]"],
    [None],
    ['{"strategies":["property","name"],"criterion":{"description":" "}}'],
]


def _digit() -> Column:
    return F.substr("query_id", F.lit(-1)).cast("int")


def _by_digit(values: list) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), _digit() + 1)


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return load_pool(table(spark, folder, "papers")).where("title is not null")


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """Each question with the titles of its candidates."""
    pairs = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return pairs.join(_pool(spark, folder).select("paper_id", "title"), "paper_id")


def plan_parsed(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "questions").select("query_id", "question")
    rows = [(d, k, text) for d, texts in enumerate(PLANS) for k, text in enumerate(texts)]
    made = spark.createDataFrame(rows, "d int, attempt int, plan string")
    plans = P.parse_plans(questions, questions.select("query_id", _digit().alias("d")).join(F.broadcast(made), "d"))
    said = F.array_join(F.transform("targets", lambda t: F.concat_ws(":", t["key"], t["text"], t["role"])), ";")
    return plans.select("query_id", "venue", "year", "source_type", "description", F.array_join("named_methods", ",").alias("named_methods"), F.array_join("strategies", ",").alias("strategies"), "multiplicity", said.alias("targets"), "desired", "planned")


def _keys(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder)
    short = pool.select(initialism("title").alias("key"), F.lit("acronym").alias("kind"), "paper_id").where("length(key) between 2 and 8")
    return pool.select(normalized_title("title").alias("key"), F.lit("title").alias("kind"), "paper_id").unionByName(short)


def seed_exact(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.length("title") % 2 == 0
    names = _asked(spark, folder).select("query_id", F.when(whole, normalized_title("title")).otherwise(initialism("title")).alias("name"), F.when(whole, "title").otherwise("acronym").alias("kind"))
    return P.exact_seeds(names, _keys(spark, folder))


def seed_dense(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", F.explode("route_signals").alias("s")).where("s.route = 'dense'")
    return P.dense_seeds(rows.groupBy("query_id", "paper_id").agg((F.min("s.rank") + 1).alias("rank")))


def _proposed(spark: SparkSession, folder: str) -> DataFrame:
    """Titles as they are, without their last words, and with other words in their second half."""
    words = F.split("title", " ")
    cut = F.array_join(F.slice(words, 1, F.greatest(F.lit(1), F.size(words) - 1)), " ")
    half = F.concat_ws(" ", F.array_join(F.slice(words, 1, 2), " "), F.lit("entirely different contents here follow now"))
    k = F.length("title") % 3
    return _asked(spark, folder).select("query_id", "paper_id", F.when(k == 0, F.col("title")).when(k == 1, cut).otherwise(half).alias("title"))


def _steps(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Papers with a title, and papers whose titles begin like it."""
    proposed, pool = _proposed(spark, folder).select("title").distinct(), _pool(spark, folder)
    exact = proposed.join(pool.select(F.col("title").alias("t"), "paper_id"), normalized_title("title") == normalized_title("t")).select("title", "paper_id")
    begin = lambda c: F.substring_index(F.lower(c), " ", 2)
    alike = proposed.withColumn("b", begin("title")).join(pool.select(begin("title").alias("b"), "paper_id"), "b").groupBy("title").agg(F.min("paper_id").alias("paper_id"))
    return exact, alike


def seed_proposed(spark: SparkSession, folder: str) -> DataFrame:
    exact, alike = _steps(spark, folder)
    return P.proposed_seeds(_proposed(spark, folder), exact, alike.withColumn("rank", F.lit(1)), _pool(spark, folder))


def name_resolution(spark: SparkSession, folder: str) -> DataFrame:
    exact, alike = _steps(spark, folder)
    names = _proposed(spark, folder).select("query_id", F.col("title").alias("name"))
    return P.first_resolution(names, exact.withColumnRenamed("title", "name"), alike.withColumnRenamed("title", "name"))


def seed_confirmations(spark: SparkSession, folder: str) -> DataFrame:
    said = ['{"match": true, "confidence": 0.75}', '{"match": "true", "confidence": 0.9}', '{"match": true, "confidence": 7}', '{"match": false}', '{"match": true, "confidence": "0.5"}', "nothing", None, '{"match": 1}', '{"match": true, "confidence": -1}', '{"match": true}']
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    return P.confirmations(rows.withColumn("answer", _by_digit(said)))


def first_wins(spark: SparkSession, folder: str) -> DataFrame:
    return P.first_records(table(spark, folder, "candidates").select("query_id", "row_id", "paper_id"), "query_id", "row_id")


def better_attempts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").select("query_id", (F.col("row_id") % 5).alias("attempt"), (F.col("row_id") % 4 / 4).alias("confidence"))
    return P.better_attempt(rows, ["query_id"])


def override_papers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").groupBy("query_id", "paper_id").agg(F.min("row_id").alias("place"))
    other = rows.where("query_id < 'q0200' and place % 3 = 0")
    caps = table(spark, folder, "questions").select("query_id", F.when(_digit() > 2, _digit()).alias("cap"))
    return P.overridden(rows, other, caps)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", F.explode("support").alias("s"))
    return rows.select("query_id", "row_id", F.when(F.col("row_id") % 2 == 0, "freeform").otherwise("table").alias("answer_type"), "paper_id", "s.source_type", "s.page", "s.object_id")


def answers_merged(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "questions").select("query_id", F.explode("answer_types").alias("answer_type")).withColumn("confidence", (_digit() + F.length("answer_type") % 5) / 10)
    merged = P.merged_answers(parts, _evidence(spark, folder))
    return merged.withColumn("types", F.array_join("types", ","))


def _texts(spark: SparkSession, folder: str, values: list, grounded: list) -> DataFrame:
    return table(spark, folder, "questions").select("query_id", _by_digit(values).alias("text"), _by_digit(grounded).alias("grounded"))


def freeform_routes(spark: SparkSession, folder: str) -> DataFrame:
    some, none = "query_id", None
    t = lambda mask: [F.col(some) if c == "1" else F.lit(" ") if c == "_" else F.lit(none).cast("string") for c in mask]
    g = lambda mask: [c == "1" for c in mask]
    return P.freeform_route(_texts(spark, folder, t("1_0000000_"), g("1111111111")), _texts(spark, folder, t("1111000_00"), g("0101010101")), _texts(spark, folder, t("1111110011"), g("0000000001")))


def answers_serialized(spark: SparkSession, folder: str) -> DataFrame:
    d = _digit()
    cells = F.array(F.create_map(F.lit("k"), F.col("query_id"), F.lit("v"), d.cast("string")))
    return P.serialized(table(spark, folder, "questions").select("query_id", F.when(d % 2 == 0, F.col("query_id")).alias("text"), F.when(d % 3 == 0, "B").alias("choice"), F.when(d % 5 == 0, cells).alias("rows")))


def answer_fallbacks(spark: SparkSession, folder: str) -> DataFrame:
    d = _digit()
    answers = table(spark, folder, "questions").where(d != 9).select("query_id", F.when(d > 2, "x").alias("text"), F.when(d % 3 != 0, " a ").otherwise("Z").alias("choice"), (d % 2).alias("n_rows"), F.when(d == 4, 0.1).otherwise(0.6).alias("choice_confidence"), F.when(d == 5, 0.0).otherwise(0.6).alias("table_confidence"))
    out = P.fallback_types(table(spark, folder, "questions").select("query_id", "answer_types", "mc_options"), answers)
    return out.withColumn("fallbacks", F.array_join("fallbacks", ","))


def lines_repaired(spark: SparkSession, folder: str) -> DataFrame:
    first = P.first_records(table(spark, folder, "candidates"), "query_id", "row_id")
    papers = F.array(F.concat(F.lit(" "), "paper_id"), F.lower(F.trim("paper_id")), F.lit(""), F.col("query_id"))
    evidence = F.transform("support", lambda s: F.struct(F.col("query_id").alias("paper_id"), s["source_type"].alias("source_type"), F.when(s["page"] > 5, F.create_map(F.lit("page"), s["page"].cast("string"))).otherwise(F.create_map().cast("map<string,string>")).alias("locator")))
    lines = first.select("query_id", papers.alias("papers"), evidence.alias("evidence"))
    return P.repaired_lines(table(spark, folder, "questions"), lines).withColumn("papers", F.array_join("papers", ","))


def score_freeform(spark: SparkSession, folder: str) -> DataFrame:
    gold = table(spark, folder, "questions").select("query_id", F.col("query_id").alias("text"))
    said = gold.where(_digit() != 7).select("query_id", F.when(_digit() % 3 == 0, F.concat(F.lit(' "'), F.upper("text"), F.lit('" '))).when(_digit() == 4, "").otherwise(F.concat("text", F.lit("x"))).alias("text"))
    return P.exact_match(gold, said)


QUERIES = {f.__name__: f for f in (plan_parsed, seed_exact, seed_dense, seed_proposed, name_resolution, seed_confirmations, first_wins, better_attempts, override_papers, answers_merged, freeform_routes, answers_serialized, answer_fallbacks, lines_repaired, score_freeform)}

_D = "right(query_id, 1)::INT"
_POOL = "pool AS (SELECT paper_id, min_by({x: title}, row_id).x AS title FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING title IS NOT NULL)"
_ASKED = f"{_POOL}, asked AS (SELECT DISTINCT query_id, paper_id, title FROM candidates JOIN pool USING (paper_id))"
_N, _I = sql.normalized_title, sql.initialism
_PROPOSED = f"""{_ASKED}, proposed AS (SELECT query_id, paper_id, CASE length(title) % 3 WHEN 0 THEN title WHEN 1 THEN array_to_string(string_split(title, ' ')[1:greatest(1, len(string_split(title, ' ')) - 1)], ' ')
        ELSE array_to_string(string_split(title, ' ')[1:2], ' ') || ' entirely different contents here follow now' END AS title FROM asked),
    exact AS (SELECT DISTINCT x.title, p.paper_id FROM proposed x JOIN pool p ON {_N('x.title')} = {_N('p.title')}),
    alike AS (SELECT x.title, min(p.paper_id) AS paper_id FROM (SELECT DISTINCT title FROM proposed) x JOIN pool p ON array_to_string(string_split(lower(x.title), ' ')[1:2], ' ') = array_to_string(string_split(lower(p.title), ' ')[1:2], ' ') GROUP BY x.title)"""
_SAID = "CASE {0}" + "".join(f" WHEN {k} THEN {v}" for k, v in enumerate(("0.75", "0.9", "1.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0", "0.0"))) + " END"
SQL = {
    # What each plan must come to, written out.
    "plan_parsed": rf"""WITH q AS (SELECT query_id, {_D} AS d, coalesce(question, '') AS question FROM questions),
        w AS (SELECT *, CASE WHEN regexp_matches(question, '(?i)\bwhich\b[^.?!]*\bpapers\b|\bpapers\b[^.?!]*\b(that|cite|which)\b|\ball\b[^.?!]*\bpapers\b|\bcompare\b') THEN 'multi' ELSE 'single' END AS word FROM q)
        SELECT query_id, CASE d WHEN 0 THEN 'Ormil' END AS venue, CASE d WHEN 0 THEN 2023 WHEN 1 THEN 2022 END AS year, CASE d WHEN 0 THEN 'table' END AS source_type,
            CASE d WHEN 0 THEN 'about maps' ELSE question END AS description, CASE d WHEN 0 THEN 'A,B' ELSE '' END AS named_methods,
            CASE d WHEN 0 THEN 'name,baseline,property,knn' WHEN 1 THEN 'property,knn,citation' WHEN 9 THEN 'property,name,knn' WHEN 2 THEN 'name,knn' WHEN 7 THEN 'name,knn' WHEN 8 THEN 'name,knn' ELSE 'name,property,knn' END AS strategies,
            CASE d WHEN 0 THEN 'multi' WHEN 1 THEN 'single' WHEN 4 THEN 'multi' WHEN 6 THEN 'multi' ELSE word END AS multiplicity,
            CASE d WHEN 0 THEN 'K1:t1:target;t3:t3:evidence_anchor' ELSE '' END AS targets, CASE d WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 6 THEN 2 END AS desired, d NOT IN (2, 7, 8) AS planned FROM w""",
    "seed_exact": f"""WITH {_ASKED}, k AS (SELECT {_N('title')} AS key, 'title' AS kind, paper_id FROM pool UNION ALL SELECT {_I('title')}, 'acronym', paper_id FROM pool WHERE length({_I('title')}) BETWEEN 2 AND 8),
        n AS (SELECT DISTINCT query_id, CASE WHEN length(title) % 2 = 0 THEN {_N('title')} ELSE {_I('title')} END AS key, CASE WHEN length(title) % 2 = 0 THEN 'title' ELSE 'acronym' END AS kind FROM asked),
        m AS (SELECT DISTINCT query_id, kind, key, k.paper_id FROM n JOIN k USING (key, kind)), c AS (SELECT *, count(*) OVER (PARTITION BY query_id, kind, key) AS n FROM m),
        b AS (SELECT query_id, paper_id, max(CASE kind WHEN 'title' THEN 1.0 ELSE 0.8 END)::DOUBLE AS score FROM c WHERE kind = 'title' OR n <= 25 GROUP BY ALL)
        SELECT query_id, paper_id, score, 'exact' AS route, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM b""",
    "seed_dense": """SELECT query_id, paper_id, round(0.6::DOUBLE * 61 / (60 + rank), 9) AS score, 'dense' AS route, rank FROM (SELECT query_id, paper_id, min(s.rank) + 1 AS rank FROM (SELECT query_id, paper_id, unnest(route_signals) AS s FROM candidates WHERE paper_id IS NOT NULL) WHERE s.route = 'dense' GROUP BY ALL)""",
    "seed_proposed": f"""WITH {_PROPOSED}, w AS (SELECT query_id, e.paper_id, 0.9::DOUBLE AS score FROM proposed JOIN exact e USING (title)),
        r AS (SELECT p.query_id, a.paper_id, list_distinct({sql.terms('p.title')}) AS x, list_distinct({sql.terms('o.title')}) AS y FROM proposed p JOIN alike a USING (title) JOIN pool o ON o.paper_id = a.paper_id WHERE p.title NOT IN (SELECT title FROM exact)),
        u AS (SELECT query_id, paper_id, 0.5::DOUBLE AS score FROM r WHERE len(list_intersect(x, y)) >= 0.5 * len(list_distinct(list_concat(x, y))) AND len(x) + len(y) > 0)
        SELECT query_id, paper_id, max(score) AS score FROM (SELECT * FROM w UNION ALL SELECT * FROM u) GROUP BY ALL""",
    "name_resolution": f"""WITH {_PROPOSED}, n AS (SELECT DISTINCT query_id, title AS name FROM proposed)
        SELECT query_id, name, paper_id, 0 AS step FROM n JOIN exact ON exact.title = name UNION ALL SELECT query_id, name, paper_id, 1 FROM n JOIN alike ON alike.title = name WHERE name NOT IN (SELECT title FROM exact)""",
    "seed_confirmations": f"SELECT DISTINCT query_id, paper_id, {_D} IN (0, 2, 4, 8, 9) AS confirmed, ({_SAID.format(_D)})::DOUBLE AS confidence FROM candidates WHERE paper_id IS NOT NULL",
    "first_wins": "SELECT query_id, min(row_id) AS row_id, min_by({p: paper_id}, row_id).p AS paper_id FROM candidates GROUP BY query_id",
    "better_attempts": "WITH a AS (SELECT query_id, row_id % 5 AS attempt, (row_id % 4)::DOUBLE / 4 AS confidence FROM candidates) SELECT query_id, attempt, confidence FROM (SELECT DISTINCT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, attempt) AS n FROM a) WHERE n = 1",
    "override_papers": f"""WITH r AS (SELECT query_id, paper_id, min(row_id) AS place FROM candidates WHERE paper_id IS NOT NULL GROUP BY ALL), o AS (SELECT * FROM r WHERE query_id < 'q0200' AND place % 3 = 0),
        t AS (SELECT query_id FROM o GROUP BY query_id HAVING {_D} <= 2 OR count(*) <= {_D})
        SELECT * FROM r WHERE query_id NOT IN (SELECT query_id FROM t) UNION ALL SELECT * FROM o WHERE query_id IN (SELECT query_id FROM t)""",
    "answers_merged": f"""WITH p AS (SELECT query_id, answer_type, ({_D} + length(answer_type) % 5)::DOUBLE / 10 AS confidence FROM (SELECT query_id, unnest(answer_types) AS answer_type FROM questions)),
        e AS (SELECT query_id, CASE row_id % 2 WHEN 0 THEN 'freeform' ELSE 'table' END AS answer_type, paper_id, unnest(support) AS s FROM candidates WHERE paper_id IS NOT NULL),
        k AS (SELECT query_id, count(DISTINCT concat_ws('|', paper_id, s.source_type, s.page, coalesce(s.object_id, ''))) AS n FROM e SEMI JOIN p USING (query_id, answer_type) WHERE s.page >= 1 AND s.source_type IN ('text_span', 'table', 'figure', 'equation_algorithm', 'citation_context') GROUP BY query_id)
        SELECT query_id, array_to_string(list_sort(list(DISTINCT answer_type)), ',') AS types, max(confidence) AS confidence, CASE WHEN max(confidence) >= 0.5 THEN coalesce(any_value(n), 0) ELSE 0 END AS evidence FROM p LEFT JOIN k USING (query_id) GROUP BY query_id""",
    "freeform_routes": f"""SELECT query_id, CASE WHEN d = 0 THEN 'references' WHEN d <= 3 THEN 'vision' ELSE 'text' END AS route, query_id AS text, CASE WHEN d IN (0, 1, 3, 9) THEN 1.0 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT query_id, {_D} AS d FROM questions) WHERE d NOT IN (6, 7)""",
    "answers_serialized": f"""SELECT query_id, '{{' || concat_ws(',', CASE WHEN d % 2 = 0 THEN '"freeform":{{"text":"' || query_id || '"}}' END, CASE WHEN d % 3 = 0 THEN '"multiple_choice":{{"gold":"B"}}' END,
        CASE WHEN d % 5 = 0 THEN '"table":{{"rows":[{{"k":"' || query_id || '","v":"' || d || '"}}]}}' END) || '}}' AS line FROM (SELECT query_id, {_D} AS d FROM questions)""",
    "answer_fallbacks": f"""WITH q AS (SELECT query_id, {_D} AS d, coalesce(answer_types, []) AS types, list_transform(map_keys(coalesce(mc_options, MAP {{}})), lambda k: upper(trim(k))) AS labels FROM questions)
        SELECT query_id, array_to_string(list_filter(types, lambda t: NOT ((t = 'freeform' AND d BETWEEN 3 AND 8) OR (t = 'multiple_choice' AND d NOT IN (0, 3, 4, 6, 9) AND list_contains(labels, 'A')) OR (t = 'multiple_choice' AND d IN (0, 3, 6) AND list_contains(labels, 'Z')) OR (t = 'table' AND d IN (1, 3, 7)))), ',') AS fallbacks FROM q""",
    "lines_repaired": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id) AS n FROM candidates), g AS (SELECT * FROM f WHERE n = 1)
        SELECT q.query_id, CASE WHEN g.query_id IS NULL THEN '' WHEN trim(paper_id, ' ') IS NULL OR trim(paper_id, ' ') = '' THEN q.query_id WHEN trim(paper_id, ' ') = lower(trim(paper_id, ' ')) THEN trim(paper_id, ' ') || ',' || q.query_id ELSE trim(paper_id, ' ') || ',' || lower(trim(paper_id, ' ')) || ',' || q.query_id END AS papers,
            coalesce(len(list_filter(support, lambda s: s.page > 5 AND s.source_type IN ('text_span', 'table', 'figure', 'equation_algorithm', 'citation_context'))), 0)::INT AS evidence, g.query_id IS NULL AS failed
        FROM questions q LEFT JOIN g USING (query_id)""",
    "score_freeform": f"SELECT count(*) AS n, round(avg(CASE WHEN {_D} IN (0, 3, 6, 9) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM questions",
}
