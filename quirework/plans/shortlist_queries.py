"""Queries on covers, floors, orders and views of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import shortlists as S
from ..operators.rank import dense_top
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql
from .select_queries import _BASE, _merged


def _covering(spark: SparkSession, folder: str) -> DataFrame:
    """Merged candidates; `target-property` is what targets' own queries are called here, `caption` an owner's route."""
    named = lambda s: F.when(s["route"] == "target-property", "target_property").when(s["route"] == "caption", "clause_owner").otherwise(s["route"])
    return _merged(spark, folder).withColumn("signals", F.transform("signals", lambda s: s.withField("route", named(s))))


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "questions").select("query_id", F.explode(F.array(*map(F.lit, ["G1", "g2 ", "g3"]))).alias("key"))


def cover_single(spark: SparkSession, folder: str) -> DataFrame:
    return S.single_cover(_covering(spark, folder), _targets(spark, folder))


def floor_of_candidates(spark: SparkSession, folder: str) -> DataFrame:
    renamed = lambda s: s.withField("route", F.when(s["route"] == "dense", "name").otherwise(s["route"]))
    rows = _merged(spark, folder).withColumn("signals", F.transform("signals", renamed))
    return S.floor_order(rows, table(spark, folder, "questions").where("right(query_id, 1) < '5'"))


def _accepted(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder).where("n_support > 1").select("query_id", "paper_id", (F.col("n_support") % 3 / 4).alias("confidence"))


def order_gate(spark: SparkSession, folder: str) -> DataFrame:
    return S.by_policy(_merged(spark, folder), _accepted(spark, folder), "gate")


def order_rank(spark: SparkSession, folder: str) -> DataFrame:
    return S.by_policy(_merged(spark, folder), _accepted(spark, folder), "rank")


def order_reranked(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates by made-up scores; those of some questions are missing."""
    rows = _merged(spark, folder)
    scores = rows.where("right(query_id, 1) <> '3' or position <> 2").select("query_id", "paper_id", (F.length("paper_id") % 4 + F.col("n_support")).cast("double").alias("score"))
    return S.reranked(rows, scores, 5)


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", "relation_support", F.posexplode_outer("support").alias("i", "s"))
    rows = rows.groupBy("query_id", "paper_id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("row_id", "i", F.col("s.text").alias("text"))))).alias("t"), F.min_by("relation_support", F.when(F.col("relation_support").isNotNull(), F.col("row_id"))).alias("relation"))
    return rows.select("query_id", "paper_id", "relation", F.transform("t", lambda x: x["text"]).alias("texts"))


def quotes_validated(spark: SparkSession, folder: str) -> DataFrame:
    """Proposals that quote the first support, in another case, changed, too short, or not supported."""
    rows = _texts(spark, folder).where("size(texts) > 0")
    first, k = F.get("texts", F.lit(0)), F.length(F.get("texts", F.lit(0))) % 5
    quote = F.when(k == 0, F.upper(F.left(first, F.lit(30)))).when(k == 1, F.concat(first, F.lit(" more"))).when(k == 2, F.left(first, F.lit(6))).otherwise(F.concat(F.lit(" "), first))
    return S.validated(rows, rows.select("query_id", "paper_id", (k != 3).alias("supported"), quote.alias("quote")))


def texts_for_reranking(spark: SparkSession, folder: str) -> DataFrame:
    d = F.substr("query_id", F.lit(-1))
    criteria = F.create_map(F.lit("year"), d, F.lit("venue"), F.when(d < "5", "ormil"), F.lit("description"), F.lit(""), F.lit("other"), F.lit("x"))
    return S.rerank_texts(table(spark, folder, "questions").select("query_id", "question", criteria.alias("criteria")), _texts(spark, folder))


def papers_of_seeds(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null")
    some = lambda k: rows.where(F.col("row_id") % 4 == k).select("query_id", "paper_id", F.col("row_id").alias("seq"), (F.col("row_id") % 7).cast("double").alias("score"))
    return S.paper_set(some(0), some(1).unionByName(some(2)), some(3), table(spark, folder, "questions").where("right(query_id, 1) in ('1', '2', '3')"))


def targets_informative(spark: SparkSession, folder: str) -> DataFrame:
    """Captions, begins of captions and generic descriptions as targets."""
    k = F.col("row_id") % 4
    text = F.when(k == 0, F.col("caption")).when(k == 1, F.concat_ws(" ", F.lit("the second paper containing"), F.element_at(F.split("caption", " "), -1))).when(k == 2, "Each proposed method").otherwise(F.substring_index("caption", " ", 4))
    return table(spark, folder, "objects").select("row_id", S.informative(text).alias("informative"))


def targets_of_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names are the last words and heads of candidates' titles, targets whole titles."""
    pool = load_pool(table(spark, folder, "papers")).where("title is not null")
    rows = table(spark, folder, "candidates").where("paper_id is not null").groupBy("query_id", "paper_id").agg(F.min("row_id").alias("seq")).join(pool.select("paper_id", "title"), "paper_id")
    names = rows.select("query_id", F.element_at(F.split("title", " "), -1).alias("name")).unionByName(rows.select("query_id", F.concat(F.lit("the "), "title").alias("name")))
    targets = rows.where("seq % 3 <> 0").select("query_id", "seq", F.concat(F.lit("k"), "seq").alias("key"), F.col("title").alias("text"), F.when(F.col("seq") % 2 == 0, "target").otherwise("constraint").alias("role"))
    return S.target_of(names, targets)


def names_supported(spark: SparkSession, folder: str) -> DataFrame:
    pool = load_pool(table(spark, folder, "papers")).where("title is not null")
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct().join(pool.select("paper_id", "title", "year"), "paper_id")
    named = rows.select("query_id", F.element_at(F.split("title", " "), -1).alias("name"), "paper_id")
    aliases = rows.where("year % 5 = 0").select(F.element_at(F.split("title", " "), -1).alias("name"), "paper_id", F.concat(F.lit("we call it "), "title").alias("text"))
    return S.name_support(named, aliases, table(spark, folder, "documents").select("paper_id", F.col("doc_id").alias("seq"), "text"), pool.select("paper_id", "title", "abstract"))


def owners_of_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Questions that name candidates' titles as sources, rightly and otherwise."""
    pool = load_pool(table(spark, folder, "papers")).where("title is not null").select("paper_id", "title")
    first = table(spark, folder, "candidates").where("paper_id is not null").groupBy("query_id").agg(F.min("paper_id").alias("paper_id")).join(pool, "paper_id")
    d, head = F.substr("query_id", F.lit(-1)).cast("int"), F.substring_index("title", ":", 1)
    made = F.when(d < 3, F.concat(F.lit("What does it show in the "), head, F.lit("?"))).when(d < 5, F.concat(F.lit("Is "), head, F.lit(" paper right?"))).when(d < 7, F.concat(F.lit("Is it better in "), head, F.lit(" than "), head)).when(d == 7, F.lower(F.concat(F.lit("in "), head))).otherwise(F.concat(F.lit("We ask, "), head))
    return S.source_owners(first.select("query_id", made.alias("question")), pool)


def vector_strategy(spark: SparkSession, folder: str) -> DataFrame:
    """The thirty documents nearest to each query vector, with the begins of their texts as support."""
    vectors = table(spark, folder, "embeddings")
    near = dense_top(vectors.where("vec_id % 100 = 0"), "vec_id", vectors, "vec_id", "embedding", 30)
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), F.left("text", F.lit(40)).alias("support"))
    return near.join(docs, "doc", "left").select("query", "doc", (F.col("rank") - 1).alias("rank"), "support")


def candidate_dossiers(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("row_id", "query_id", "paper_id", F.col("route_signals").alias("signals"), F.transform("support", lambda s: F.struct(F.repeat(F.concat(s["text"], F.lit(" \n")), F.when(F.col("row_id") % 2 == 0, 9).otherwise(1)).alias("text"))).alias("support"))
    return S.dossiers(rows)


QUERIES = {f.__name__: f for f in (cover_single, floor_of_candidates, order_gate, order_rank, order_reranked, quotes_validated, texts_for_reranking, papers_of_seeds, targets_informative, targets_of_names, names_supported, owners_of_sources, vector_strategy, candidate_dossiers)}

_LOW = lambda t: rf"lower(trim(regexp_replace(replace(regexp_replace(coalesce({t}, ''), '-\s*\n\s*', '', 'g'), chr(173), ''), '\s+', ' ', 'g'), ' '))"
_SIG = f"""{_BASE}, sig AS (SELECT query_id, paper_id, s.route AS route, s.group_key AS group_key, min(s.rank) AS rank, arg_min(s.role, row_id * 1000 + i) AS role FROM s GROUP BY ALL)"""
_TEXTS = """tx AS (SELECT query_id, paper_id, list(s.text ORDER BY row_id, i) FILTER (s IS NOT NULL) AS texts FROM (SELECT query_id, paper_id, row_id, unnest(support) AS s, generate_subscripts(support, 1) AS i FROM candidates WHERE paper_id IS NOT NULL) GROUP BY ALL)"""
_POOL = "pool AS (SELECT paper_id, min_by({x: title}, row_id).x AS title, coalesce(min_by({x: abstract}, row_id).x, '') AS abstract, min_by({x: year}, row_id).x AS year FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id HAVING title IS NOT NULL)"
_S = sql.sequence_text
SQL = {
    "cover_single": f"""WITH {_SIG}, k AS (SELECT unnest(['G1', 'g2 ', 'g3']) AS key),
        m AS (SELECT query_id, paper_id, key, min(rank) AS best, bool_or(route = 'caption' OR (route = 'target-property' AND rank <= 2)) AS ok FROM sig JOIN k ON lower(trim(group_key, ' ')) = lower(trim(key, ' ')) WHERE role = 'target' GROUP BY ALL),
        cv AS (SELECT query_id, paper_id, list(key ORDER BY key) AS covered, list(best ORDER BY key) AS ranks, count(*) AS n FROM m WHERE ok GROUP BY ALL)
        SELECT query_id, paper_id, array_to_string(covered, ',') AS covered, n FROM (SELECT cv.*, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, ranks, position, paper_id) AS place FROM cv JOIN merged USING (query_id, paper_id)) WHERE place = 1""",
    "floor_of_candidates": f"""WITH {_SIG}, o AS (SELECT query_id, paper_id, bool_and(route IN ('name', 'dense') AND role <> 'target') AS only_named FROM sig GROUP BY ALL), h AS (SELECT query_id, paper_id, bool_or(name = 'citation') AS cit, bool_or(name = 'property') AS prop FROM n GROUP BY ALL)
        SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN right(query_id, 1) < '5' AND cit THEN 0 WHEN prop THEN 1 ELSE 2 END, position, paper_id) AS place FROM merged LEFT JOIN o USING (query_id, paper_id) LEFT JOIN h USING (query_id, paper_id) WHERE NOT coalesce(only_named, FALSE)""",
    "order_gate": f"WITH {_BASE} SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY n_support % 3 DESC, paper_id) AS place FROM merged WHERE n_support > 1",
    "order_rank": f"WITH {_BASE} SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n_support > 1 THEN n_support % 3 ELSE -1 END DESC, CASE WHEN n_support > 1 THEN paper_id END, position) AS place FROM merged",
    "order_reranked": f"""WITH {_BASE} SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN position < 5 THEN 0 ELSE 1 END, CASE WHEN position < 5 AND (right(query_id, 1) <> '3' OR lacks IS NULL) THEN length(paper_id) % 4 + n_support ELSE 0 END DESC, position) AS place
        FROM merged LEFT JOIN (SELECT query_id, TRUE AS lacks FROM merged WHERE position = 2) USING (query_id)""",
    "quotes_validated": rf"""WITH {_TEXTS}, p AS (SELECT query_id, paper_id, texts, length(texts[1]) % 5 AS k, texts[1] AS f FROM tx WHERE len(texts) > 0),
        q AS (SELECT *, {_LOW("CASE k WHEN 0 THEN upper(f[1:30]) WHEN 1 THEN f || ' more' WHEN 2 THEN f[1:6] ELSE ' ' || f END")} AS q FROM p WHERE k <> 3)
        SELECT query_id, paper_id, 'validated' AS reason, 0.8::DOUBLE AS confidence FROM q WHERE length(q) >= 10 AND len(regexp_extract_all(q, '\p{{L}}{{2,}}')) >= 2 AND len(list_filter(texts, lambda t: contains({_LOW('t')}, q))) > 0""",
    "texts_for_reranking": f"""WITH {_TEXTS}, r AS (SELECT query_id, paper_id, arg_min(relation_support, row_id) FILTER (relation_support IS NOT NULL) AS relation FROM candidates WHERE paper_id IS NOT NULL GROUP BY ALL)
        SELECT r.query_id, r.paper_id, trim(concat_ws(' ', coalesce(question, ''), concat_ws('; ', CASE WHEN right(r.query_id, 1) < '5' THEN 'venue=ormil' END, 'year=' || right(r.query_id, 1))), ' ') AS asked, coalesce(nullif(relation, ''), texts[1], '') AS text FROM r JOIN questions USING (query_id) LEFT JOIN tx ON tx.query_id = r.query_id AND tx.paper_id = r.paper_id""",
    "papers_of_seeds": """WITH c AS (SELECT query_id, paper_id, row_id, row_id % 4 AS k, right(query_id, 1) IN ('1', '2', '3') AS many FROM candidates WHERE paper_id IS NOT NULL), s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY row_id % 7 DESC, row_id) AS n FROM c WHERE k IN (1, 2)),
        u AS (SELECT query_id, paper_id, 0 AS a, row_id AS b FROM c WHERE k = 0 UNION ALL SELECT query_id, paper_id, 1, n FROM s WHERE many OR n <= 1 UNION ALL SELECT query_id, paper_id, 2, row_id FROM c WHERE k = 3 AND many),
        f AS (SELECT query_id, paper_id, min(a * 1000000000 + b) AS o FROM u GROUP BY ALL) SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY o, paper_id) AS place FROM f""",
    "targets_informative": f"""WITH t AS (SELECT row_id, CASE row_id % 4 WHEN 0 THEN caption WHEN 1 THEN 'the second paper containing' || CASE WHEN caption IS NULL THEN '' ELSE ' ' || string_split(caption, ' ')[-1] END WHEN 2 THEN 'Each proposed method' ELSE array_to_string(string_split(caption, ' ')[1:4], ' ') END AS t FROM objects),
        w AS (SELECT row_id, regexp_extract_all(lower(coalesce(t, '')), '[a-z0-9]+') AS w FROM t)
        SELECT row_id, array_to_string(w, ' ') NOT IN ('paper', 'first paper', 'second paper', 'method', 'each method', 'each proposed method', 'objective', 'result', 'study') AND len(w) >= 4 AND len(list_distinct(list_filter(w, lambda x: NOT list_contains(string_split('{' '.join(S.GENERIC_WORDS)}', ' '), x)))) >= 2 AS informative FROM w""",
    "targets_of_names": f"""WITH {_POOL}, r AS (SELECT query_id, paper_id, min(row_id) AS seq FROM candidates WHERE paper_id IS NOT NULL GROUP BY ALL), t AS (SELECT r.*, title FROM r JOIN pool USING (paper_id)),
        n AS (SELECT DISTINCT query_id, unnest([string_split(title, ' ')[-1], 'the ' || title]) AS name FROM t),
        m AS (SELECT n.query_id, name, arg_min({{k: 'k' || seq, r: CASE WHEN seq % 2 = 0 THEN 'target' ELSE 'constraint' END}}, seq) AS b FROM n JOIN t ON t.query_id = n.query_id AND seq % 3 <> 0 WHERE length({_S('name')}) > 2 AND contains({_S('title')}, {_S('name')}) OR length({_S('title')}) > 2 AND contains({_S('name')}, {_S('title')}) GROUP BY ALL)
        SELECT n.query_id, n.name, coalesce(b.k, trim(n.name, ' ')) AS key, coalesce(b.r, 'target') AS role FROM n LEFT JOIN m ON m.query_id = n.query_id AND m.name = n.name""",
    "names_supported": f"""WITH {_POOL}, r AS (SELECT DISTINCT query_id, paper_id, string_split(title, ' ')[-1] AS name, title, abstract, year FROM candidates JOIN pool USING (paper_id)),
        p AS (SELECT name, r.paper_id, min_by(text, doc_id) AS text FROM (SELECT DISTINCT name, paper_id FROM r) r JOIN documents d ON d.paper_id = r.paper_id WHERE length({_S('name')}) > 2 AND contains({_S('text')}, {_S('name')}) GROUP BY ALL)
        SELECT query_id, r.name, r.paper_id, CASE WHEN year % 5 = 0 THEN 'alias' WHEN p.text IS NOT NULL THEN 'passage' ELSE 'paper' END AS how, CASE WHEN year % 5 = 0 THEN 'we call it ' || title ELSE coalesce(p.text, trim(title || ' ' || abstract, ' ')) END AS text FROM r LEFT JOIN p ON p.name = r.name AND p.paper_id = r.paper_id""",
    "vector_strategy": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v), z AS (SELECT vec_id, CASE WHEN n > 0 THEN list_transform(v, lambda x: x / n) ELSE v END AS v FROM u),
        s AS (SELECT q.vec_id AS query, d.vec_id AS doc, round(list_dot_product(q.v, d.v), 9) AS score FROM z q JOIN z d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) - 1 AS rank FROM s)
        SELECT query, doc, rank, text[1:40] AS support FROM r LEFT JOIN documents ON doc_id = doc WHERE rank < 30""",
    "candidate_dossiers": r"""WITH c AS (SELECT row_id, query_id, paper_id, route_signals, list_transform(support[1:2], lambda s: trim(regexp_replace(coalesce(repeat(s.text || ' ' || chr(10), CASE WHEN row_id % 2 = 0 THEN 9 ELSE 1 END), ''), '\s+', ' ', 'g'), ' ')) AS t FROM candidates WHERE paper_id IS NOT NULL)
        SELECT query_id, paper_id, array_to_string(list_transform(route_signals, lambda s: s.route || ':' || s.rank), ',') AS routes, array_to_string(list_transform(t, lambda x: CASE WHEN length(x) <= 320 THEN x ELSE rtrim(x[1:319], ' ') || '…' END), chr(10)) AS supports FROM c""",
}
