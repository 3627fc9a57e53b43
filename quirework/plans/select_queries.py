"""Queries that merge, filter and select candidate papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import terms, venue_of
from ..operators import select as S
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql
from .entity_queries import _POOL

#: The pool's venues, as ids spell them.
VENUES = "aldrec kovrin lumaq nimbrel ormil quintel sphira terdis vexal".split()


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    return S.merge_routes(table(spark, folder, "candidates"))


def route_merge(spark: SparkSession, folder: str) -> DataFrame:
    routes = F.transform("signals", lambda s: F.concat_ws("|", s["route"], F.coalesce(s["group_key"], F.lit("-")), s["rank"], F.coalesce(F.round(s["score"], 4).cast("decimal(18,4)").cast("string"), F.lit("-")), s["role"]))
    return _merged(spark, folder).select("query_id", "paper_id", "position", F.array_join("provenance", ",").alias("provenance"), "n_support", "relation", F.array_join(routes, ",").alias("signals"))


def question_constraint(spark: SparkSession, folder: str) -> DataFrame:
    venue, year = S.venue_constraint(F.col("asked"), VENUES)
    # The year of some is written behind the venue, of some before it; some speak of another paper first.
    last, named = F.substr("query_id", F.lit(-1)), r"(?i)\b(" + "|".join(VENUES) + r") papers"
    asked = F.when(last == "1", F.regexp_replace("question", named, "$1 2023 papers")).when(last == "2", F.regexp_replace("question", named, "2022 $1 papers")).when(last == "3", F.concat(F.lit("A Vexal paper is cited by two Ormil 2021 papers. "), F.col("question"))).otherwise(F.col("question"))
    return table(spark, folder, "questions").select("query_id", asked.alias("asked")).select("query_id", venue.alias("venue"), year.alias("year"))


def venue_year_recall_safe(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of each question within its venue and year, or all where none is."""
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    rows = rows.join(question_constraint(spark, folder), "query_id")
    return S.recall_safe(rows, "query_id", S.satisfies(F.col("paper_id"), F.col("venue"), F.col("year"))).select("query_id", "paper_id")


def _with_meta(spark: SparkSession, folder: str) -> DataFrame:
    pool = load_pool(table(spark, folder, "papers")).select("paper_id", "venue", "year")
    return _merged(spark, folder).join(pool, "paper_id", "left")


def deterministic_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates that don't surely break the venue of their question's first candidate, or the year 2022."""
    rows = _with_meta(spark, folder)
    first = rows.groupBy("query_id").agg(F.min_by(venue_of("paper_id"), "position").alias("want"))
    return S.definite_filter(rows.join(first, "query_id"), F.col("want"), F.lit(2022)).select("query_id", "paper_id", "position")


def _attested(spark: SparkSession, folder: str) -> DataFrame:
    """A value counts as grounded where the support texts hold a number."""
    support = table(spark, folder, "candidates").where("paper_id is not null").groupBy("query_id", "paper_id").agg(F.max(F.exists("support", lambda s: s["text"].rlike("[0-9]"))).alias("grounded"))
    return S.attest(_merged(spark, folder).join(support, ["query_id", "paper_id"]), F.coalesce("grounded", F.lit(False)))


def attestation_gate(spark: SparkSession, folder: str) -> DataFrame:
    return _attested(spark, folder).select("query_id", "paper_id", "reason", "confidence")


def cascade_select(spark: SparkSession, folder: str) -> DataFrame:
    return S.strongest(_attested(spark, folder))


def property_first(spark: SparkSession, folder: str) -> DataFrame:
    return S.property_first(_merged(spark, folder)).select("query_id", "paper_id", "place")


def hit_grouping(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by their best object hit in each question's candidates."""
    hits = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id")
    return S.group_hits(hits, ["query_id"], "paper_id", "row_id").select("query_id", "paper_id", "rank", F.array_join(F.transform("hits", lambda x: x.cast("string")), ",").alias("hits"))


def cardinality_cap(spark: SparkSession, folder: str) -> DataFrame:
    """As many papers as the question's answers ask for: one for choices, three for tables, else all."""
    types = F.col("answer_types")
    limit = table(spark, folder, "questions").select("query_id", F.when(F.array_contains(types, "multiple_choice"), 1).alias("one"), F.when(F.array_contains(types, "table"), 3).alias("three"))
    rows = S.property_first(_merged(spark, folder)).join(limit, "query_id", "left")
    return S.capped(rows, "place", F.col("one"), F.col("three")).select("query_id", "paper_id", "place")


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    text = F.array_join(F.transform("support", lambda s: s["text"]), " ")
    rows = table(spark, folder, "candidates").where("paper_id is not null").groupBy("query_id", "paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_id", text.alias("t")))), lambda s: s["t"]), " ").alias("evidence"))
    return _merged(spark, folder).select("query_id", "paper_id", "position").join(rows, ["query_id", "paper_id"]).join(table(spark, folder, "questions").select("query_id", "question"), "query_id")


def _constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Each question's terms, as surfaces that evidence should have."""
    return table(spark, folder, "questions").select("query_id", F.explode(F.array_distinct(terms("question"))).alias("surface"))


def constraint_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return S.constraint_coverage(_evidence(spark, folder), _constraints(spark, folder))


def answer_bearing_rescue(spark: SparkSession, folder: str) -> DataFrame:
    evidence = _evidence(spark, folder)
    return S.answer_bearing(S.constraint_coverage(evidence, _constraints(spark, folder)), evidence.where("position = 0").select("query_id", "paper_id"))


def clause_owner_margin(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases made of the titles of the questions' candidates, every third word left out."""
    pool = load_pool(table(spark, folder, "papers"))
    rows = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id").distinct()
    words = F.filter(F.array_distinct(terms("title")), lambda t, i: i % 3 != 2)
    phrases = rows.join(pool, "paper_id").select(F.concat_ws("/", "query_id", "paper_id").alias("phrase_id"), "query_id", words.alias("words")).where("size(words) > 2")
    return S.clause_owners(phrases, pool.select("paper_id", "title", "abstract"), rows)


def target_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """A paper for each of a question's groups (g0, g1, ...), by the best rank that a route gave it there."""
    s = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", "row_id", F.inline("route_signals")).where("group_key is not null")
    best = s.groupBy("query_id", "paper_id", F.substr("group_key", F.lit(2)).cast("int").alias("target")).agg(F.min("rank").alias("strength"), F.min("row_id").alias("position"))
    return S.target_coverage(best)


def seed_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds by exact, dense and lexical tiers; the parity of a paper's support stands in for a confirmation."""
    s = table(spark, folder, "candidates").where("paper_id is not null").select("query_id", "paper_id", F.inline("route_signals"))
    best = s.groupBy("query_id", "paper_id", "route").agg(F.min("rank").alias("r"))
    exact = best.where("route = 'exact'").select("query_id", "paper_id", F.lit("exact").alias("tier"), F.lit(0.8).alias("score"))
    dense = best.where("route = 'dense'").select("query_id", "paper_id", F.lit("dense").alias("tier"), (0.6 * 61 / (60 + F.col("r") + 1)).alias("score"))
    merged = _merged(spark, folder)
    confirmed = merged.select("query_id", "paper_id", F.lit(0.5).alias("confidence"), (F.col("n_support") % 2 == 1).alias("agrees"))
    named = best.where("route = 'bm25' and r < 3").select("query_id", "paper_id", F.lit(0.5).alias("score"))
    return S.fuse_tiers(exact.unionByName(dense), confirmed, 5, named).select("query_id", "paper_id", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (route_merge, question_constraint, venue_year_recall_safe, deterministic_filter, attestation_gate, cascade_select, property_first, hit_grouping, cardinality_cap, constraint_coverage, answer_bearing_rescue, clause_owner_margin, target_coverage, seed_fusion)}

_C = "c AS (SELECT * FROM candidates WHERE paper_id IS NOT NULL)"
_SIGNALS = "s AS (SELECT query_id, paper_id, row_id, unnest(route_signals) AS s, generate_subscripts(route_signals, 1) AS i FROM c)"
_BASE = f"""{_C}, {_SIGNALS},
    n AS (SELECT query_id, paper_id, name, min(row_id * 1000 + i) AS seq FROM (SELECT query_id, paper_id, row_id, unnest(provenance) AS name, generate_subscripts(provenance, 1) AS i FROM c) GROUP BY ALL),
    b AS (SELECT query_id, paper_id, min(row_id) AS first, sum(coalesce(len(support), 0))::BIGINT AS n_support, arg_min(relation_support, row_id) FILTER (relation_support IS NOT NULL) AS relation, count(provenance) AS prov FROM c GROUP BY ALL),
    merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS position FROM b)"""
_VENUE_RE = "|".join(VENUES)
_SCOPED = rf"(?i)\b({_VENUE_RE})(?:[\s-]*(20\d{{2}}))?\b[^.?!;:]{{0,80}}?\b(?:papers?|works?|studies|methods?)\b"
_BEFORE = rf"(?i)\b(20\d{{2}})[\s-]+({_VENUE_RE})\b[^.?!;:]{{0,80}}?\b(?:papers?|works?|studies|methods?)\b"
_ASKED = rf"""asked AS (SELECT query_id, coalesce(CASE right(query_id, 1) WHEN '1' THEN regexp_replace(question, '(?i)\b({_VENUE_RE}) papers', '\1 2023 papers', 'g') WHEN '2' THEN regexp_replace(question, '(?i)\b({_VENUE_RE}) papers', '2022 \1 papers', 'g') WHEN '3' THEN 'A Vexal paper is cited by two Ormil 2021 papers. ' || question ELSE question END, '') AS q FROM questions),
    named AS (SELECT query_id, q, list_distinct(list_transform(regexp_extract_all(q, '(?i)\b({_VENUE_RE})\b'), lambda v: lower(v))) AS v, list_distinct(regexp_extract_all(q, '\b(20\d{{2}})\b')) AS y FROM asked),
    places AS (SELECT query_id, strpos(q, m) AS begin, lower(regexp_extract(m, '{_SCOPED}', 1)) AS venue, nullif(regexp_extract(m, '{_SCOPED}', 2), '') AS year FROM (SELECT query_id, q, unnest(regexp_extract_all(q, '{_SCOPED}')) AS m FROM named)
        UNION ALL SELECT query_id, strpos(q, m), lower(regexp_extract(m, '{_BEFORE}', 2)), regexp_extract(m, '{_BEFORE}', 1) FROM (SELECT query_id, q, unnest(regexp_extract_all(q, '{_BEFORE}')) AS m FROM named)),
    best AS (SELECT query_id, arg_min({{v: venue, y: year}}, begin + CASE WHEN year IS NULL THEN 1000000000 ELSE 0 END) AS b FROM places GROUP BY query_id),
    wanted AS (SELECT query_id, CASE WHEN b IS NOT NULL THEN b.v WHEN len(v) = 1 THEN v[1] END AS venue, CASE WHEN b IS NOT NULL THEN b.y WHEN len(v) = 1 AND len(y) = 1 THEN y[1] END AS year FROM named LEFT JOIN best USING (query_id))"""
_ATTESTED = f"""{_BASE}, g AS (SELECT query_id, paper_id, bool_or(len(list_filter(support, lambda x: regexp_matches(x.text, '[0-9]'))) > 0) AS grounded FROM c GROUP BY ALL),
    a AS (SELECT query_id, paper_id, CASE WHEN relation IS NOT NULL THEN 'relation' WHEN grounded THEN 'value' END AS reason, CASE WHEN relation IS NOT NULL THEN 0.95::DOUBLE WHEN grounded THEN 0.9 END AS confidence FROM merged JOIN g USING (query_id, paper_id))"""
_PLACED = f"""{_BASE}, h AS (SELECT query_id, paper_id, bool_or(s.route = 'property') AS p FROM s GROUP BY ALL),
    placed AS (SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN p THEN 0 ELSE 1 END, position) AS place FROM merged LEFT JOIN h USING (query_id, paper_id))"""
_EVIDENCE = f"""{_BASE}, e AS (SELECT query_id, paper_id, string_agg(array_to_string(list_transform(support, lambda x: x.text), ' '), ' ' ORDER BY row_id) AS evidence FROM c GROUP BY ALL),
    ev AS (SELECT m.query_id, m.paper_id, position, evidence, question FROM merged m JOIN e USING (query_id, paper_id) JOIN questions USING (query_id)),
    k AS (SELECT DISTINCT query_id, unnest({sql.terms('question')}) AS surface FROM questions)"""
_COVER = "SELECT ev.query_id, ev.paper_id, ev.position, count(k.surface) AS n_constraints, count(*) FILTER (contains({e}, ' ' || k.surface || ' ')) AS matched, max(len(list_intersect({q}, {t}))) AS token_hits FROM ev LEFT JOIN {src} k ON k.query_id = ev.query_id GROUP BY ALL"
_COVERAGE = {"e": sql.sequence_text("evidence"), "q": sql.terms("question"), "t": sql.terms("evidence")}
SQL = {
    "route_merge": f"""WITH {_BASE}, g AS (SELECT query_id, paper_id, s.route AS route, s.group_key AS group_key, min(row_id * 1000 + i) AS seq, min(s.rank) AS rank, max(s.score) AS score, arg_min(s.role, row_id * 1000 + i) AS role FROM s GROUP BY ALL),
        x AS (SELECT query_id, paper_id, string_agg(concat_ws('|', route, coalesce(group_key, '-'), rank, coalesce(round(score, 4)::DECIMAL(18, 4)::VARCHAR, '-'), role), ',' ORDER BY seq) AS signals FROM g GROUP BY ALL),
        p AS (SELECT query_id, paper_id, string_agg(name, ',' ORDER BY seq) AS provenance FROM n GROUP BY ALL)
        SELECT query_id, paper_id, position, provenance, n_support, relation, signals FROM merged LEFT JOIN p USING (query_id, paper_id) LEFT JOIN x USING (query_id, paper_id)""",
    "question_constraint": f"WITH {_ASKED} SELECT query_id, venue, year FROM wanted",
    "venue_year_recall_safe": f"""WITH {_ASKED}, r AS (SELECT DISTINCT query_id, paper_id FROM candidates WHERE paper_id IS NOT NULL),
        k AS (SELECT r.*, (venue IS NULL OR regexp_extract(paper_id, '^([a-z]+)\\d{{4}}', 1) = venue) AND (year IS NULL OR regexp_extract(paper_id, '^[a-z]+(\\d{{4}})', 1) = year) AS keep FROM r JOIN wanted USING (query_id))
        SELECT query_id, paper_id FROM (SELECT *, bool_or(keep) OVER (PARTITION BY query_id) AS any_kept FROM k) WHERE keep OR NOT any_kept""",
    "deterministic_filter": f"""WITH {_BASE}, pool AS (SELECT paper_id, lower(min_by({{x: venue}}, row_id).x) AS venue, min_by({{x: year}}, row_id).x AS year FROM papers GROUP BY paper_id),
        f AS (SELECT query_id, nullif(regexp_extract(arg_min(paper_id, position), '^([a-z]+)\\d{{4}}', 1), '') AS want FROM merged GROUP BY ALL),
        has AS (SELECT DISTINCT query_id, paper_id FROM n)
        SELECT query_id, paper_id, position FROM merged LEFT JOIN pool USING (paper_id) JOIN f USING (query_id) LEFT JOIN (SELECT *, TRUE AS named FROM has) USING (query_id, paper_id)
        WHERE NOT (n_support = 0 AND named IS NULL AND relation IS NULL) AND NOT coalesce(venue <> want, FALSE) AND NOT coalesce(year <> 2022, FALSE)""",
    "attestation_gate": f"WITH {_ATTESTED} SELECT query_id, paper_id, reason, confidence FROM a",
    "cascade_select": f"WITH {_ATTESTED} SELECT query_id, paper_id, reason, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, paper_id) AS rank FROM a WHERE confidence IS NOT NULL",
    "property_first": f"WITH {_PLACED} SELECT query_id, paper_id, place FROM placed",
    "hit_grouping": "WITH h AS (SELECT query_id, paper_id, min(row_id) AS first, array_to_string(list(row_id ORDER BY row_id)[1:3], ',') AS hits FROM candidates WHERE paper_id IS NOT NULL GROUP BY ALL) SELECT query_id, paper_id, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS rank, hits FROM h",
    "cardinality_cap": f"""WITH {_PLACED} SELECT query_id, paper_id, place FROM placed LEFT JOIN questions q USING (query_id)
        WHERE coalesce(place <= coalesce(CASE WHEN list_contains(answer_types, 'multiple_choice') THEN 1 END, CASE WHEN list_contains(answer_types, 'table') THEN 3 END), TRUE)""",
    "constraint_coverage": f"WITH {_EVIDENCE} {_COVER.format(**_COVERAGE, src='k')}",
    "answer_bearing_rescue": f"""WITH {_EVIDENCE}, cov AS ({_COVER.format(**_COVERAGE, src='k')}),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, token_hits DESC, position, paper_id) AS n FROM cov) WHERE n = 1),
        own AS (SELECT * FROM cov WHERE position = 0),
        j AS (SELECT o.query_id, o.paper_id AS mine, b.paper_id AS best, coalesce(b.n_constraints >= 2 AND b.matched >= greatest(2, ceil(b.n_constraints / 2.0)) AND b.matched >= o.matched + 2 AND b.paper_id <> o.paper_id, FALSE) AS rescued FROM own o JOIN best b USING (query_id))
        SELECT query_id, CASE WHEN rescued THEN best ELSE mine END AS paper_id, rescued FROM j""",
    "clause_owner_margin": f"""WITH {_POOL}, r AS (SELECT DISTINCT query_id, paper_id FROM candidates WHERE paper_id IS NOT NULL),
        tw AS (SELECT paper_id, t, i FROM (SELECT paper_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT paper_id, {sql.terms('title')} AS l FROM titles))),
        uw AS (SELECT paper_id, t, row_number() OVER (PARTITION BY paper_id ORDER BY min(i)) - 1 AS i FROM tw GROUP BY paper_id, t),
        ph AS (SELECT r.query_id || '/' || r.paper_id AS phrase_id, r.query_id, list(t ORDER BY i) AS words FROM r JOIN uw USING (paper_id) WHERE i % 3 <> 2 GROUP BY ALL HAVING count(*) > 2),
        post AS (SELECT DISTINCT paper_id, term FROM (SELECT paper_id, unnest({sql.terms("concat_ws(' ', title, abstract)")}) AS term FROM titles)),
        tt AS (SELECT DISTINCT paper_id, t AS term FROM tw),
        hit AS (SELECT phrase_id, query_id, len(words) AS n, post.paper_id, count(tt.term) AS title_hits, count(*) AS hits FROM (SELECT *, unnest(words) AS term FROM ph) a JOIN post USING (term) LEFT JOIN tt ON tt.paper_id = post.paper_id AND tt.term = post.term GROUP BY ALL),
        sc AS (SELECT *, 3 * title_hits + hits AS score FROM hit),
        o AS (SELECT *, coalesce(lead(score) OVER w, 0) AS runner_up, row_number() OVER w AS place FROM sc WINDOW w AS (PARTITION BY phrase_id ORDER BY score DESC, paper_id))
        SELECT phrase_id, o.query_id, o.paper_id, score, runner_up FROM o JOIN r USING (query_id, paper_id) WHERE place = 1 AND hits >= greatest(3, ceil(n * 0.65)) AND (title_hits >= 2 OR hits >= 4) AND score - runner_up >= 2""",
    "target_coverage": f"""WITH RECURSIVE {_C}, {_SIGNALS}, best AS (SELECT query_id, paper_id, s.group_key[2:]::INT AS target, min(s.rank) AS strength, min(row_id) AS position FROM s WHERE s.group_key IS NOT NULL GROUP BY ALL),
        step AS (SELECT query_id, 0 AS k, [p] AS used, t AS target, p AS paper_id FROM (SELECT query_id, min(target) AS t, arg_min(paper_id, {{a: strength, b: position, c: paper_id}}) FILTER (target = mt) AS p FROM (SELECT *, min(target) OVER (PARTITION BY query_id) AS mt FROM best) GROUP BY query_id)
            UNION ALL
            SELECT query_id, k + 1, list_append(used, p), t, p FROM (
                SELECT s.query_id, s.k, s.used, b.target AS t, arg_min(b.paper_id, {{a: b.strength, b: b.position, c: b.paper_id}}) AS p, min(b.target) OVER (PARTITION BY s.query_id) AS nt
                FROM step s JOIN best b ON b.query_id = s.query_id AND b.target > s.target AND NOT list_contains(s.used, b.paper_id) GROUP BY s.query_id, s.k, s.used, b.target) WHERE t = nt)
        SELECT query_id, target, paper_id FROM step""",
    "seed_fusion": f"""WITH {_BASE}, r AS (SELECT query_id, paper_id, s.route AS route, min(s.rank) AS r FROM s GROUP BY ALL),
        tier AS (SELECT query_id, paper_id, 0.8::DOUBLE AS score FROM r WHERE route = 'exact' UNION ALL SELECT query_id, paper_id, 0.6::DOUBLE * 61 / (60 + r + 1) FROM r WHERE route = 'dense'),
        total AS (SELECT query_id, paper_id, round(sum(score), 9) AS score FROM tier GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS k FROM total),
        moved AS (SELECT k.query_id, k.paper_id, round(score + CASE WHEN k <= 5 THEN (CASE WHEN n_support % 2 = 1 THEN 0.3 ELSE -0.3 END)::DOUBLE * 0.5 ELSE 0 END, 9) AS score FROM k JOIN merged USING (query_id, paper_id)),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, paper_id) AS rank FROM moved) WHERE rank <= 5),
        missing AS (SELECT DISTINCT r.query_id, r.paper_id FROM r ANTI JOIN best USING (query_id, paper_id) WHERE route = 'bm25' AND r < 3)
        SELECT query_id, paper_id, round(score, 6) AS score, rank FROM best UNION ALL SELECT query_id, paper_id, 0.5, 5 + row_number() OVER (PARTITION BY query_id ORDER BY paper_id) FROM missing""",
}
