"""Queries on names of works and relations between papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import cut
from ..operators import entities as N
from ..sources.pool import load_pool
from ..sources.tables import table
from . import sql


def _pool(spark: SparkSession, folder: str) -> DataFrame:
    return load_pool(table(spark, folder, "papers"))


def _options(spark: SparkSession, folder: str) -> DataFrame:
    """All options of multiple-choice questions, as names to look up."""
    return table(spark, folder, "questions").select(F.explode(F.map_values("mc_options")).alias("name")).distinct()


def pool_first(spark: SparkSession, folder: str) -> DataFrame:
    return _pool(spark, folder).select("paper_id", "row_id", "title", "abstract", "venue", "year", F.size("authors").alias("n_authors"))


def title_index(spark: SparkSession, folder: str) -> DataFrame:
    return N.title_keys(_pool(spark, folder))


def title_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Papers by the heads of captions' last words and by titles in other spelling."""
    pool = _pool(spark, folder).where("title is not null")
    heads = pool.select(F.upper(F.substring_index("title", ":", 1)).alias("name"))
    return N.lookup_titles(heads.unionByName(_options(spark, folder)), "name", N.title_keys(pool))


def acronym_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder)
    keys = N.title_keys(pool)
    return N.lookup_acronyms(keys.where("kind = 'acronym'").select(F.lower("key").alias("name")), "name", keys)


def initials_match(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases made of initials against the right names and against those of the next part."""
    part = table(spark, folder, "part").select("p_partkey", "p_name")
    initials = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.left(w, F.lit(1))), ""))
    alias = part.select(F.col("p_partkey").alias("k"), initials.alias("alias"))
    pairs = part.join(alias, F.col("p_partkey") == F.col("k")).unionByName(part.join(alias, F.col("p_partkey") == F.col("k") + 1))
    return pairs.select("p_partkey", "k", "alias", F.concat(F.lit("the "), "p_name", F.lit(" of more")).alias("expansion")).select("p_partkey", "k", "alias", N.initials_match(F.col("alias"), F.regexp_replace("expansion", " ", "-")).alias("matches"))


def alias_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases in brackets after the part names that they stand for."""
    part = table(spark, folder, "part")
    initials = F.upper(F.array_join(F.transform(F.split("p_name", " "), lambda w: F.left(w, F.lit(1))), ""))
    text = F.concat(F.lit("It was seen before: a "), "p_name", F.lit(" ("), initials, F.lit(") again."))
    return N.defined_aliases(part.select("p_partkey", text.alias("text")), ["p_partkey"], "text")


def recurring_names(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("paper_id is not null")
    return N.recurring_names(docs, "paper_id", "text")


def alias_scope(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder)
    return N.alias_scope(N.title_aliases(pool), pool.agg(F.count("*").alias("n")))


def alias_resolve(spark: SparkSession, folder: str) -> DataFrame:
    pool = _pool(spark, folder)
    aliases = N.title_aliases(pool)
    asked = aliases.select(F.lower("alias").alias("name")).distinct()
    return N.resolve_aliases(asked, "name", aliases, N.alias_scope(aliases, pool.agg(F.count("*").alias("n"))))


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    captions = table(spark, folder, "objects").where("source_type = 'table' and paper_id is not null").select("paper_id", "page", "caption")
    pages = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", "page", "section_kind", "text")
    return N.mentions(captions, pages)


def paper_mentions(spark: SparkSession, folder: str) -> DataFrame:
    return _mentions(spark, folder)


def _relations(spark: SparkSession, folder: str) -> DataFrame:
    found = cut(_mentions(spark, folder))
    return N.relations(found, N.resolve_mentions(found, _pool(spark, folder)))


def resolver_cascade(spark: SparkSession, folder: str) -> DataFrame:
    return N.resolve_mentions(_mentions(spark, folder), _pool(spark, folder))


def paper_relations(spark: SparkSession, folder: str) -> DataFrame:
    return _relations(spark, folder)


def relations_forward(spark: SparkSession, folder: str) -> DataFrame:
    out = N.neighbours_of(_relations(spark, folder), "source_paper_id", "target_paper_id")
    return out.withColumn("neighbours", F.array_join("neighbours", ","))


def relations_reverse(spark: SparkSession, folder: str) -> DataFrame:
    out = N.neighbours_of(_relations(spark, folder), "target_paper_id", "source_paper_id")
    return out.withColumn("neighbours", F.array_join("neighbours", ","))


def _coining(spark: SparkSession, folder: str) -> DataFrame:
    k, name = F.col("p_partkey") % 6, F.initcap("p_brand")
    name = F.regexp_replace(name, "#", "")
    said = F.when(k == 0, F.concat(F.lit("so we call it "), name, F.lit(" here"))).when(k == 1, F.concat(F.lit("It is dubbed "), name, F.lit("."))).when(k == 2, F.concat(F.lit("we refer to this method as "), name)).when(k == 3, F.concat(F.lit("we call. "), name)).when(k == 4, F.concat(F.lit("denoted as plain "), name)).otherwise(F.concat(F.lit("we Term our model "), F.lower(name)))
    return table(spark, folder, "part").select("p_partkey", said.alias("text"), name.alias("name"))


def aliases_coined(spark: SparkSession, folder: str) -> DataFrame:
    return N.coined_aliases(_coining(spark, folder), ["p_partkey"], "text")


def names_cued(spark: SparkSession, folder: str) -> DataFrame:
    """Mixed-case names that a paper's texts have three times, near a cue or a word of its title."""
    docs = table(spark, folder, "documents").where("paper_id is not null")
    return N.cued_names(N.recurring_names(docs, "paper_id", "text"), docs, "paper_id", "text", _pool(spark, folder).select("paper_id", "title"))


def _hits(spark: SparkSession, folder: str) -> DataFrame:
    """Aliases of lines' parts: an order is a paper; every fourth expansion doesn't fit."""
    part = table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    rows = table(spark, folder, "lineitem").join(part, "l_partkey")
    initials = F.array_join(F.transform(F.split("p_name", " "), lambda w: F.upper(F.left(w, F.lit(1)))), "")
    k = F.col("l_linenumber") % 4
    return rows.select(F.col("l_orderkey").cast("string").alias("paper_id"), initials.alias("alias"), F.when(k == 0, "unrelated").when(k == 1, "").when(k == 2, F.upper("p_name")).otherwise(F.col("p_name")).alias("expansion"), F.col("l_linenumber").alias("page"), F.when(k == 1, "body_coinage").otherwise("body_definition").alias("source"), F.repeat(F.lit("x"), F.col("l_linenumber")).alias("support"), F.when(k == 1, 0.6).otherwise(0.9).alias("confidence"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("seq"))


def aliases_collected(spark: SparkSession, folder: str) -> DataFrame:
    return N.collected_aliases(_hits(spark, folder)).select("paper_id", "alias_key", "source", "alias", "expansion", "page", "support", "confidence")


def aliases_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return N.alias_evidence(N.collected_aliases(_hits(spark, folder)))


QUERIES = {f.__name__: f for f in (aliases_coined, names_cued, aliases_collected, aliases_evidence, pool_first, title_index, title_lookup, acronym_lookup, initials_match, alias_definitions, recurring_names, alias_scope, alias_resolve, paper_mentions, resolver_cascade, paper_relations, relations_forward, relations_reverse)}

_NO = ", ".join(f"'{w}'" for w in N.NO_METHODS)
_POOL = "pool AS (SELECT paper_id, min_by(p, row_id) AS r FROM papers p WHERE paper_id IS NOT NULL GROUP BY paper_id), titles AS (SELECT paper_id, r.title AS title, coalesce(r.abstract, '') AS abstract FROM pool)"
_HEAD = f"CASE WHEN contains({{0}}, ':') THEN {sql.squashed('string_split({0}, chr(58))[1]')} END"
_KEYS = f"""keys AS (SELECT DISTINCT paper_id, kind, key FROM (
        SELECT paper_id, 'title' AS kind, {sql.normalized_title('title')} AS key FROM titles
        UNION ALL SELECT paper_id, 'squash', {sql.squashed('title')} FROM titles
        UNION ALL SELECT paper_id, 'squash', {_HEAD.format('title')} FROM titles
        UNION ALL SELECT paper_id, 'acronym', k FROM (SELECT paper_id, {sql.initialism('title')} AS k FROM titles) WHERE length(k) BETWEEN 2 AND 8)
    WHERE key <> '')"""
_ALIASES = f"""aliases AS (SELECT DISTINCT paper_id, w AS alias, {sql.alias_key('w')} AS alias_key FROM (SELECT paper_id, regexp_replace(unnest(string_split_regex(coalesce(title, ''), '\\s+')), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g') AS w FROM titles) WHERE regexp_matches(w, '^[A-Z]') AND length(w) >= 2),
    scopes AS (SELECT alias_key, count(DISTINCT paper_id) AS df, CASE WHEN count(DISTINCT paper_id) > greatest(3.0, 0.02 * (SELECT count(*) FROM titles)) THEN 'generic' ELSE 'paper_specific' END AS scope FROM aliases WHERE alias_key <> '' GROUP BY alias_key)"""
_TOKENS = f"list_filter(list_transform(regexp_extract_all(support_text, '[A-Za-z][A-Za-z0-9]*(?:-[A-Za-z0-9]+)*'), lambda t: regexp_replace(t, '(?:-(?:{'|'.join(N.PHRASE_ENDINGS)}))+$', '')), lambda t: length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 2 AND length({sql.alias_key('t')}) >= 3 AND {sql.alias_key('t')} NOT IN ({_NO}))"
_MENTIONS = f"""said AS (SELECT paper_id, page, section_kind, trim(unnest(string_split(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '([.?!;:])\\s+', '\\1' || chr(1), 'g'), chr(1))), ' ') AS support_text FROM documents WHERE paper_id IS NOT NULL),
    support AS (SELECT paper_id, page, 'table' AS source_type, caption AS support_text, 0 AS o FROM objects WHERE source_type = 'table' AND paper_id IS NOT NULL AND caption IS NOT NULL
        UNION ALL SELECT paper_id, page, CASE WHEN section_kind = 'related_work' THEN 'related_work' ELSE 'body' END, support_text, CASE WHEN section_kind = 'related_work' THEN 1 ELSE 2 END FROM said
        WHERE coalesce(section_kind = 'related_work', FALSE) OR regexp_matches(support_text, '{N.COMPARES}')),
    named AS (SELECT *, unnest({_TOKENS}) AS mention FROM support),
    found AS (SELECT paper_id, {sql.alias_key('mention')} AS mention_key, min({{o: o, p: coalesce(page, 2147483647), s: encode(support_text), m: encode(mention), t: source_type, g: page}}) AS b FROM named GROUP BY ALL),
    mentions AS (SELECT paper_id, mention_key, decode(b.m) AS mention, b.t AS source_type, b.g AS page, decode(b.s) AS support_text FROM found)"""
_RESOLVE = f"""{_POOL}, {_KEYS}, {_ALIASES}, {_MENTIONS}, names AS (SELECT DISTINCT mention FROM mentions),
    by_title AS (SELECT mention, min(paper_id) AS target FROM names JOIN keys ON (kind = 'title' AND key = {sql.normalized_title('mention')}) OR (kind = 'squash' AND key = {sql.squashed('mention')}) GROUP BY mention),
    met AS (SELECT DISTINCT mention, paper_id, scope, df FROM names JOIN aliases a ON a.alias_key = {sql.alias_key('mention')} JOIN scopes s ON s.alias_key = a.alias_key),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY scope = 'generic', df, paper_id) AS rank, count(*) OVER (PARTITION BY mention) AS n FROM met),
    by_alias AS (SELECT mention, paper_id AS target FROM ranked WHERE rank = 1 AND n <= 3),
    rest AS (SELECT mention FROM names WHERE mention NOT IN (SELECT mention FROM by_title) AND mention NOT IN (SELECT mention FROM by_alias) AND (length({sql.alias_key('mention')}) >= 5 OR regexp_matches(mention, '[0-9-]'))),
    {sql.bm25('SELECT mention AS query, mention AS text FROM rest', "SELECT paper_id AS doc, concat_ws(' ', title, abstract) AS text FROM titles")},
    near AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored),
    by_words AS (SELECT query AS mention, min_by(doc, rank) AS target FROM near JOIN titles ON doc = paper_id WHERE rank <= 5 AND list_contains(list_transform(string_split_regex(coalesce(title, ''), '\\s+'), lambda w: {sql.alias_key('w')}), {sql.alias_key('query')}) GROUP BY query),
    resolved AS (SELECT mention, target, 0.95::DOUBLE AS confidence, 'title' AS how FROM by_title
        UNION ALL SELECT mention, target, 0.85, 'alias' FROM by_alias WHERE mention NOT IN (SELECT mention FROM by_title)
        UNION ALL SELECT mention, target, 0.6, 'words' FROM by_words),
    edges AS (SELECT paper_id || ':compares_against:' || (row_number() OVER (PARTITION BY paper_id ORDER BY mention_key) - 1) AS relation_id, paper_id AS source_paper_id, CASE WHEN target <> paper_id THEN target END AS target_paper_id, mention, source_type,
        CASE WHEN target <> paper_id THEN confidence ELSE 0 END AS confidence, CASE WHEN target <> paper_id THEN 'resolved' ELSE 'nil' END AS resolution_status FROM mentions LEFT JOIN resolved USING (mention))"""
_ENDS = "f AS (SELECT {a}, {b}, min(relation_id) AS first FROM edges WHERE target_paper_id IS NOT NULL GROUP BY ALL) SELECT {a}, count(*) AS n, string_agg({b}, ',' ORDER BY first, {b}) AS neighbours FROM f GROUP BY {a}"
_INITIALS = "upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), ''))"
SQL = {
    "pool_first": "SELECT paper_id, min(row_id) AS row_id, min_by({x: title}, row_id).x AS title, coalesce(min_by({x: abstract}, row_id).x, '') AS abstract, lower(min_by({x: venue}, row_id).x) AS venue, min_by({x: year}, row_id).x AS year, coalesce(len(min_by({x: authors}, row_id).x), 0) AS n_authors FROM papers WHERE paper_id IS NOT NULL GROUP BY paper_id",
    "title_index": f"WITH {_POOL}, {_KEYS} SELECT paper_id, kind, key FROM keys",
    "title_lookup": f"""WITH {_POOL}, {_KEYS}, names AS (SELECT DISTINCT name FROM (SELECT upper(string_split(title, ':')[1]) AS name FROM titles WHERE title IS NOT NULL UNION ALL SELECT unnest(map_values(mc_options)) FROM questions))
        SELECT DISTINCT name, paper_id FROM names JOIN keys ON (kind = 'title' AND key = {sql.normalized_title('name')}) OR (kind = 'squash' AND key IN ({sql.squashed('name')}, {_HEAD.format('name')}))""",
    "acronym_lookup": f"WITH {_POOL}, {_KEYS} SELECT DISTINCT lower(a.key) AS name, b.paper_id FROM keys a JOIN keys b ON a.kind = 'acronym' AND b.kind = 'acronym' AND upper(lower(a.key)) = b.key",
    "initials_match": f"""WITH a AS (SELECT p_partkey AS k, {_INITIALS} AS alias FROM part), p AS (SELECT p_partkey, k, alias, p_name FROM part JOIN a ON p_partkey = k UNION ALL SELECT p_partkey, k, alias, p_name FROM part JOIN a ON p_partkey = k + 1)
        SELECT p_partkey, k, alias, {_INITIALS} = alias AS matches FROM p""",
    "alias_definitions": f"SELECT p_partkey, {_INITIALS} AS alias, 'a ' || p_name AS expansion FROM part",
    "aliases_coined": "SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN replace(p_brand, '#', '') ELSE replace(p_brand, '#', '') END AS alias FROM part WHERE p_partkey % 6 IN (0, 1, 2)",
    "names_cued": rf"""WITH d AS (SELECT paper_id, text FROM documents WHERE paper_id IS NOT NULL), t AS (SELECT paper_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')) AS alias FROM d),
        r AS (SELECT paper_id, alias, count(*) AS n FROM t WHERE regexp_matches(alias, '[a-z]') AND regexp_matches(alias, '[A-Z]') GROUP BY ALL HAVING count(*) >= 3),
        p AS (SELECT paper_id, list_filter(regexp_extract_all(lower(coalesce(min_by({{x: title}}, row_id).x, '')), '[a-z]+'), lambda w: length(w) > 3) AS own FROM papers GROUP BY paper_id),
        c AS (SELECT r.*, list_concat(coalesce(own, []), string_split('{' '.join(N.METHOD_CUES)}', ' ')) AS cues, coalesce(own, []) AS own FROM r LEFT JOIN p USING (paper_id)),
        x AS (SELECT c.*, string_split_regex(text, '\b' || alias || '\b') AS s FROM c JOIN d USING (paper_id) WHERE contains(text, alias)),
        y AS (SELECT * EXCLUDE (s), list_transform(range(1, len(s)), lambda i: s[i][-50:] || ' | ' || s[i + 1][:50]) AS around FROM x)
        SELECT DISTINCT paper_id, alias, n FROM y WHERE list_contains(own, lower(alias)) OR list_has_any(flatten(list_transform(around, lambda a: regexp_extract_all(lower(a), '[a-z]+'))), cues)""",
    "aliases_collected": """WITH h AS (SELECT l_orderkey::VARCHAR AS paper_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS alias, CASE l_linenumber % 4 WHEN 1 THEN '' WHEN 2 THEN upper(p_name) ELSE p_name END AS expansion, l_linenumber AS page, CASE l_linenumber % 4 WHEN 1 THEN 'body_coinage' ELSE 'body_definition' END AS source,
            repeat('x', l_linenumber) AS support, CASE l_linenumber % 4 WHEN 1 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, row_number() OVER (ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seq FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 4 <> 0)
        SELECT paper_id, alias AS alias_key, source, alias, arg_min(expansion, seq) AS expansion, arg_min(page, seq) AS page, arg_min(support, seq) AS support, arg_min(confidence, seq) AS confidence FROM h GROUP BY paper_id, alias, source, lower(expansion)""",
    "aliases_evidence": """WITH h AS (SELECT l_orderkey::VARCHAR AS paper_id, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS alias, lower(p_name) AS e, l_linenumber AS page, l_linenumber % 4 = 1 AS coined FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber % 4 <> 0),
        k AS (SELECT paper_id, alias, coined, CASE WHEN coined THEN '' ELSE e END AS e, min(page) AS page FROM h GROUP BY ALL)
        SELECT paper_id, alias AS alias_key, CASE WHEN bool_and(coined) THEN 'body_coinage' ELSE 'body_definition' END AS source, repeat('x', CASE WHEN bool_and(coined) THEN max(page) ELSE max(page) FILTER (NOT coined) END) AS support, CASE WHEN bool_and(coined) THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence FROM k GROUP BY ALL""",
    "recurring_names": "WITH t AS (SELECT paper_id, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9]*')) AS alias FROM documents WHERE paper_id IS NOT NULL) SELECT paper_id, alias, count(*) AS n FROM t WHERE regexp_matches(alias, '[a-z]') AND regexp_matches(alias, '[A-Z]') GROUP BY ALL HAVING count(*) >= 3",
    "alias_scope": f"WITH {_POOL}, {_ALIASES} SELECT alias_key, df, scope FROM scopes",
    "alias_resolve": f"""WITH {_POOL}, {_ALIASES}, names AS (SELECT DISTINCT lower(alias) AS name FROM aliases), met AS (SELECT DISTINCT name, paper_id, scope, df FROM names JOIN aliases a ON a.alias_key = {sql.alias_key('name')} JOIN scopes s ON s.alias_key = a.alias_key),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY scope = 'generic', df, paper_id) AS rank FROM met) SELECT name, paper_id, scope, df, rank FROM r""",
    "paper_mentions": f"WITH {_MENTIONS} SELECT paper_id, mention_key, mention, source_type, page, support_text FROM mentions",
    "resolver_cascade": f"WITH {_RESOLVE} SELECT mention, target, confidence, how FROM resolved",
    "paper_relations": f"WITH {_RESOLVE} SELECT * FROM edges",
    "relations_forward": f"WITH {_RESOLVE}, {_ENDS.format(a='source_paper_id', b='target_paper_id')}",
    "relations_reverse": f"WITH {_RESOLVE}, {_ENDS.format(a='target_paper_id', b='source_paper_id')}",
}
