"""Queries that turn page texts into structured tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import corpus as C
from ..sources.tables import table


def _caption_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made of the captions on them, a line each."""
    rows = table(spark, folder, "objects").where("paper_id is not null and page is not null and caption is not null")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("row_id", "caption"))), lambda s: s["caption"])
    return rows.groupBy("paper_id", "page").agg(F.array_join(lines, "\n").alias("text"))


def captions(spark: SparkSession, folder: str) -> DataFrame:
    return C.captions(C.page_lines(_caption_pages(spark, folder), ["paper_id", "page"], "text")).drop("line")


def page_objects(spark: SparkSession, folder: str) -> DataFrame:
    return C.page_objects(table(spark, folder, "documents"), ["doc_id"], "text")


def sections(spark: SparkSession, folder: str) -> DataFrame:
    """Headings in documents to which their kind of section is written as a first line."""
    docs = table(spark, folder, "documents").select("doc_id", F.concat(F.coalesce(F.concat((F.col("doc_id") % 9).cast("string"), F.lit(". "), F.initcap(F.translate("section_kind", "_", " ")), F.lit("\n")), F.lit("")), "text").alias("text"))
    return C.sections(C.page_lines(docs, ["doc_id"], "text")).drop("line")


def section_asof(spark: SparkSession, folder: str) -> DataFrame:
    """The section that each object of a paper is in, by the paper's documents as headings."""
    headings = table(spark, folder, "documents").where("section_kind is not null").select("paper_id", "page", "doc_id", F.col("section_kind").alias("kind"))
    objects = table(spark, folder, "objects").where("paper_id is not null").select("row_id", "paper_id", "page")
    return C.active_section(objects, headings, "paper_id", "page", "doc_id")


def passages_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of at most 60 words, so that many pages have several."""
    return C.passages(table(spark, folder, "documents"), ["doc_id"], "text", 60)


def object_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """The tables and figures of each paper by the labels that its parser saw."""
    objects = table(spark, folder, "objects")
    asked = objects.where("paper_id is not null").select("paper_id", F.upper("scorer_visible_id").alias("visible_id")).distinct()
    return C.object_lookup(objects, asked)


def block_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", "page", "doc_id", "text")
    return C.neighbours(docs, ["paper_id", "page"], ["doc_id"], "text").drop("text")


def _bibliographies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents made of the entries that a paper's parser found, numbered anew."""
    rows = table(spark, folder, "bib_entries").where("text is not null")
    entries = F.array_sort(F.collect_list(F.struct("entry_id", F.regexp_replace("text", r"\s+", " ").alias("t"))))
    numbered = F.transform(entries, lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["t"]))
    return rows.groupBy("citing_paper_id").agg(F.concat(F.lit("Closing words.\nReferences\n"), F.array_join(numbered, "\n"), F.lit("\nAppendix\nMore.")).alias("text"))


def reference_list(spark: SparkSession, folder: str) -> DataFrame:
    return C.reference_list(_bibliographies(spark, folder), "citing_paper_id", "text")


def parse_quality(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "documents").where("paper_id is not null").select("paper_id", "text", "section_kind")
    refs = table(spark, folder, "bib_entries").groupBy(F.col("citing_paper_id").alias("paper_id")).agg(F.count("*").alias("n"))
    captions_ = table(spark, folder, "objects").groupBy("paper_id").agg(F.count("caption").alias("n"))
    return C.quality(pages, "paper_id", "text", refs, captions_, pages.where("section_kind = 'references'").select("paper_id")).withColumn("warnings", F.array_join("warnings", ","))


def acronym_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Acronyms defined in a text made of part names and their initials."""
    part = table(spark, folder, "part")
    words = F.transform(F.split("p_name", " "), lambda w: F.upper(F.left(w, F.lit(1))))
    return C.acronym_definitions(part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("We use the "), F.initcap("p_name"), F.lit(" ("), F.array_join(words, ""), F.lit(") here."))).otherwise(F.concat(F.lit("As "), F.array_join(words, ""), F.lit(", "), "p_name", F.lit(" of old, does."))).alias("text")), ["p_partkey"], "text")


QUERIES = {f.__name__: f for f in (captions, page_objects, sections, section_asof, passages_packed, object_lookup, block_neighbours, reference_list, parse_quality, acronym_definitions)}

_PAGES = "pages AS (SELECT paper_id, page, string_agg(caption, chr(10) ORDER BY row_id) AS text FROM objects WHERE paper_id IS NOT NULL AND page IS NOT NULL AND caption IS NOT NULL GROUP BY ALL)"
_LINES = "SELECT {keys}, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT {keys}, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM {source})"
_HEADING = " ".join(rf"WHEN regexp_matches(title, '(?i)^((\d+|[A-Z])(\.\d+)*\.?\s+)?({pattern})\s*[:.]?$') THEN '{kind}'" for kind, pattern in C.SECTION_KINDS.items())
_LABEL = r"(?i)^\s*((Table|Tab\.?|Figure|Fig\.?)\s*(\d+))"
_MARKERS = " + ".join(f"len(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}'))" for p in (C.NUMERIC_MARKER, *C.AUTHOR_YEAR))
SQL = {
    "captions": rf"""WITH {_PAGES}, lines AS ({_LINES.format(keys='paper_id, page', source='pages')}),
        c AS (SELECT *, CASE WHEN starts_with(lower(regexp_extract(line, '{_LABEL}', 2)), 'tab') THEN 'table' ELSE 'figure' END AS source_type FROM lines WHERE regexp_matches(line, '{_LABEL}'))
        SELECT paper_id, page, line_no, source_type, source_type || ' ' || regexp_extract(line, '{_LABEL}', 3) AS scorer_visible_id,
               trim(regexp_extract(line, '{_LABEL}', 1)) AS parser_visible_id, trim(line) AS caption FROM c""",
    "page_objects": r"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(?:^|\s)(table|tab\.|figure|fig\.)\s+((?:[A-Z]\.?)?\d+(?:\.\d+)*)')) AS m FROM documents),
        k AS (SELECT doc_id, CASE WHEN regexp_matches(m, '(?i)^\s*tab') THEN 'table' ELSE 'figure' END AS source_type, lower(regexp_extract(m, '(\S+)$', 1)) AS n FROM m)
        SELECT DISTINCT doc_id, source_type, source_type || ' ' || n AS object_id FROM k""",
    "sections": rf"""WITH docs AS (SELECT doc_id, coalesce((doc_id % 9)::VARCHAR || '. ' || list_aggregate(list_transform(string_split(section_kind, '_'), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') || chr(10), '') || text AS text FROM documents),
        lines AS ({_LINES.format(keys='doc_id', source='docs')}), t AS (SELECT doc_id, line_no, trim(line) AS title FROM lines),
        k AS (SELECT *, CASE {_HEADING} END AS kind FROM t WHERE length(title) <= 60)
        SELECT doc_id, line_no, title, kind FROM k WHERE kind IS NOT NULL""",
    "section_asof": """WITH h AS (SELECT paper_id, page, arg_max(section_kind, doc_id) AS kind FROM documents WHERE section_kind IS NOT NULL AND paper_id IS NOT NULL AND page IS NOT NULL GROUP BY ALL)
        SELECT o.row_id, o.paper_id, o.page, h.kind AS section_kind FROM objects o ASOF LEFT JOIN h ON o.paper_id = h.paper_id AND o.page >= h.page WHERE o.paper_id IS NOT NULL""",
    "object_lookup": """WITH a AS (SELECT DISTINCT paper_id, upper(scorer_visible_id) AS visible_id FROM objects WHERE paper_id IS NOT NULL)
        SELECT a.*, arg_max(o.row_id, o.row_id) AS row_id, arg_max(o.object_key, o.row_id) AS object_key, max_by(struct_pack(p := o.page), o.row_id).p AS page, max_by(struct_pack(c := o.caption), o.row_id).c AS caption
        FROM a JOIN objects o ON o.paper_id = a.paper_id AND lower(o.scorer_visible_id) = lower(a.visible_id) GROUP BY ALL""",
    "block_neighbours": """SELECT paper_id, page, doc_id, right(coalesce(lag(text) OVER w, ''), 240) AS prefix, left(coalesce(lead(text) OVER w, ''), 240) AS suffix
        FROM documents WHERE paper_id IS NOT NULL WINDOW w AS (PARTITION BY paper_id, page ORDER BY doc_id)""",
    "parse_quality": f"""WITH p AS (SELECT paper_id, count(*) AS page_count, count(*) FILTER (trim(text) = '') AS empty_pages, sum({_MARKERS}) AS markers, bool_or(coalesce(section_kind = 'references', FALSE)) AS headed FROM documents WHERE paper_id IS NOT NULL GROUP BY ALL),
        r AS (SELECT citing_paper_id AS paper_id, count(*) AS n FROM bib_entries GROUP BY ALL), c AS (SELECT paper_id, count(caption) AS n FROM objects GROUP BY ALL),
        j AS (SELECT p.*, coalesce(r.n, 0) AS n_references, coalesce(c.n, 0) AS n_captions FROM p LEFT JOIN r USING (paper_id) LEFT JOIN c USING (paper_id)),
        w AS (SELECT *, n_references = 0 AS none, page_count >= 6 AND n_references < 5 AS few, markers >= 10 AND n_references < 0.3 * markers AS low, NOT headed AND markers >= 10 AS headless FROM j)
        SELECT paper_id, page_count, markers::BIGINT AS markers, n_references, n_captions, array_to_string(list_filter([CASE WHEN none THEN 'zero_references' WHEN few THEN 'few_references_for_paper_length' END, CASE WHEN low THEN 'reference_count_low_vs_citation_markers' END, CASE WHEN headless THEN 'no_references_section_detected' END, CASE WHEN n_captions = 0 THEN 'zero_captions' END, CASE WHEN empty_pages > 0 THEN 'empty_text_pages' END], lambda x: x IS NOT NULL), ',') AS warnings,
               CASE WHEN none OR few OR low OR headless THEN 'suspicious' ELSE 'plausible' END AS reference_quality FROM w""",
    "reference_list": r"""WITH e AS (SELECT citing_paper_id, row_number() OVER (PARTITION BY citing_paper_id ORDER BY entry_id) AS index, trim(regexp_replace(text, '\s+', ' ', 'g')) AS raw, count(*) OVER (PARTITION BY citing_paper_id) AS n FROM bib_entries WHERE text IS NOT NULL)
        SELECT citing_paper_id, index, CASE WHEN n = 1 THEN '[1] ' || raw ELSE raw END AS raw FROM e""",
    "acronym_definitions": """SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1])), '') AS alias, array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN p_partkey % 2 = 0 THEN upper(w[1]) || w[2:] ELSE w END), ' ') AS expanded FROM part""",
    "passages_packed": r"""WITH RECURSIVE s AS (
            SELECT doc_id, list_filter(flatten(list_transform(string_split_regex(text, '\n\s*\n'), lambda p: string_split(regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')), '([.?!])\s+', '\1' || chr(1), 'g'), chr(1)))), lambda x: x <> '') AS l FROM documents),
        c AS (SELECT doc_id, flatten(list_transform(l, lambda x: list_transform(range(0, len(string_split(x, ' ')), 60), lambda i: array_to_string(string_split(x, ' ')[i + 1 : i + 60], ' ')))) AS l FROM s),
        u AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM c),
        v AS (SELECT doc_id, t, i, len(string_split(t, ' ')) AS n FROM u),
        g AS (SELECT doc_id, i, n, 0 AS passage_no, n AS filled FROM v WHERE i = 1
              UNION ALL SELECT v.doc_id, v.i, v.n, CASE WHEN filled + v.n > 60 THEN passage_no + 1 ELSE passage_no END, CASE WHEN filled + v.n > 60 THEN v.n ELSE filled + v.n END
              FROM g JOIN v ON v.doc_id = g.doc_id AND v.i = g.i + 1)
        SELECT doc_id, passage_no AS n, string_agg(t, ' ' ORDER BY i) AS passage FROM g JOIN (SELECT doc_id, i, t FROM v) USING (doc_id, i) GROUP BY ALL""",
}
