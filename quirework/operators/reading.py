"""Reading documents for a question: pages worth reading, windows around evidence, references, grids and printed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import flat_text
from .rank import bm25

SHORTLIST, MOST_PAGES, RADIUS, MOST_CONTEXT = 8, 12, 500, 1200
LEAST_ENTRY_OVERLAP = 0.65
# Ordinal numbers in words.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()


def shortlist(asked: DataFrame, pages: DataFrame, anchored: DataFrame, k: int = SHORTLIST, most: int = MOST_PAGES) -> DataFrame:
    """query_id, paper_id, page: of each paper asked about, the anchored pages and the k that answer best, at most `most`.

    asked: query_id, paper_id, question; pages: paper_id, page, text; anchored: query_id, paper_id, page (pages that the
    question names something on). Papers of at most k pages are read whole. Anchored pages come before others, then the
    better score, then the page. Likeness is by statistics of the paper alone.
    """
    whole = pages.where("page is not null").groupBy("paper_id", "page").agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text"))
    size = whole.groupBy("paper_id").agg(F.count("*").alias("n_pages"))
    scored = bm25(asked.select("paper_id", "query_id", "question"), "query_id", "question", whole, "page", "text", ["paper_id"])
    rows = asked.select("query_id", "paper_id").distinct().join(whole.select("paper_id", "page"), "paper_id").join(size, "paper_id")
    rows = rows.join(scored.select("paper_id", F.col("query").alias("query_id"), F.col("doc").alias("page"), "score"), ["paper_id", "query_id", "page"], "left").fillna(0.0, ["score"])
    rows = rows.join(anchored.select("query_id", "paper_id", "page", F.lit(0).alias("a")).distinct(), ["query_id", "paper_id", "page"], "left")
    by = Window.partitionBy("query_id", "paper_id")
    rows = rows.withColumn("place", F.row_number().over(by.orderBy(F.desc("score"), "page")))
    rows = rows.where((F.col("n_pages") <= k) | (F.col("place") <= k) | F.col("a").isNotNull())
    rows = rows.withColumn("order", F.row_number().over(by.orderBy(F.coalesce("a", F.lit(1)), F.desc("score"), "page")))
    return rows.where((F.col("n_pages") <= k) | (F.col("order") <= most)).select("query_id", "paper_id", "page")


def context(page: Column, anchors: list[Column], radius: int = RADIUS, most: int = MOST_CONTEXT) -> Column:
    """The page around the first anchor that it has, letter case apart, white space collapsed; empty if it has none."""
    p = F.coalesce(page, F.lit(""))
    out = F.lit("")
    for a in reversed(anchors):
        t = F.trim(F.coalesce(a, F.lit("")))
        at = F.instr(F.lower(p), F.lower(t))
        start = F.greatest(F.lit(1), at - radius)
        part = F.substring(p, start, at - start + F.length(t) + radius)
        out = F.when((t != "") & (at > 0), F.rtrim(F.left(F.trim(F.regexp_replace(part, r"\s+", " ")), F.lit(most)))).otherwise(out)
    return out


def preview(pages: DataFrame, doc: str, page: str, text: str, budget: int) -> DataFrame:
    """doc, page, preview: the first two pages of each document, as far as a budget of characters lasts."""
    first = pages.withColumn("n", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where("n <= 2")
    before = F.coalesce(F.sum(F.length(F.coalesce(text, F.lit("")))).over(Window.partitionBy(doc).orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = F.left(F.coalesce(text, F.lit("")), F.greatest(F.lit(0), F.lit(budget) - before).cast("int"))
    return first.select(doc, page, cut.alias("preview")).where("preview <> ''")


# Verbs between `references` and an author's name.
AUTHOR_VERBS = "include includes including have has with by list lists".split()


def reference_answers(questions: DataFrame, references: DataFrame) -> DataFrame:
    """question_id, answer: what reference lists say to questions about them, else no row.

    questions: question_id, doc, question; references: doc, index (from 1), raw. Known: the number of references (how many,
    or the last one's number), the number with an author, and the first author of the n-th. Questions about a section are none.
    """
    q = questions.where(F.col("question").rlike(r"(?i)\b(references?|bibliography)\b") & ~F.col("question").rlike(r"(?i)\bsection\b"))
    word = F.lower(F.regexp_extract("question", r"(?i)(\S+)\s+reference\b", 1))
    spelled = F.create_map(*[F.lit(x) for n, w in enumerate(ORDINALS, 1) for x in (w, n)])
    ordinal = F.coalesce(spelled[word], F.regexp_extract(word, r"^(\d+)(?:st|nd|rd|th)?$", 1).try_cast("int"))
    # The one or two words before `as an author`, without the verb before them.
    before = F.split(F.trim(F.lower(F.regexp_extract("question", r"(?i)((?:[\w\-]+\s+){1,2})as\s+an?\s+author", 1))), r"\s+")
    name = F.array_join(F.filter(before, lambda w: ~w.isin(AUTHOR_VERBS)), " ")
    q = q.withColumn("last", F.col("question").rlike(r"(?i)\blast\s+reference\b")).withColumn("ordinal", ordinal).withColumn("name", name).withColumn("many", F.col("question").rlike(r"(?i)\bhow many\b")).withColumn("all", F.col("question").rlike(r"(?i)\bhow many\s+references?\b"))
    bare = F.regexp_replace("raw", r"^\s*(?:\[\d+\]|\d+[.)])\s*", "")
    author = F.regexp_replace(F.trim(F.element_at(F.split(bare, r"(?i),|\band\b|\bet al\.?"), 1)), r"^[.\s]+|[.\s]+$", "")
    met = q.join(references, "doc").groupBy("question_id", "last", "ordinal", "name", "many", "all").agg(F.count("*").alias("n"), F.count_if(F.lower("raw").contains(F.col("name"))).alias("named"), F.max(F.when(F.col("index") == F.col("ordinal"), author)).alias("author"))
    answer = F.when(F.col("last"), F.col("n").cast("string")).when((F.col("name") != "") & F.col("many"), F.col("named").cast("string")).when(F.coalesce("author", F.lit("")) != "", F.col("author")).when(F.col("all"), F.col("n").cast("string"))
    return met.select("question_id", answer.alias("answer")).where("answer is not null")


def cited_entry(quotes: DataFrame, references: DataFrame) -> DataFrame:
    """quote_id, index, overlap: the one reference of a quote's document that surely is the quoted one.

    quotes: quote_id, doc, quote. Overlap is the share of the quote's words (three at least) that the entry has; it must be
    0.65 or more, and of the best entries there must be one. Entries are met through words.
    """
    words = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(t, F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    q = quotes.select("quote_id", "doc", words(F.col("quote")).alias("w")).where("size(w) >= 3")
    q = q.select("quote_id", "doc", F.size("w").alias("n"), F.explode("w").alias("word"))
    e = references.select("doc", "index", F.explode(words(F.col("raw"))).alias("word"))
    met = q.join(e, ["doc", "word"]).groupBy("quote_id", "index", "n").agg(F.count("*").alias("k")).where(F.col("k") >= LEAST_ENTRY_OVERLAP * F.col("n"))
    best = met.withColumn("place", F.rank().over(Window.partitionBy("quote_id").orderBy(F.desc("k")))).where("place = 1")
    return best.withColumn("ties", F.count("*").over(Window.partitionBy("quote_id"))).where("ties = 1").select("quote_id", "index", F.round(F.col("k") / F.col("n"), 6).alias("overlap"))


def project_grid(grids: DataFrame, columns: DataFrame) -> DataFrame:
    """grid_id, row_no, name, value: the cells of printed grids under the names of a schema.

    grids: grid_id, width, rows (array of arrays); columns: grid_id, name, position (from 0). Rows whose number of cells isn't
    the width are dropped whole, as every later cell's place is open; a missing cell is null.
    """
    rows = grids.select("grid_id", "width", F.posexplode("rows").alias("row_no", "cells")).where("cells is not null and size(cells) = width")
    return rows.join(columns, "grid_id").select("grid_id", "row_no", "name", F.get("cells", F.col("position")).alias("value"))


def printed_value(raw: Column) -> Column:
    """A printed value for comparison: superscript digits become ^n, `+/-` becomes ±, white space is collapsed."""
    t = F.coalesce(raw, F.lit(""))
    marked = F.regexp_replace(F.regexp_replace(t, r"([⁰¹²³⁴-⁹⁻]{2,})", r"^{$1}"), r"(?<![⁰¹²³⁴-⁹⁻{])([⁰¹²³⁴-⁹⁻])(?![⁰¹²³⁴-⁹⁻])", r"^$1")
    plain = F.translate(marked, "⁰¹²³⁴⁵⁶⁷⁸⁹⁻", "0123456789-")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\s*(?:\+\s*/\s*-|±)\s*", "±"), r"\s+", " "))


def admitted_additions(proposed: DataFrame, current: DataFrame, table: str, key: str, budget: DataFrame) -> DataFrame:
    """table, key, place: rows that may be added to a table: none that is another name of a row it has, as many as the budget.

    proposed: table, key, seq; current: table, key; budget: table, budget. Names of one row are equal in letters and digits,
    or share 72 % of their words, or one has all of two or more words of the other.
    """
    flat = lambda c: F.regexp_replace(flat_text(c), "[^a-z0-9]", "")
    words = lambda c: F.array_distinct(F.regexp_extract_all(flat_text(c), F.lit("([a-z0-9]+)"), 1))
    p = proposed.groupBy(table, key).agg(F.min("seq").alias("seq")).withColumn("pf", flat(F.col(key))).withColumn("pw", words(F.col(key))).where("pf <> ''")
    c = current.select(table, flat(F.col(key)).alias("cf"), words(F.col(key)).alias("cw")).distinct()
    both, union = F.size(F.array_intersect("pw", "cw")), F.size(F.array_union("pw", "cw"))
    short = F.least(F.size("pw"), F.size("cw"))
    same = (F.col("pf") == F.col("cf")) | (both >= 0.72 * union) | ((short >= 2) & (both == short))
    known = p.join(c, table).where(same).select(table, key).distinct()
    free = p.join(known, [table, key], "left_anti").withColumn("place", F.row_number().over(Window.partitionBy(table).orderBy("seq", key)))
    return free.join(budget, table).where("place <= budget").select(table, key, "place")
