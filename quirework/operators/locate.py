"""Where evidence stands: objects and passages of papers as located evidence, routes put together, requests rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .evidence import match_text

# Confidences of an object that a question names, another object, a passage, and an object that a passage names.
NAMED_OBJECT, OTHER_OBJECT, PASSAGE, OBJECT_OF_PASSAGE = 0.95, 0.82, 0.72, 0.88
RELATIONSHIPS = ["target", "evidence_anchor", "constraint", "unrelated"]
LEAST_UNRELATED, MOST_REQUEST, MOST_CLUES = 0.9, 600, 1600
KEY = ["query_id", "paper_id"]
PLACE = [*KEY, "source_type", "page", "object_id"]
_OBJECT = r"(?i)\b(table|figure|fig[.]?)\s*([0-9]+[a-z]?)?\b"


def visible_id_on_page(page: Column, object_id: Column, source_type: Column) -> Column:
    """Whether the number at the end of an id stands on the page with its label or between its brackets (`Eq. 6`, `(6)`, `[24]`)."""
    text, number = match_text(page), F.regexp_extract(match_text(object_id), r"(\d+[a-z]?)\s*$", 1)
    labels = F.when(source_type == "citation_context", r"(?:cit(?:ation)?|ref(?:erence)?)[.]?\s*[\[(]?\s*").otherwise(r"(?:eq(?:uation)?|alg(?:orithm)?)[.]?\s*[\[(]?\s*")
    left, right = (F.when(source_type == "citation_context", a).otherwise(b) for a, b in ((r"\[\s*", r"\(\s*"), (r"\s*\]", r"\s*\)")))
    return (number != "") & F.regexp_like(text, F.concat(labels, number, F.lit(r"(?![0-9a-z])|"), left, number, right))


def asked_object(question: Column) -> Column:
    """kind and number of the first table or figure that a question speaks of (the number may be null), else null."""
    q = F.coalesce(question, F.lit(""))
    kind = F.when(F.lower(F.regexp_extract(q, _OBJECT, 1)).startswith("fig"), "figure").otherwise("table")
    return F.when(q.rlike(_OBJECT), F.struct(kind.alias("kind"), F.nullif(F.lower(F.regexp_extract(q, _OBJECT, 2)), F.lit("")).alias("number")))


def required_kind(question: Column) -> Column:
    """kind and number of what a question's evidence must be: an object, else an equation, else a citation, else null."""
    q = F.coalesce(question, F.lit(""))
    other = F.when(q.rlike(r"(?i)\b(eq(?:uation)?|algorithm|formula|objective)\b"), "equation_algorithm").when(q.rlike(r"(?i)\b(cite[sd]?|citation|reference|related[ -]work|bibliograph\w*)\b"), "citation_context")
    return F.coalesce(asked_object(question), F.when(other.isNotNull(), F.struct(other.alias("kind"), F.lit(None).cast("string").alias("number"))))


def _number(object_id: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(object_id, F.lit("")), r"(?i)([0-9]+[a-z]?)\s*$", 1))


def locate_indexed(questions: DataFrame, objects: DataFrame, passages: DataFrame, page_objects: DataFrame) -> DataFrame:
    """query_id, paper_id, source_type, page, object_id, confidence, seq: what the indexes of a paper hold for a question.

    questions: query_id, question; objects: query_id, paper_id, rank, source_type, object_id, page (a paper's captions most like
    the question); passages: query_id, paper_id, rank, page, text; page_objects: paper_id, page, source_type, object_id.
    Objects come first, then the passages, and after the first passage that prints the label of an object of its page (in this
    letter case) that object. Each place counts once, where it came first. Passages without a page are none.
    """
    asked = questions.select("query_id", F.transform(F.regexp_extract_all(F.coalesce("question", F.lit("")), F.lit(_OBJECT), 0), asked_object).alias("asked"))
    named = F.exists("asked", lambda a: (a["kind"] == F.col("source_type")) & (a["number"].isNull() | (a["number"] == _number(F.col("object_id")))))
    first = objects.join(asked, "query_id").select(*KEY, "source_type", "page", "object_id", F.when(named, NAMED_OBJECT).otherwise(OTHER_OBJECT).alias("confidence"), (F.col("rank") * 2 - 1000).alias("seq"))
    text = passages.where("page is not null").withColumn("text", F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    second = text.select(*KEY, F.lit("text_span").alias("source_type"), "page", F.lit(None).cast("string").alias("object_id"), F.lit(PASSAGE).alias("confidence"), (F.col("rank") * 2).alias("seq"))
    there = page_objects.where("object_id is not null").select("paper_id", "page", "source_type", F.regexp_replace("object_id", r"\s+", " ").alias("object_id")).distinct()
    label = F.concat(F.lit(r"(?<!\w)\Q"), "object_id", F.lit(r"\E(?![\w.])"))
    met = text.join(there, ["paper_id", "page"]).where(F.col("text").contains(F.col("object_id")) & F.regexp_like("text", label))
    best = met.groupBy(*KEY).agg(F.min(F.struct("rank", "object_id", "source_type", "page")).alias("b"))
    third = best.select(*KEY, "b.source_type", "b.page", "b.object_id", F.lit(OBJECT_OF_PASSAGE).alias("confidence"), (F.col("b.rank") * 2 + 1).alias("seq"))
    return first_places(first.unionByName(second).unionByName(third))


def first_places(rows: DataFrame) -> DataFrame:
    """Located evidence (query_id, paper_id, source_type, page, object_id, confidence, seq), each place once, as it came first."""
    return rows.groupBy(*PLACE).agg(F.min_by("confidence", "seq").alias("confidence"), F.min("seq").alias("seq"))


def hybrid(questions: DataFrame, indexed: DataFrame, fallback: DataFrame) -> DataFrame:
    """Located evidence of the indexes, and of the fallback where they don't do.

    They do for a question and paper if there is some and, where the question asks for a kind, some of that kind and number; a
    table or figure without a number can't be known to be the right one. The fallback's evidence comes after.
    """
    need = questions.select("query_id", required_kind(F.col("question")).alias("need"))
    fits = (F.col("source_type") == F.col("need.kind")) & (F.col("need.number").isNull() | (F.col("need.number") == _number(F.col("object_id"))))
    vague = F.col("need.kind").isin("table", "figure") & F.col("need.number").isNull()
    met = indexed.join(need, "query_id")
    enough = met.groupBy(*KEY).agg(F.max(F.when(F.col("need").isNull(), True).otherwise(F.coalesce(fits & ~vague, F.lit(False)))).alias("enough")).where("enough").select(*KEY)
    more = fallback.join(enough, KEY, "left_anti").withColumn("seq", F.col("seq") + 1_000_000)
    return first_places(indexed.unionByName(more))


def united(first: DataFrame, second: DataFrame) -> DataFrame:
    """Located evidence of both routes, each place once; the first route's comes first."""
    return first_places(first.unionByName(second.withColumn("seq", F.col("seq") + 1_000_000)))


def targeted_requests(pairs: DataFrame, proposals: DataFrame) -> DataFrame:
    """query_id, paper_id, request: what is to be looked for in each paper; papers that surely have nothing to do with it are left out.

    pairs: query_id, paper_id, question; proposals: query_id, paper_id, relationship, request, confidence (text). A proposal of an
    unknown relationship or without a request counts for nothing: the question itself is asked.
    """
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(F.col("confidence").try_cast("double"), F.lit(0.0)), F.lit(0.0))))
    sound = proposals.where(F.col("relationship").isin(RELATIONSHIPS) & (F.trim("request") != "")).groupBy(*KEY).agg(F.min(F.struct("relationship", "request", sure.alias("sure"))).alias("p"))
    met = pairs.join(sound, KEY, "left").where(~F.coalesce((F.col("p.relationship") == "unrelated") & (F.col("p.sure") >= LEAST_UNRELATED), F.lit(False)))
    request = F.rtrim(F.left(F.trim("p.request"), F.lit(MOST_REQUEST)))
    text = F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")), F.lit("\nThis paper is: "), F.col("p.relationship"), F.lit("\nLook for: "), request)
    return met.select(*KEY, F.coalesce(text, "question").alias("request"))


def clue_queries(questions: DataFrame, answers: DataFrame, most: int = MOST_CLUES) -> DataFrame:
    """query_id, text: questions with the answers so far as clues to search by, each clue once, in order, as far as `most` characters last.

    questions: query_id, question, mc_options; answers: query_id, choice, text, rows (array of arrays of cells).
    """
    met = questions.join(answers, "query_id", "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    option = blank(F.element_at("mc_options", F.upper(F.trim("choice"))))
    rows = F.transform(F.coalesce("rows", F.array().cast("array<array<string>>")), lambda r: blank(F.array_join(F.array_compact(F.transform(r, blank)), " | ")))
    clues = F.array_distinct(F.array_compact(F.concat(F.array(option, blank(F.col("text"))), rows)))
    shown = F.rtrim(F.left(F.array_join(F.transform(clues, lambda c: F.concat(F.lit("- "), c)), "\n"), F.lit(most)))
    return met.select("query_id", F.when(F.size(clues) > 0, F.concat(F.coalesce("question", F.lit("")), F.lit("\n"), shown)).otherwise(F.col("question")).alias("text"))


def nearest_captions(boxes: DataFrame, captions: DataFrame, most_x: float = 72, most_y: float = 180) -> DataFrame:
    """doc, page, box, caption: the caption nearest to each box of its page, if it is near enough.

    boxes: doc, page, box, x0, y0, x1, y1; captions: doc, page, caption and the same. Sideways distance counts first, then
    the distance up or down, then the caption's name. Pages hold few boxes; boxes and captions meet only within a page.
    """
    c = captions.select("doc", "page", "caption", *[F.col(x).alias("c" + x) for x in ("x0", "y0", "x1", "y1")])
    aside = F.greatest(F.lit(0.0), F.greatest("x0", "cx0") - F.least("x1", "cx1"))
    above = F.least(F.abs(F.col("y0") - F.col("cy1")), F.abs(F.col("cy0") - F.col("y1")))
    best = boxes.join(c, ["doc", "page"]).groupBy("doc", "page", "box").agg(F.min(F.struct(aside.alias("x"), above.alias("y"), "caption")).alias("b"))
    return best.where((F.col("b.x") <= most_x) & (F.col("b.y") <= most_y)).select("doc", "page", "box", "b.caption")


def table_clips(tables: DataFrame, captions: DataFrame, pages: DataFrame, padding: float = 12.0) -> DataFrame:
    """doc, page, x0, y0, x1, y1: the part of each page that has the table nearest to a caption, and that caption.

    tables, captions: doc, page, seq, x0, y0, x1, y1; pages: doc, page and the same. Cost: three times the gap sideways, the gap
    up or down, and a thousandth of the distance of the centres. Boxes without an area are no tables.
    """
    side = ("x0", "y0", "x1", "y1")
    t = tables.where("x1 > x0 and y1 > y0").select("doc", "page", F.col("seq").alias("t"), *[F.col(x).alias("t" + x) for x in side])
    c = captions.select("doc", "page", F.col("seq").alias("c"), *[F.col(x).alias("c" + x) for x in side])
    gap = lambda a0, a1, b0, b1: F.greatest(F.lit(0.0), F.col(a0) - F.col(b1), F.col(b0) - F.col(a1))
    centre = F.abs(F.col("tx0") + F.col("tx1") - F.col("cx0") - F.col("cx1")) + F.abs(F.col("ty0") + F.col("ty1") - F.col("cy0") - F.col("cy1"))
    cost = F.round(3.0 * gap("tx0", "tx1", "cx0", "cx1") + gap("ty0", "ty1", "cy0", "cy1") + 0.001 * centre, 9)
    both = [*[F.least("t" + x, "c" + x).alias(x) for x in ("x0", "y0")], *[F.greatest("t" + x, "c" + x).alias(x) for x in ("x1", "y1")]]
    best = t.join(c, ["doc", "page"]).groupBy("doc", "page").agg(F.min(F.struct(cost.alias("cost"), "t", "c", *both)).alias("b"))
    p = pages.select("doc", "page", *[F.col(x).alias("p" + x) for x in side])
    low = [F.greatest(F.col("p" + x), F.col("b." + x) - padding).alias(x) for x in ("x0", "y0")]
    high = [F.least(F.col("p" + x), F.col("b." + x) + padding).alias(x) for x in ("x1", "y1")]
    return best.join(p, ["doc", "page"]).select("doc", "page", *low, *high)


def typed_lines(lines: DataFrame, doc: str, order: list[str], text: str) -> DataFrame:
    """lines with kind and object_id: what each line of a document is.

    Captions are tables and figures; numbered entries after a heading `References` or `Bibliography` are citations; algorithm lines
    and lines that end in a number in brackets are equations; all else is text.
    """
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    caption = r"(?i)^(table|tab\.?|figure|fig\.?)\s*(\d+[a-z]?)\b"
    entry, equation, algorithm = r"^(?:\[(\d+)\]|(\d+)\.)\s+\S", r"[=<>+].*\((\d+[a-z]?)\)\s*$", r"(?i)^algorithm\s+(\d+)\b"
    heading = t.rlike(r"(?i)^(?:\d+\.?\s*)?(?:references|bibliography)$")
    rows = lines.withColumn("__in", F.coalesce(F.max(heading.cast("int")).over(Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    kind = F.when(t.rlike(caption), F.when(F.lower(t).startswith("tab"), "table").otherwise("figure")).when((F.col("__in") == 1) & t.rlike(entry), "citation_context").when(t.rlike(algorithm) | t.rlike(equation), "equation_algorithm").otherwise("text_span")
    number = F.concat(F.regexp_extract(t, entry, 1), F.regexp_extract(t, entry, 2))
    label = F.when(kind == "table", F.concat(F.lit("Table "), F.regexp_extract(t, caption, 2))).when(kind == "figure", F.concat(F.lit("Figure "), F.regexp_extract(t, caption, 2))).when(kind == "citation_context", F.concat(F.lit("Citation "), number)).when(t.rlike(algorithm), F.concat(F.lit("Algorithm "), F.regexp_extract(t, algorithm, 1))).when(kind == "equation_algorithm", F.concat(F.lit("Equation "), F.regexp_extract(t, equation, 1)))
    return rows.withColumn("kind", kind).withColumn("object_id", label).drop("__in")


def entry_blocks(typed: DataFrame, doc: str, order: list[str], text: str) -> DataFrame:
    """doc, block from 0, kind, object_id, text: typed lines put together: a line that begins something begins a block, text goes on."""
    w = Window.partitionBy(doc).orderBy(*order)
    begins = (F.col("kind") != "text_span") | F.coalesce(F.lag("kind").over(w), F.lit("")).isin("", "table", "figure", "equation_algorithm")
    rows = typed.withColumn("block", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.array_sort(F.collect_list(F.struct(*order, F.trim(F.coalesce(F.col(text), F.lit(""))).alias("__t"))))
    return rows.groupBy(doc, "block").agg(F.min_by("kind", F.struct(*order)).alias("kind"), F.min_by("object_id", F.struct(*order)).alias("object_id"), F.array_join(F.transform(parts, lambda p: p["__t"]), "\n").alias("text"))


def grid_text(cells: Column) -> Column:
    """Rows of cells as text: cells between tabs, rows between line ends, decimals that were torn (`93 . 8`) put together; empty rows dropped."""
    tidy = lambda c: F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), r"(?<=\d)\s*\.\s*(?=\d)", ".")
    rows = F.transform(cells, lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), tidy))
    return F.array_join(F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, "\t")), "\n")
