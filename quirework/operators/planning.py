"""Plans of questions, seeds of papers and answer lines: what comes before and after retrieval, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import flat_text, jaccard, number_or_null, terms
from .evidence import SOURCE_TYPES

# What a plan may ask for.
STRATEGIES = ["name", "baseline", "citation", "property", "knn"]
DEFAULT_STRATEGIES, FALLBACK = ["name", "knn"], "knn"
ROLES = ["target", "evidence_anchor", "constraint"]
MOST_PAPERS = 20
# Scores of seeds by how they were found, and most papers of an acronym.
TITLE_SEED, ACRONYM_SEED, PROPOSED_SEED, ALIKE_SEED, DENSE_SEED = 1.0, 0.8, 0.9, 0.5, 0.6
MOST_OF_ACRONYM, LEAST_TITLE_OVERLAP, RRF_K = 25, 0.5, 60
PLACEHOLDER = "No answer found."

#: Proposals come as JSON; each part is read as text first, so that a part of a wrong kind spoils nothing else.
_PLAN = "criterion string, strategies string, named_methods string, targets string, multiplicity string, desired_paper_count string"


def _strings(json: Column) -> Column:
    """The strings of a JSON array that aren't blank; of anything else none. Numbers, objects and truth values are no strings."""
    quoted = F.regexp_extract_all(F.coalesce(json, F.lit("")), F.lit(r'(?:^\s*\[|\G\s*,)\s*("(?:[^"\\]|\\.)*"|[^,\[\]{}"]+|\{[^{}]*\}|\[[^\[\]]*\])'), 1)
    texts = F.transform(F.filter(quoted, lambda q: q.startswith('"')), lambda q: F.from_json(F.concat(F.lit('{"s":'), q, F.lit("}")), "s string")["s"])
    return F.filter(texts, lambda s: s.isNotNull() & (F.trim(s) != ""))


def several(question: Column) -> Column:
    """`multi` if a question asks for a set of papers by its words, else `single`."""
    pattern = r"(?i)\bwhich\b[^.?!]*\bpapers\b|\bpapers\b[^.?!]*\b(?:that|cite|which)\b|\ball\b[^.?!]*\bpapers\b|\bcompare\b"
    return F.when(F.coalesce(question, F.lit("")).rlike(pattern), "multi").otherwise("single")


def parse_plans(questions: DataFrame, proposals: DataFrame) -> DataFrame:
    """query_id, venue, year, source_type, description, named_methods, strategies, multiplicity, targets, desired, planned.

    questions: query_id, question; proposals: query_id, attempt, plan (JSON text, with or without code fences). The first
    attempt that is a JSON object counts. Every part is checked by itself: a year is a whole number or digits, source types are
    tables and figures, strategies are known ones, each once, `property` is always asked for and `knn` is the last resort;
    targets have a text and a known role, the first of each key without case; a count is from 1 to 20 and decides between
    `single` and `multi`, else the plan's word, else the question's wording. Without a usable plan nothing is constrained,
    names and vectors are asked, and planned is false.
    """
    text = F.trim(F.regexp_replace(F.col("plan"), r"^\s*```[A-Za-z]*\s*|\s*```\s*$", ""))
    usable = proposals.select("query_id", "attempt", text.alias("plan")).where(F.col("plan").rlike(r"^\{[\s\S]*\}$") & F.try_parse_json("plan").isNotNull())
    first = usable.groupBy("query_id").agg(F.min_by("plan", F.struct("attempt", "plan")).alias("plan"))
    q = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"))
    met = q.join(first, "query_id", "left").withColumn("p", F.from_json("plan", _PLAN))
    planned = F.col("plan").isNotNull()
    part = lambda name: F.get_json_object("p.criterion", f"$.{name}")
    is_text = lambda name: F.col("p.criterion").rlike(rf'"{name}"\s*:\s*"')
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    venue = F.when(is_text("venue"), blank(part("venue")))
    year = F.when(part("year").rlike(r"^\s*\d+\s*$"), F.trim(part("year")).try_cast("int"))
    kind = F.lower(F.trim(part("required_source_type")))
    kind = F.when(kind.isin("table", "figure"), kind)
    description = F.coalesce(F.when(is_text("description") & blank(part("description")).isNotNull(), part("description")), "question")
    asked = F.array_distinct(F.filter(_strings(F.col("p.strategies")), lambda s: s.isin(STRATEGIES)))
    asked = F.when(F.size(asked) == 0, F.array(*map(F.lit, DEFAULT_STRATEGIES))).otherwise(asked)
    asked = F.when(F.array_contains(asked, FALLBACK), asked).otherwise(F.array_append(asked, FALLBACK))
    at = F.array_position(asked, FALLBACK).cast("int")
    asked = F.when(~planned | F.array_contains(asked, "property"), asked).otherwise(F.array_insert(asked, at, F.lit("property")))
    targets = F.from_json("p.targets", "array<struct<key:string,text:string,role:string>>")
    sound = F.filter(targets, lambda t: (F.trim(t["text"]) != "") & F.lower(F.trim(t["role"])).isin(ROLES))
    named = F.transform(sound, lambda t: F.struct(F.trim(F.coalesce(F.when(F.trim(t["key"]) != "", t["key"]), t["text"])).alias("key"), F.trim(t["text"]).alias("text"), F.lower(F.trim(t["role"])).alias("role")))
    keys = lambda ts: F.transform(ts, lambda t: F.lower(t["key"]))
    once = F.filter(named, lambda t, i: F.array_position(keys(named), F.lower(t["key"])) == i + 1)
    count = F.when(F.col("p.desired_paper_count").rlike(r"^\s*\d+\s*$"), F.trim("p.desired_paper_count").try_cast("int"))
    count = F.when(count.between(1, MOST_PAPERS), count)
    word = F.when(F.col("p.multiplicity").isin("single", "multi"), F.col("p.multiplicity")).otherwise(several(F.col("question")))
    multiplicity = F.when(count == 1, "single").when(count > 1, "multi").otherwise(word)
    none = F.array().cast("array<struct<key:string,text:string,role:string>>")
    return met.select("query_id", venue.alias("venue"), year.alias("year"), kind.alias("source_type"), description.alias("description"), F.coalesce(_strings(F.col("p.named_methods")), F.array().cast("array<string>")).alias("named_methods"), asked.alias("strategies"), multiplicity.alias("multiplicity"), F.coalesce(once, none).alias("targets"), count.alias("desired"), planned.alias("planned"))


def exact_seeds(names: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, paper_id, score, route, rank: papers by whole titles (1.0), else by acronyms of at most 25 papers (0.8).

    names: query_id, name, kind (`title` or `acronym`, both in the form of the keys); keys: key, kind, paper_id. A paper's best
    score counts; rank is by score, then id.
    """
    met = names.select("query_id", F.col("name").alias("key"), "kind").distinct().join(keys.select("key", "kind", "paper_id").distinct(), ["key", "kind"])
    met = met.withColumn("n", F.count("*").over(Window.partitionBy("query_id", "kind", "key"))).where(f"kind = 'title' or n <= {MOST_OF_ACRONYM}")
    best = met.groupBy("query_id", "paper_id").agg(F.max(F.when(F.col("kind") == "title", TITLE_SEED).otherwise(ACRONYM_SEED)).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id"))
    return best.select("query_id", "paper_id", "score", F.lit("exact").alias("route"), rank.alias("rank"))


def dense_seeds(ranked: DataFrame) -> DataFrame:
    """ranked (query_id, paper_id, rank from 1) with score: 0.6 for the first, falling with the reciprocal of the rank."""
    return ranked.select("query_id", "paper_id", F.round(DENSE_SEED * (RRF_K + 1) / (RRF_K + F.col("rank")), 9).alias("score"), F.lit("dense").alias("route"), "rank")


def proposed_seeds(proposed: DataFrame, exact: DataFrame, alike: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, paper_id, score: papers of proposed titles: all that have the title (0.9), else the one most like it (0.5).

    proposed: query_id, title; exact: title, paper_id; alike: title, paper_id, rank; papers: paper_id, title. The most like paper
    counts only if half of the terms of both titles are in common, so that a title nobody has is not led to some paper.
    """
    asked = proposed.where("title is not null and trim(title) <> ''").select("query_id", "title").distinct()
    whole = asked.join(exact.select("title", "paper_id").distinct(), "title").select("query_id", "paper_id", F.lit(PROPOSED_SEED).alias("score"))
    rest = asked.join(exact.select("title").distinct(), "title", "left_anti").join(alike.where("rank = 1").select("title", "paper_id"), "title")
    rest = rest.join(papers.select("paper_id", F.col("title").alias("own")), "paper_id")
    rest = rest.where(jaccard(F.array_distinct(terms("title")), F.array_distinct(terms("own"))) >= LEAST_TITLE_OVERLAP).select("query_id", "paper_id", F.lit(ALIKE_SEED).alias("score"))
    return whole.unionByName(rest).groupBy("query_id", "paper_id").agg(F.max("score").alias("score"))


def first_resolution(names: DataFrame, *steps: DataFrame) -> DataFrame:
    """query_id, name, paper_id, step: the papers of the first step that knows a name. steps: name, paper_id."""
    rows = None
    for k, step in enumerate(steps):
        part = step.select("name", "paper_id", F.lit(k).alias("step")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    first = rows.groupBy("name").agg(F.min("step").alias("step"))
    return names.select("query_id", "name").distinct().join(rows.join(first, ["name", "step"]), "name").select("query_id", "name", "paper_id", "step")


def confirmations(proposals: DataFrame) -> DataFrame:
    """query_id, paper_id, confirmed, confidence: what JSON answers say; only the truth value true confirms, a confidence is
    between 0 and 1 or 0."""
    value = F.get_json_object("answer", "$.confidence")
    sure = number_or_null(F.when(~F.col("answer").rlike(r'"confidence"\s*:\s*"'), value))
    return proposals.select("query_id", "paper_id", F.coalesce(F.col("answer").rlike(r'"match"\s*:\s*true\b') & (F.get_json_object("answer", "$.match") == "true"), F.lit(False)).alias("confirmed"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.0)))).alias("confidence"))


def first_records(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the first by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")


def better_attempt(attempts: DataFrame, by: list[str]) -> DataFrame:
    """by, attempt, confidence: the most confident attempt, of equal ones the earlier: a later one must be strictly better."""
    best = attempts.groupBy(*by).agg(F.max(F.struct("confidence", (-F.col("attempt")).alias("a"))).alias("b"))
    return best.select(*by, (-F.col("b.a")).alias("attempt"), "b.confidence")


def overridden(selected: DataFrame, overrides: DataFrame, caps: DataFrame) -> DataFrame:
    """query_id, paper_id, place: an override's papers where there are any and the question's cap allows as many, else the selected.

    selected, overrides: query_id, paper_id, place; caps: query_id, cap (null: none).
    """
    n = overrides.groupBy("query_id").agg(F.count("*").alias("n")).join(caps, "query_id", "left")
    taken = n.where("cap is null or n <= cap").select("query_id")
    return selected.join(taken, "query_id", "left_anti").select("query_id", "paper_id", "place").unionByName(overrides.join(taken, "query_id", "left_semi").select("query_id", "paper_id", "place"))


def merged_answers(parts: DataFrame, evidence: DataFrame, least: float = 0.5) -> DataFrame:
    """query_id, types, confidence, evidence: the answers of a question's types together.

    parts: query_id, answer_type, confidence (a type that failed has no row); evidence: query_id, answer_type, paper_id,
    source_type, page, object_id. The best confidence counts; evidence, each place once, in order, is given only if it reaches `least`.
    """
    best = parts.groupBy("query_id").agg(F.array_sort(F.collect_set("answer_type")).alias("types"), F.max("confidence").alias("confidence"))
    place = F.concat_ws("|", "paper_id", "source_type", "page", F.coalesce("object_id", F.lit("")))
    sound = evidence.join(parts.select("query_id", "answer_type").distinct(), ["query_id", "answer_type"], "left_semi").where(F.col("source_type").isin(SOURCE_TYPES) & (F.col("page") >= 1))
    shown = sound.select("query_id", place.alias("place")).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    met = best.join(shown, "query_id", "left")
    return met.select("query_id", "types", "confidence", F.when(F.col("confidence") >= least, F.coalesce("n", F.lit(0))).otherwise(0).alias("evidence"))


def freeform_route(references: DataFrame, seen: DataFrame, read: DataFrame) -> DataFrame:
    """query_id, route, text, confidence: reference lists answer first, then what was seen, then what was read.

    Each: query_id, text, grounded. Blank texts are no answers; a grounded one has confidence 1.0, another 0.3.
    """
    rows = None
    for k, (route, part) in enumerate((("references", references), ("vision", seen), ("text", read))):
        each = part.where("trim(text) <> ''").groupBy("query_id").agg(F.min(F.struct((~F.coalesce("grounded", F.lit(False))).alias("loose"), "text")).alias("b")).select("query_id", F.lit(k).alias("k"), F.lit(route).alias("route"), "b")
        rows = each if rows is None else rows.unionByName(each)
    best = rows.groupBy("query_id").agg(F.min(F.struct("k", "route", "b")).alias("r"))
    return best.select("query_id", "r.route", "r.b.text", F.when(F.col("r.b.loose"), 0.3).otherwise(1.0).alias("confidence"))


def serialized(answers: DataFrame) -> DataFrame:
    """query_id, line: answers as one JSON object a question, with the parts that it has.

    answers: query_id, text, choice, rows (array of map of string to string); null parts are left out.
    """
    part = F.struct(F.when(F.col("text").isNotNull(), F.struct("text")).alias("freeform"), F.when(F.col("choice").isNotNull(), F.struct(F.col("choice").alias("gold"))).alias("multiple_choice"), F.when(F.col("rows").isNotNull(), F.struct("rows")).alias("table"))
    return answers.select("query_id", F.to_json(part).alias("line"))


def fallback_types(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """query_id, fallbacks: answer types of each question that have no sound answer of their own, in the question's order.

    questions: query_id, answer_types, mc_options; answers: query_id, text, choice, n_rows, choice_confidence, table_confidence.
    A choice at confidence 0.1 or less and a table at 0 are guesses. Unknown types are always fallbacks.
    """
    met = questions.join(answers, "query_id", "left")
    labels = F.transform(F.coalesce(F.map_keys("mc_options"), F.array().cast("array<string>")), lambda k: F.upper(F.trim(k)))
    chosen = F.upper(F.trim(F.coalesce("choice", F.lit(""))))
    sound = {
        "freeform": F.trim(F.coalesce("text", F.lit(""))) != "",
        "multiple_choice": (chosen != "") & F.array_contains(labels, chosen) & (F.coalesce("choice_confidence", F.lit(1.0)) > 0.1),
        "table": (F.coalesce("n_rows", F.lit(0)) > 0) & (F.coalesce("table_confidence", F.lit(1.0)) > 0.0),
    }
    met = met.select("query_id", F.coalesce("answer_types", F.array().cast("array<string>")).alias("types"), *[F.coalesce(c, F.lit(False)).alias(f"ok_{k}") for k, c in sound.items()])
    bad = F.filter("types", lambda t: ~((t == "freeform") & F.col("ok_freeform")) & ~((t == "multiple_choice") & F.col("ok_multiple_choice")) & ~((t == "table") & F.col("ok_table")))
    return met.select("query_id", bad.alias("fallbacks"))


def repaired_lines(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """query_id, papers, evidence, failed: one sound line a question, whatever its run gave.

    lines: query_id, papers (array), evidence (array of struct paper_id, source_type, locator map), null where the run failed.
    Papers are trimmed, blank ones dropped, each once in order; evidence needs a paper, a known type and a locator. A question
    without a line has an empty one and is marked as failed; lines of other questions are dropped, of several the least counts.
    """
    one = lines.groupBy("query_id").agg(F.min_by(F.struct("papers", "evidence"), F.to_json(F.struct("papers", "evidence"))).alias("l"))
    papers = F.array_distinct(F.filter(F.transform(F.coalesce("l.papers", F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p.isNotNull() & (p != "")))
    sound = F.filter("l.evidence", lambda e: (F.trim(e["paper_id"]) != "") & e["source_type"].isin(SOURCE_TYPES) & (F.size(e["locator"]) > 0))
    met = questions.select("query_id").distinct().join(one, "query_id", "left")
    return met.select("query_id", papers.alias("papers"), F.greatest(F.lit(0), F.coalesce(F.size(sound), F.lit(0))).alias("evidence"), F.col("l").isNull().alias("failed"))


def exact_match(gold: DataFrame, answers: DataFrame) -> DataFrame:
    """n, accuracy: share of gold texts (query_id, text) that the answer (query_id, text) equals in flat form; no answer is wrong."""
    said = answers.groupBy("query_id").agg(F.min(flat_text("text")).alias("said"))
    met = gold.join(said, "query_id", "left")
    right = F.coalesce((flat_text("text") == F.col("said")) & (F.col("said") != ""), F.lit(False))
    return met.agg(F.count("*").alias("n"), F.round(F.avg(right.cast("double")), 9).alias("accuracy"))
