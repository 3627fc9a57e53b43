"""Candidates of questions once more: identities, covers, floors, orders, rerankings and what is shown of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import cut
from ..functions.text import contains_words, sequence_text
from .evidence import match_text

# Routes that tell an owner, the last rank of a property hit that covers a target, shortest quote and its words.
OWNER_ROUTES, COVERING_ROUTE, COVERING_RANK = ["clause_owner", "self_definition_owner"], "target_property", 2
SHORTEST_QUOTE, QUOTE_WORDS, VALIDATED = 10, 2, 0.8
# Descriptions that mean no certain paper, and words that say nothing of it.
GENERIC_TEXTS = ["paper", "first paper", "second paper", "method", "each method", "each proposed method", "objective", "result", "study"]
GENERIC_WORDS = (
    "a an the one first second other each paper papers proposed method methods result results study studies source target containing "
    "contains report reports reporting comparison"
).split()
LEAST_WORDS, LEAST_INFORMATIVE, DOSSIER_TEXT, DOSSIER_SUPPORTS = 4, 2, 320, 2


def of_group(signals: Column, key: Column) -> Column:
    """The signals of a target: those of its group, whatever the case, in the role of a target."""
    same = lambda s: F.lower(F.trim(s["group_key"])) == F.lower(F.trim(key))
    return F.filter(signals, lambda s: F.coalesce(same(s), F.lit(False)) & (s["role"] == "target"))


def covers(signals: Column, key: Column) -> Column:
    """Whether a candidate surely is a target's: a route named it the owner, or the target's own query has it at the top."""
    return F.exists(of_group(signals, key), lambda s: s["route"].isin(OWNER_ROUTES) | ((s["route"] == COVERING_ROUTE) & (s["rank"] <= COVERING_RANK)))


def single_cover(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, paper_id, covered, n: of each question the paper that covers most of its targets, then the best ranked, then the first.

    candidates: query_id, paper_id, position, signals; targets: query_id, key. Questions without a covering paper have no row;
    covered are the keys in order.
    """
    keys = targets.where("key is not null").groupBy("query_id").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    met = candidates.join(keys, "query_id").withColumn("covered", F.filter("keys", lambda k: covers(F.col("signals"), k))).where("size(covered) > 0")
    ranks = F.transform("covered", lambda k: F.coalesce(F.array_min(F.transform(of_group(F.col("signals"), k), lambda s: s["rank"])), F.lit(2**31 - 1)))
    best = met.groupBy("query_id").agg(F.min(F.struct((-F.size("covered")).alias("n"), ranks.alias("ranks"), "position", "paper_id", "covered")).alias("b"))
    return best.select("query_id", "b.paper_id", F.array_join("b.covered", ",").alias("covered"), (-F.col("b.n")).alias("n"))


def floor_order(candidates: DataFrame, anchored: DataFrame) -> DataFrame:
    """query_id, paper_id, place: candidates that need no target: property hits first, for questions with an anchor citations before them.

    candidates: query_id, paper_id, position, provenance, signals; anchored: query_id. Papers that were only named, and not as a
    target, are left out.
    """
    rows = candidates.join(anchored.select("query_id").distinct().withColumn("anchor", F.lit(True)), "query_id", "left")
    only_named = (F.size("signals") > 0) & F.forall("signals", lambda s: (s["route"] == "name") & (s["role"] != "target"))
    has = lambda route: F.coalesce(F.array_contains("provenance", route), F.lit(False))
    order = F.when(F.coalesce("anchor", F.lit(False)) & has("citation"), 0).when(has("property"), 1).otherwise(2)
    kept = rows.where(~F.coalesce(only_named, F.lit(False)))
    return kept.select("query_id", "paper_id", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "position", "paper_id")).alias("place"))


def by_policy(candidates: DataFrame, accepted: DataFrame, policy: str) -> DataFrame:
    """query_id, paper_id, place: `gate` gives accepted papers only, by confidence; `rank` the others after them, in their order.

    candidates: query_id, paper_id, position; accepted: query_id, paper_id, confidence. Other policies are an error.
    """
    if policy not in ("gate", "rank"):
        raise ValueError(f"no policy {policy}")
    met = candidates.join(accepted.groupBy("query_id", "paper_id").agg(F.max("confidence").alias("confidence")), ["query_id", "paper_id"], "left" if policy == "rank" else "inner")
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("confidence"), F.when(F.col("confidence").isNotNull(), F.col("paper_id")), "position", "paper_id")
    return met.select("query_id", "paper_id", F.row_number().over(w).alias("place"))


def reranked(candidates: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """query_id, paper_id, place: the first k candidates of a question by score, of equal scores as they were; the rest after them.

    candidates: query_id, paper_id, position (from 0); scores: query_id, paper_id, score. If a score of the first k is missing,
    the question's order stays.
    """
    met = candidates.join(scores.groupBy("query_id", "paper_id").agg(F.max("score").alias("score")), ["query_id", "paper_id"], "left")
    head = F.col("position") < k
    lacking = met.where(head).groupBy("query_id").agg(F.max(F.col("score").isNull()).alias("lacking"))
    met = met.join(lacking, "query_id", "left").withColumn("score", F.when(head & ~F.coalesce("lacking", F.lit(True)), F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.when(head, 0).otherwise(1), F.desc_nulls_last("score"), "position", "paper_id")
    return met.select("query_id", "paper_id", F.row_number().over(w).alias("place"))


def validated(candidates: DataFrame, proposals: DataFrame) -> DataFrame:
    """query_id, paper_id, reason, confidence: candidates for which a proposal is true and quotes the candidate's own support.

    candidates: query_id, paper_id, texts (array); proposals: query_id, paper_id, supported (boolean), quote. A quote has ten
    characters and two words of letters at least; an invented one counts for nothing.
    """
    said = proposals.where("supported").select("query_id", "paper_id", match_text(F.col("quote")).alias("q"))
    said = said.where((F.length("q") >= SHORTEST_QUOTE) & (F.regexp_count("q", F.lit(r"\p{L}{2,}")) >= QUOTE_WORDS)).distinct()
    met = candidates.join(said, ["query_id", "paper_id"]).where(F.exists("texts", lambda t: match_text(t).contains(F.col("q"))))
    return met.select("query_id", "paper_id", F.lit("validated").alias("reason"), F.lit(VALIDATED).alias("confidence")).distinct()


def rerank_texts(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """query_id, paper_id, asked, text: what a reranker compares: the question with its criteria, the relation or the first support.

    questions: query_id, question, criteria (map); candidates: query_id, paper_id, relation, texts (array). Criteria are written
    as `k=v; ...` in the order description, venue, year, required_source_type, answer_value; empty ones are left out.
    """
    names = ["description", "venue", "year", "required_source_type", "answer_value"]
    said = F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.col("criteria")[n], F.lit("")) != "", F.concat(F.lit(n + "="), F.col("criteria")[n])) for n in names])), "; ")
    asked = questions.select("query_id", F.trim(F.concat_ws(" ", F.coalesce("question", F.lit("")), F.coalesce(said, F.lit("")))).alias("asked"))
    return candidates.join(asked, "query_id").select("query_id", "paper_id", "asked", F.coalesce(F.nullif("relation", F.lit("")), F.get("texts", F.lit(0)), F.lit("")).alias("text"))


def paper_set(evidence: DataFrame, seeds: DataFrame, neighbours: DataFrame, multi: DataFrame, most_single: int = 1) -> DataFrame:
    """query_id, paper_id, place: papers with evidence, then the best seeds (all where several are asked for, else one), then, where
    several are asked for, neighbours of the seeds; each paper where it came first.

    evidence, neighbours: query_id, paper_id, seq; seeds: query_id, paper_id, score, seq; multi: query_id.
    """
    many = multi.select("query_id").distinct().withColumn("many", F.lit(True))
    s = seeds.withColumn("seq", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "seq", "paper_id"))).join(many, "query_id", "left")
    s = s.where(F.coalesce("many", F.lit(False)) | (F.col("seq") <= most_single))
    parts = [evidence, s, neighbours.join(many, "query_id", "left_semi")]
    rows = None
    for k, part in enumerate(parts):
        each = part.select("query_id", "paper_id", F.struct(F.lit(k).alias("k"), F.col("seq").cast("long").alias("seq")).alias("at"))
        rows = each if rows is None else rows.unionByName(each)
    first = rows.where("paper_id is not null").groupBy("query_id", "paper_id").agg(F.min("at").alias("at"))
    return first.select("query_id", "paper_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "paper_id")).alias("place"))


def informative(text: Column) -> Column:
    """Whether a target's description tells a paper: four words, two of which say something, and no generic description."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    telling = F.array_distinct(F.filter(words, lambda w: ~w.isin(GENERIC_WORDS)))
    return ~F.array_join(words, " ").isin(GENERIC_TEXTS) & (F.size(words) >= LEAST_WORDS) & (F.size(telling) >= LEAST_INFORMATIVE)


def target_of(names: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, name, key, role: the first target that a name is, holds, or is held by, as whole words; else the name itself.

    names: query_id, name; targets: query_id, seq, key, text, role. Both are short: the runs of their words are looked up.
    """
    # Texts are compared once for all questions, by their runs of words; then each question's names and targets meet on equal texts.
    first = F.min(F.struct("seq", "key", "role")).alias("b")
    t = cut(targets.select("query_id", "seq", "key", "role", sequence_text("text").alias("t")))
    n = cut(names.select("query_id", "name", sequence_text("name").alias("n")).distinct())
    same = t.groupBy("query_id", F.lower(F.trim("key")).alias("k")).agg(first)
    same = n.withColumn("k", F.lower(F.trim("name"))).join(same, ["query_id", "k"]).select("query_id", "name", "b")
    texts = t.where("length(t) > 2").groupBy("query_id", "t").agg(first)
    of_n, of_t = n.where("length(n) > 2").select("n").distinct(), texts.select("t").distinct()
    inside = texts.join(_holding(of_t, "t", of_n, "n"), "t").groupBy("query_id", "n").agg(F.min("b").alias("b"))
    around = n.select("query_id", "n").distinct().join(_holding(of_n, "n", of_t, "t"), "n").join(texts, ["query_id", "t"]).select("query_id", "n", "b")
    fits = inside.unionByName(around).groupBy("query_id", "n").agg(F.min("b").alias("b"))
    met = same.unionByName(n.join(fits, ["query_id", "n"]).select("query_id", "name", "b"))
    best = met.groupBy("query_id", "name").agg(F.min("b").alias("b"))
    return names.select("query_id", "name").distinct().join(best, ["query_id", "name"], "left").select("query_id", "name", F.coalesce("b.key", F.trim("name")).alias("key"), F.coalesce("b.role", F.lit("target")).alias("role"))


def _holding(wholes: DataFrame, whole: str, parts: DataFrame, part: str) -> DataFrame:
    """whole, part: sequence texts, and those that they have as whole words; what is shuffled of their runs are numbers."""
    runs = wholes.select(F.xxhash64(whole).alias("w"), F.explode(F.transform(_runs(whole), lambda r: F.xxhash64(r))).alias("p"))
    numbered = parts.select(F.xxhash64(part).alias("p"), part)
    met = runs.join(numbered.select("p"), "p", "left_semi").join(numbered, "p").join(wholes.select(F.xxhash64(whole).alias("w"), whole), "w")
    return met.where(contains_words(F.col(whole), F.col(part))).select(whole, part).distinct()


def _runs(text: str) -> Column:
    """All runs of a sequence text's words, each as a sequence text, each once."""
    words = F.split(F.trim(text), " ")
    size = F.size(words)
    run = lambda i: F.transform(F.sequence(F.lit(1), size - i + 1), lambda k: F.concat(F.lit(" "), F.array_join(F.slice(words, i, k), " "), F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), run)))


def name_support(named: DataFrame, aliases: DataFrame, passages: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, name, paper_id, how, text: what shows that a paper is meant by a name.

    The sentence that defines the alias, else the first passage that has the name as whole words, else title and abstract.
    named: query_id, name, paper_id; aliases: name, paper_id, text; passages: paper_id, seq, text; papers: paper_id, title, abstract.
    """
    own = aliases.groupBy("name", "paper_id").agg(F.min("text").alias("alias_text"))
    p = passages.where("paper_id is not null").select("paper_id", "seq", "text", sequence_text("text").alias("s"))
    asked = named.select("name", "paper_id").distinct().withColumn("n", sequence_text("name"))
    said = asked.join(p, "paper_id").where(contains_words(F.col("s"), F.col("n"))).groupBy("name", "paper_id").agg(F.min_by("text", "seq").alias("passage_text"))
    about = papers.select("paper_id", F.trim(F.concat_ws(" ", "title", "abstract")).alias("about"))
    met = named.join(own, ["name", "paper_id"], "left").join(said, ["name", "paper_id"], "left").join(about, "paper_id", "left")
    how = F.when(F.col("alias_text").isNotNull(), "alias").when(F.col("passage_text").isNotNull(), "passage").otherwise("paper")
    return met.select("query_id", "name", "paper_id", how.alias("how"), F.coalesce("alias_text", "passage_text", "about", F.lit("")).alias("text"))


def source_owners(questions: DataFrame, papers: DataFrame) -> DataFrame:
    """query_id, paper_id: of each question the one paper whose title's head it names as the source of what it asks.

    The head is the title up to a colon, of at least two words or with a capital inside or a digit; it must stand in the question
    as written, with a word of reporting before (`in`, `according to`, ...) or after it (`reports`, `paper`, ...), and not behind
    `unlike`, `than` and the like. Heads are met through their longest word. Two papers with a head are none.
    """
    head = F.trim(F.substring_index("title", ":", 1))
    telling = head.rlike(r"\S\s+\S") | head.rlike(r"[a-z][A-Z]|\d")
    h = papers.where("title is not null").select("paper_id", head.alias("head")).where(telling & (F.length("head") >= 4))
    words = lambda c: F.split(F.trim(sequence_text(c)), " ")
    longest = F.element_at(F.array_sort(F.transform(words("head"), lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w")))), 1)["w"]
    asked = questions.where("question is not null").select("query_id", "question", F.explode(F.array_distinct(words("question"))).alias("word"))
    met = asked.join(h.withColumn("word", longest).where("word <> ''"), "word").where(F.col("question").contains(F.col("head")))
    quoted = F.concat(F.lit(r"\Q"), "head", F.lit(r"\E"))
    before = F.concat(F.lit(r"(?i)\b(?:in|of|by|from|according to|does|did|for)\s+(?:the\s+)?(?:[\"'“‘])?(?-i)"), quoted, F.lit(r"(?![A-Za-z0-9])"))
    after = F.concat(F.lit(r"(?<![A-Za-z0-9])"), quoted, F.lit(r"(?i)(?:[\"'”’])?\s+(?:paper|reports?|shows?|proposes?|study|work|analysis)\b"))
    denied = F.concat(F.lit(r"(?i)\b(?:unlike|than|versus|vs\.?|against|except|without)\s+(?:the\s+)?(?-i)"), quoted)
    sure = met.where((F.regexp_like("question", before) | F.regexp_like("question", after)) & ~F.regexp_like("question", denied))
    return sure.groupBy("query_id").agg(F.count_distinct("paper_id").alias("n"), F.min("paper_id").alias("paper_id")).where("n = 1").select("query_id", "paper_id")


def dossiers(candidates: DataFrame) -> DataFrame:
    """query_id, paper_id, routes, supports: a short view of each candidate: its routes with ranks, and its first two supports, each
    of at most 320 characters, white space collapsed.

    candidates: query_id, paper_id, signals, support (arrays of structs).
    """
    flat = lambda t: F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), r"\s+", " "))
    short = lambda t: F.when(F.length(flat(t)) <= DOSSIER_TEXT, flat(t)).otherwise(F.concat(F.rtrim(F.left(flat(t), F.lit(DOSSIER_TEXT - 1))), F.lit("…")))
    routes = F.array_join(F.transform("signals", lambda s: F.concat_ws(":", s["route"], s["rank"])), ",")
    return candidates.select("query_id", "paper_id", routes.alias("routes"), F.array_join(F.transform(F.slice("support", 1, DOSSIER_SUPPORTS), lambda s: short(s["text"])), "\n").alias("supports"))
