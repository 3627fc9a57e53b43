"""Candidate papers of questions: merging routes, constraints, gates, coverage and selection, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import parallelism
from ..functions.text import contains_words, sequence_text, terms, venue_of, year_of

GATE_RELATION, GATE_VALUE = 0.95, 0.90
#: What a term of a phrase in a paper's title is worth; papers that phrases are scored against at once.
TITLE_WORTH, PAPERS_AT_ONCE = 4, 32_768


def merge_routes(rows: DataFrame, order: str = "row_id") -> DataFrame:
    """query_id, paper_id, position, provenance, n_support, relation, signals: one row for each candidate of a question.

    Rows are in the order of `order`: provenance keeps the first place of each name, relation is the first that isn't null, a
    signal (route, group_key) has its least rank, greatest score and first role; signals are in the order in which they came.
    position counts a question's papers from 0 as they were first seen.
    """
    rows = rows.where("paper_id is not null")
    key = ["query_id", "paper_id"]
    names = rows.select(*key, order, F.posexplode("provenance").alias("i", "name")).groupBy(*key, "name").agg(F.min(F.struct(order, "i")).alias("at"))
    names = names.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda s: s["name"]).alias("provenance"))
    signals = rows.select(*key, order, F.posexplode("route_signals").alias("i", "s")).groupBy(*key, "s.route", "s.group_key").agg(F.min(F.struct(order, "i")).alias("at"), F.min("s.rank").alias("rank"), F.max("s.score").alias("score"), F.min_by("s.role", F.struct(order, "i")).alias("role"))
    signals = signals.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "route", "group_key", "rank", "score", "role"))), lambda s: F.struct(s["route"].alias("route"), s["group_key"].alias("group_key"), s["rank"].alias("rank"), s["score"].alias("score"), s["role"].alias("role"))).alias("signals"))
    base = rows.groupBy(*key).agg(F.min(order).alias("first"), F.sum(F.coalesce(F.size("support"), F.lit(0))).alias("n_support"), F.min_by("relation_support", F.when(F.col("relation_support").isNotNull(), F.col(order))).alias("relation"))
    base = base.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("first")) - 1).drop("first")
    return base.join(names, key, "left").join(signals, key, "left")


# What a venue in front of it scopes, and the longest way there.
SCOPED_NOUNS, SCOPE_GAP = "papers?|works?|studies|methods?", r"[^.?!;:]{0,80}?"


def venue_constraint(question: Column, venues: list[str]) -> tuple[Column, Column]:
    """The venue and year that a question asks its papers to have, else null.

    Papers are scoped by `VENUE [YEAR] ... papers` or `YEAR VENUE ... papers`: of all such places those with a year come
    first, then the earliest. Without any the question's only venue counts, with the year if there is only one. A year alone is
    no constraint, nor are several venues.
    """
    q = F.coalesce(question, F.lit(""))
    alt = "|".join(venues)

    def places(pattern: str, venue: int, year: int) -> Column:
        parts = lambda m, k: F.nullif(F.lower(F.regexp_extract(m, pattern, k)), F.lit(""))
        return F.transform(F.regexp_extract_all(q, F.lit(pattern), 0), lambda m: F.struct(parts(m, year).isNull().alias("bare"), F.call_function("locate", m, q).alias("begin"), parts(m, venue).alias("venue"), parts(m, year).alias("year")))

    behind = places(rf"(?i)\b({alt})(?:[\s-]*(20\d{{2}}))?\b{SCOPE_GAP}\b(?:{SCOPED_NOUNS})\b", 1, 2)
    before = places(rf"(?i)\b(20\d{{2}})[\s-]+({alt})\b{SCOPE_GAP}\b(?:{SCOPED_NOUNS})\b", 2, 1)
    best = F.array_min(F.concat(behind, before))
    named = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(rf"(?i)\b({alt})\b"), 1), lambda v: F.lower(v)))
    years = F.array_distinct(F.regexp_extract_all(q, F.lit(r"\b(20\d{2})\b"), 1))
    venue = F.when(best.isNotNull(), best["venue"]).when(F.size(named) == 1, F.element_at(F.when(F.size(named) == 1, named), 1))
    year = F.when(best.isNotNull(), best["year"]).when((F.size(named) == 1) & (F.size(years) == 1), F.element_at(F.when(F.size(years) == 1, years), 1))
    return venue, year


def recall_safe(rows: DataFrame, by: str, keep: Column) -> DataFrame:
    """The rows of each group that satisfy `keep`, or all of a group where none does."""
    return rows.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("__any", F.max("__keep").over(Window.partitionBy(by))).where("__keep or not __any").drop("__keep", "__any")


def satisfies(paper_id: Column, venue: Column, year: Column) -> Column:
    """No constraint is satisfied by all; an id without a venue or year breaks one."""
    return (venue.isNull() | F.coalesce(venue_of(paper_id) == venue, F.lit(False))) & (year.isNull() | F.coalesce(year_of(paper_id) == year, F.lit(False)))


def definite_filter(rows: DataFrame, want_venue: Column, want_year: Column) -> DataFrame:
    """Rows (with venue, year, n_support, provenance, relation) without those that surely break a constraint or have nothing
    to stand on. Unknown venues and years break nothing."""
    bare = (F.col("n_support") == 0) & (F.coalesce(F.size("provenance"), F.lit(0)) == 0) & F.col("relation").isNull()
    off = lambda have, want: F.coalesce(F.lower(F.trim(have.cast("string"))) != F.lower(F.trim(want.cast("string"))), F.lit(False))
    return rows.where(~bare & ~off(F.col("venue"), want_venue) & ~off(F.col("year"), want_year))


def attest(rows: DataFrame, grounded: Column) -> DataFrame:
    """rows with reason and confidence: accepted by a resolved relation, or by a grounded value; else both are null."""
    return rows.withColumn("reason", F.when(F.col("relation").isNotNull(), "relation").when(grounded, "value")).withColumn("confidence", F.when(F.col("relation").isNotNull(), GATE_RELATION).when(grounded, GATE_VALUE))


def strongest(accepted: DataFrame) -> DataFrame:
    """query_id, paper_id, reason, confidence, rank: the strongest acceptance of each paper; rank by confidence, then id."""
    best = accepted.where("confidence is not null").groupBy("query_id", "paper_id").agg(F.max(F.struct("confidence", "reason")).alias("b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("b.confidence"), "paper_id"))
    return best.select("query_id", "paper_id", "b.reason", "b.confidence", rank.alias("rank"))


def property_first(merged: DataFrame) -> DataFrame:
    """merged with place: papers that the property route found first, each in their order."""
    has = F.exists("signals", lambda s: s["route"] == "property")
    return merged.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(has, 0).otherwise(1), "position")))


def group_hits(hits: DataFrame, by: list[str], doc: str, order: str, keep: int = 3) -> DataFrame:
    """by, doc, rank from 0, hits: documents in the order of their best hit, with their first `keep` hits."""
    best = hits.groupBy(*by, doc).agg(F.min(order).alias("first"), F.slice(F.array_sort(F.collect_list(order)), 1, keep).alias("hits"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("first", doc)) - 1).drop("first")


def capped(ranked: DataFrame, place: str, *limits: Column) -> DataFrame:
    """Rows within the first limit that isn't null; without any, all."""
    return ranked.where(F.coalesce(F.col(place) <= F.coalesce(*limits), F.lit(True)))


def constraint_coverage(candidates: DataFrame, constraints: DataFrame) -> DataFrame:
    """query_id, paper_id, position, n_constraints, matched, token_hits: how much of a question each candidate's evidence has.

    candidates: query_id, paper_id, position, evidence, question. constraints: query_id, surface (one row each).
    """
    each = candidates.join(constraints.select("query_id", sequence_text("surface").alias("surface")).distinct(), "query_id", "left")
    hit = F.coalesce(contains_words(sequence_text("evidence"), F.col("surface")), F.lit(False))
    tokens = F.size(F.array_intersect(F.array_distinct(terms("question")), terms("evidence")))
    return each.groupBy("query_id", "paper_id", "position").agg(F.count("surface").alias("n_constraints"), F.count_if(hit).alias("matched"), F.max(tokens).alias("token_hits"))


def answer_bearing(coverage: DataFrame, baseline: DataFrame) -> DataFrame:
    """query_id, paper_id, rescued: the baseline's first paper, or the one whose evidence has far more of the constraints.

    A rescue needs at least two constraints, half of them (and two) matched, and two more than the baseline's paper has.
    coverage as from constraint_coverage; baseline: query_id, paper_id.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), F.desc("token_hits"), "position", "paper_id")
    best = coverage.withColumn("n", F.row_number().over(order)).where("n = 1").select("query_id", F.col("paper_id").alias("best"), F.col("matched").alias("best_matched"), "n_constraints")
    own = baseline.join(coverage.select("query_id", "paper_id", "matched"), ["query_id", "paper_id"], "left")
    met = own.join(best, "query_id", "left")
    enough = (F.col("n_constraints") >= 2) & (F.col("best_matched") >= F.greatest(F.lit(2), F.ceil(F.col("n_constraints") / 2))) & (F.col("best_matched") >= F.coalesce("matched", F.lit(0)) + 2) & (F.col("best") != F.col("paper_id"))
    rescued = F.coalesce(enough, F.lit(False))
    return met.select("query_id", F.when(rescued, F.col("best")).otherwise(F.col("paper_id")).alias("paper_id"), rescued.alias("rescued"))


def clause_owners(phrases: DataFrame, papers: DataFrame, present: DataFrame) -> DataFrame:
    """phrase_id, query_id, paper_id, score, runner_up: the paper that a descriptive phrase surely means.

    phrases: phrase_id, query_id, words (array of distinct terms); papers: paper_id, title, abstract; present: query_id,
    paper_id. A term in the title is worth 4, in the abstract alone 1. The best paper must have 65 % of the terms (three at
    least), two of them in its title or four in all, lead by two, and be a candidate already.
    """
    # Phrases of the same terms meet the papers once; all of them stream past blocks of papers, whose scores are rows of bytes.
    asked = phrases.withColumn("words", F.array_sort("words")).where("size(words) > 0")
    spark = papers.sparkSession
    blocks = max(1, -(-papers.count() // PAPERS_AT_ONCE))
    slices = max(1, -(-parallelism(spark) // blocks))
    title, d = F.array_distinct(terms("title")), F.array_distinct(terms(F.concat_ws(" ", "title", "abstract")))
    # Bound as a lambda's argument, and made by a generator, the terms are found once a paper.
    weighed = F.transform(F.array(F.struct(title.alias("t"), d.alias("d"))), lambda s: F.struct(s["d"].alias("words"), F.transform(s["d"], lambda w: F.when(F.array_contains(s["t"], w), TITLE_WORTH).otherwise(1).cast("tinyint")).alias("worth")))
    docs = papers.select("paper_id", F.inline(weighed))
    docs = docs.select(F.pmod(F.xxhash64("paper_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "paper_id", "words", "worth")
    each = asked.select("words").distinct().select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("words"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("paper_id"), "words", F.lit(None).cast("array<tinyint>").alias("worth"))
    rows = docs.unionByName(each).repartition(blocks * slices, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    met = rows.mapInArrow(_best_of_blocks, "words array<string>, score int, paper_id string, title_hits int, hits int, second int")
    # The runner-up is the second of the blocks' best, or the second of a block.
    best = met.groupBy("words").agg(F.max(F.struct("score", "paper_id", "title_hits", "hits")).alias("b"), F.sort_array(F.collect_list("score"), asc=False).alias("s"), F.max("second").alias("second"))
    best = best.select("words", F.size("words").alias("n"), "b.*", F.greatest("second", F.coalesce(F.get("s", F.lit(1)), F.lit(0))).cast("long").alias("runner_up")).withColumn("score", F.col("score").cast("long"))
    sure = best.where((F.col("hits") >= F.greatest(F.lit(3), F.ceil(F.col("n") * 0.65))) & ((F.col("title_hits") >= 2) | (F.col("hits") >= 4)) & (F.col("score") - F.col("runner_up") >= 2))
    told = asked.select("phrase_id", "query_id", "words").join(sure, "words")
    return told.join(present.select("query_id", "paper_id").distinct(), ["query_id", "paper_id"], "left_semi").select("phrase_id", "query_id", "paper_id", "score", "runner_up")


def _best_of_blocks(batches):
    """Of each block of papers (kind 0: words, worth) and each phrase after it (kind 1: words) the best paper and the two best scores."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("words", pa.list_(pa.string())), ("score", pa.int32()), ("paper_id", pa.string()), ("title_hits", pa.int32()), ("hits", pa.int32()), ("second", pa.int32())])
    at, parts, index, out = None, [], None, []

    def indexed():
        """paper ids, and of each term either the worth of every paper, or (where few have it) the places and their worth."""
        whole = pa.Table.from_batches(parts)
        ids = whole.column("paper_id").to_pylist()
        words, worth = whole.column("words").combine_chunks(), whole.column("worth").combine_chunks()
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), words.value_lengths().to_numpy(zero_copy_only=False))
        coded = words.flatten().dictionary_encode()
        codes, worth = coded.indices.to_numpy(zero_copy_only=False), worth.flatten().to_numpy(zero_copy_only=False).astype(np.uint8)
        order = np.argsort(codes, kind="stable")
        ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
        doc, worth, terms_ = doc[order], worth[order], {}
        for k, term in enumerate(coded.dictionary.to_pylist()):
            where, what = doc[ends[k] : ends[k + 1]], worth[ends[k] : ends[k + 1]]
            if len(where) * 32 > len(ids):
                row = np.zeros(len(ids), np.uint8)
                row[where] = what
                terms_[term] = row, None
            else:
                terms_[term] = what, where
        return ids, terms_

    for batch in batches:
        block, kinds = list(zip(batch.column("block").to_pylist(), batch.column("slice").to_pylist())), batch.column("kind").to_numpy()
        edges = [0, *[i for i in range(1, batch.num_rows) if block[i] != block[i - 1] or kinds[i] != kinds[i - 1]], batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            if i == j:
                continue
            if block[i] != at:
                at, parts, index = block[i], [], None
            if kinds[i] == 0:
                parts.append(batch.slice(i, j - i).select(["paper_id", "words", "worth"]))
                continue
            if not parts and index is None:
                continue
            if index is None:
                index, parts = indexed(), []
            ids, of = index
            for words in batch.column("words").slice(i, j - i).to_pylist():
                met = [of[w] for w in words if w in of]
                if not met:
                    continue
                total = np.zeros(len(ids), np.uint8 if len(met) * TITLE_WORTH < 256 else np.int32)
                for worth, where in met:
                    if where is None:
                        total += worth
                    else:
                        total[where] += worth
                k = int(total.argmax())
                first, own = int(total[k]), []
                for worth, where in met:
                    if where is None:
                        own.append(int(worth[k]))
                    else:
                        p = int(np.searchsorted(where, k))
                        own.append(int(worth[p]) if p < len(where) and where[p] == k else 0)
                total[k] = 0
                out.append((words, first, ids[k], sum(x == TITLE_WORTH for x in own), sum(x > 0 for x in own), int(total.max())))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def target_coverage(strengths: DataFrame) -> DataFrame:
    """query_id, target, paper_id: a different paper for each target, taken greedily in the order of the targets.

    strengths: query_id, target (number), paper_id, strength (smaller is stronger), position. A target takes its strongest
    paper that no earlier one took, by strength, position and id; a target without one has no row. A question's few targets
    depend on each other, so each question is one group, of targets x papers.
    """
    import pyarrow as pa

    def greedy(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (r["target"], r["strength"], r["position"], r["paper_id"]))
        taken: dict[int, str] = {}
        used: set[str] = set()
        for r in rows:
            if r["target"] not in taken and r["paper_id"] not in used:
                taken[r["target"]] = r["paper_id"]
                used.add(r["paper_id"])
        return pa.table({"query_id": pa.array([group["query_id"][0].as_py()] * len(taken), pa.string()), "target": pa.array(list(taken), pa.int32()), "paper_id": pa.array(list(taken.values()), pa.string())})

    # No target can need more papers than there are targets: the rest of each list never matters.
    targets = F.size(F.collect_set("target").over(Window.partitionBy("query_id")))
    first = F.row_number().over(Window.partitionBy("query_id", "target").orderBy("strength", "position", "paper_id"))
    few = strengths.select("query_id", F.col("target").cast("int").alias("target"), "paper_id", F.col("strength").cast("double").alias("strength"), F.col("position").cast("long").alias("position")).withColumn("n", targets).withColumn("k", first).where("k <= n").drop("n", "k")
    return few.groupBy("query_id").applyInArrow(greedy, "query_id string, target int, paper_id string")


def fuse_tiers(scores: DataFrame, confirmed: DataFrame, n: int, named: DataFrame) -> DataFrame:
    """query_id, paper_id, score, rank: sums of tiers' scores, the five best moved by 0.3 x confirmation, the n best, then
    papers named outright that are missing, with their own score.

    scores: query_id, paper_id, tier, score; confirmed: query_id, paper_id, confidence, agrees; named: query_id, paper_id, score.
    """
    total = scores.groupBy("query_id", "paper_id", "tier").agg(F.max("score").alias("s")).groupBy("query_id", "paper_id").agg(F.round(F.sum("s"), 9).alias("score"))
    order = lambda: Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")
    first = total.withColumn("k", F.row_number().over(order())).join(confirmed, ["query_id", "paper_id"], "left")
    shift = F.when((F.col("k") <= 5) & F.col("agrees").isNotNull(), F.when(F.col("agrees"), 0.3).otherwise(-0.3) * F.col("confidence")).otherwise(0.0)
    best = first.select("query_id", "paper_id", F.round(F.col("score") + shift, 9).alias("score")).withColumn("rank", F.row_number().over(order())).where(F.col("rank") <= n)
    missing = named.groupBy("query_id", "paper_id").agg(F.max("score").alias("score")).join(best, ["query_id", "paper_id"], "left_anti")
    missing = missing.withColumn("rank", F.lit(n) + F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "paper_id")))
    return best.unionByName(missing)
