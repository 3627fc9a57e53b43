"""Scores and validity of results. The scores are reconstructed from how the published metrics are described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import flat_text

PLACEHOLDER = "unknown"


def set_scores(gold: DataFrame, predicted: DataFrame, by: str, key: str) -> DataFrame:
    """by, precision, recall, f1: overlap of the sets of keys of each group in gold; a group without predictions scores 0.

    Repeated keys count once, groups only predicted are ignored.
    """
    g, p = gold.select(by, key).distinct(), predicted.select(by, key).distinct()
    both = g.withColumn("g", F.lit(1)).join(p.withColumn("p", F.lit(1)), [by, key], "full").join(g.select(by).distinct(), by, "left_semi")
    n = both.groupBy(by).agg(F.count("g").alias("gold"), F.count("p").alias("predicted"), F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("hits"))
    precision, recall = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0), F.col("hits") / F.col("gold")
    f1 = F.when(F.col("hits") > 0, 2 * F.col("hits") / (F.col("gold") + F.col("predicted"))).otherwise(0.0)
    return n.select(by, F.round(precision, 9).alias("precision"), F.round(recall, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def macro(scores: DataFrame) -> DataFrame:
    """One row: the means over groups, and their number."""
    return scores.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")], F.count("*").alias("n"))


def cells_match(gold: Column, said: Column) -> Column:
    """Numbers that are close (one in 10^9), texts that are flat the same; a null matches a null only."""
    g, s = gold.try_cast("double"), said.try_cast("double")
    close = F.abs(g - s) <= 1e-9 * F.greatest(F.abs(g), F.abs(s))
    return F.when(gold.isNull() | said.isNull(), gold.isNull() & said.isNull()).when(g.isNotNull() & s.isNotNull(), close).otherwise(flat_text(gold) == flat_text(said))


def table_scores(gold: DataFrame, predicted: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """table, row_f1, cell_accuracy, n_cells: rows by their flat keys; cells of gold rows, a missing row's cells are wrong.

    gold, predicted: table, row (key), column, value.
    """
    key = flat_text(row)
    g = gold.select(table, key.alias("k"), "column", F.col(value).cast("string").alias("gv"))
    p = predicted.select(table, key.alias("k"), "column", F.col(value).cast("string").alias("pv"), F.lit(True).alias("there"))
    rows = set_scores(g, p, table, "k").select(table, F.col("f1").alias("row_f1"))
    p = p.groupBy(table, "k", "column").agg(F.min("pv").alias("pv"), F.max("there").alias("there"))
    cells = g.join(p, [table, "k", "column"], "left").groupBy(table).agg(F.count("*").alias("n_cells"), F.count_if(F.col("there").isNotNull() & cells_match(F.col("gv"), F.col("pv"))).alias("right"))
    return rows.join(cells, table).select(table, "row_f1", F.round(F.col("right") / F.col("n_cells"), 9).alias("cell_accuracy"), "n_cells")


def choice_accuracy(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: accuracy, n. A question without an answer is wrong."""
    p = predicted.groupBy("query_id").agg(F.min(F.upper(F.trim("label"))).alias("said"))
    return gold.join(p, "query_id", "left").agg(F.round(F.avg(F.coalesce((F.upper("label") == F.col("said")).cast("int"), F.lit(0))), 6).alias("accuracy"), F.count("*").alias("n"))


def violations(lines: DataFrame, questions: DataFrame, source_types: list[str]) -> DataFrame:
    """query_id, rule, n: every way in which a submission breaks its contract.

    lines: query_id, gold_papers (array of ids), evidence (array of paper_id, source_type, page), choice; questions: query_id,
    mc_options. Rules: missing, duplicate and unknown questions, repeated papers, evidence of unknown kind or without a
    page of at least 1, and a choice that is no label.
    """
    own = lines.where("query_id is not null")
    count = own.groupBy("query_id").agg(F.count("*").alias("n"))
    ids = questions.select("query_id").distinct()
    options = questions.groupBy("query_id").agg(F.min_by("mc_options", F.when(F.col("mc_options").isNotNull(), F.to_json("mc_options"))).alias("mc_options"))
    with_options = own.join(options, "query_id", "left")
    papers, evidence = F.coalesce("gold_papers", F.array().cast("array<string>")), F.col("evidence")
    rules = [
        (ids.join(count, "query_id", "left_anti"), "missing_question", F.lit(1)),
        (count.where("n > 1"), "duplicate_question", F.col("n") - 1),
        (count.join(ids, "query_id", "left_anti"), "unknown_question", F.col("n")),
        (own, "repeated_paper", F.size(papers) - F.size(F.array_distinct(papers))),
        (own, "unknown_source_type", F.size(F.filter(evidence, lambda e: ~F.coalesce(e["source_type"].isin(source_types), F.lit(False))))),
        (own, "page_below_one", F.size(F.filter(evidence, lambda e: F.coalesce(e["page"] < 1, F.lit(True))))),
        (with_options, "choice_is_no_label", F.when(F.col("mc_options").isNotNull() & ~F.coalesce(F.map_contains_key("mc_options", F.coalesce("choice", F.lit(""))), F.lit(False)), 1).otherwise(0)),
    ]
    parts = [df.select("query_id", F.lit(rule).alias("rule"), n.cast("long").alias("n")).where("n > 0") for df, rule, n in rules]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("query_id", "rule").agg(F.sum("n").alias("n"))


def repaired(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id, text, choice, fell_back: answers that satisfy the contract.

    answers: query_id, text, choice. A missing text becomes a placeholder, a choice that is no label the first label; only
    the types that a question asks for are given, and fell_back lists those that had to be repaired.
    """
    met = questions.select("query_id", "answer_types", "mc_options").join(answers.groupBy("query_id").agg(F.min("text").alias("text"), F.upper(F.trim(F.min("choice"))).alias("choice")), "query_id", "left")
    wants = lambda t: F.coalesce(F.array_contains("answer_types", t), F.lit(False))
    labels = F.array_sort(F.transform(F.map_keys("mc_options"), lambda x: F.upper(F.trim(x))))
    text_ok = F.coalesce(F.trim("text") != "", F.lit(False))
    choice_ok = F.coalesce(F.array_contains(labels, F.col("choice")), F.lit(False))
    text = F.when(wants("freeform"), F.when(text_ok, F.col("text")).otherwise(PLACEHOLDER))
    choice = F.when(wants("multiple_choice"), F.when(choice_ok, F.col("choice")).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit("A"))))
    bad = F.array_compact(F.array(F.when(wants("freeform") & ~text_ok, "freeform"), F.when(wants("multiple_choice") & ~choice_ok, "multiple_choice")))
    return met.select("query_id", text.alias("text"), choice.alias("choice"), bad.alias("fell_back"))
