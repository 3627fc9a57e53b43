"""Facts for cells of answer tables: headers, admission, aliases, owners, fills and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..cluster import cut, parallelism
from ..functions.text import contains_words, flat_text, number_or_null, sequence_text, within_one_edit
from .answers import tolerant
from .evidence import SOURCE_TYPES
from .reading import printed_value

# Words of headers that name nothing, words that mean the same, and names of data of which a header has one.
HEADER_STOP_WORDS = "a an and at by for from in of on test the to value values with without".split()
SYNONYMS = {"iter": "iteration", "iters": "iteration", "iteration": "iteration", "iterations": "iteration", "acc": "accuracy", "oa": "accuracy", "performance": "accuracy", "nfe": "step"}
EXCLUSIVE = "cifar imagenet modelnet omnidata scifact hotpotqa nfcorpus climate sparc cosql".split()
SCIENTIFIC_MARKS = list("^±×·/%°")
SURE_OWNER = 9_000
#: Sources of a paper that its keys are looked for in together.
SOURCES_AT_ONCE = 4_096
_NONE = "array<string>"


def header_tokens(text: Column) -> Column:
    """The words of a header as a set: without words that name nothing, plurals and synonyms led to one form."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    same = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    one = lambda w: F.coalesce(same[w], F.when((F.length(w) > 3) & w.endswith("s"), F.left(w, F.length(w) - 1)).otherwise(w))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~w.isin(HEADER_STOP_WORDS)), one))


def header_fits(path: Column, column: Column, required: Column) -> Column:
    """Whether a path of headers (array) has all words of a column's name and of each required term (array), and no other data's name.

    A column named `value` asks for nothing by its name. Paths with empty parts, and names that say nothing, don't fit.
    """
    tokens, name = header_tokens(F.array_join(path, " ")), header_tokens(column)
    generic = flat_text(column).isin("value", "values")
    wants = F.concat(F.when(generic, F.array().cast("array<array<string>>")).otherwise(F.array(name)), F.transform(F.coalesce(required, F.array().cast(_NONE)), header_tokens))
    data = F.array(*map(F.lit, EXCLUSIVE))

    def met(want: Column) -> Column:
        own, other = F.array_intersect(want, data), F.array_except(F.array_intersect(tokens, data), want)
        return (F.size(F.array_except(want, tokens)) == 0) & ~((F.size(own) > 0) & (F.size(other) > 0))

    whole = (F.size(path) > 0) & F.forall(path, lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    return F.coalesce(whole & ((F.size(name) > 0) | generic) & (F.size(tokens) > 0) & F.forall(wants, met), F.lit(False))


def admissions(proposals: DataFrame) -> DataFrame:
    """proposals with reasons (array, why a cell is not admitted) and admitted.

    proposals: target_known, column_known (booleans), owners (array; empty: any), paper_id, page, source_type, key, expected,
    header_fits (boolean), value, quote, source_text, families (array).
    """
    text = sequence_text("source_text")
    checks = [
        ("unknown_target", ~F.coalesce("target_known", F.lit(False))),
        ("unknown_column", ~F.coalesce("column_known", F.lit(False))),
        ("no_paper", F.coalesce("paper_id", F.lit("")) == ""),
        ("wrong_owner", (F.size(F.coalesce("owners", F.array().cast(_NONE))) > 0) & ~F.coalesce(F.array_contains("owners", F.coalesce("paper_id", F.lit(""))), F.lit(False))),
        ("bad_page", F.coalesce("page", F.lit(0)) < 1),
        ("bad_source_type", ~F.coalesce(F.col("source_type").isin(SOURCE_TYPES), F.lit(False))),
        ("empty_key", flat_text("key") == ""),
        ("key_not_expected", ~tolerant(F.col("key"), F.col("expected"))),
        ("key_not_printed", (flat_text("key") != "") & ~contains_words(text, sequence_text("key"))),
        ("header_mismatch", ~F.coalesce("header_fits", F.lit(False))),
        ("empty_value", F.trim(F.coalesce("value", F.lit(""))) == ""),
        ("value_not_printed", (F.trim(F.coalesce("value", F.lit(""))) != "") & ~F.coalesce(F.lower("source_text"), F.lit("")).contains(F.lower(F.trim(F.coalesce("value", F.lit("")))))),
        ("empty_quote", F.trim(F.coalesce("quote", F.lit(""))) == ""),
        ("no_verifier", F.size(F.filter(F.coalesce("families", F.array().cast(_NONE)), lambda f: F.trim(f) != "")) == 0),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks]))
    return proposals.withColumn("reasons", reasons).withColumn("admitted", F.size("reasons") == 0)


def keeps_information(old: Column, new: Column, kind: Column) -> Column:
    """Whether a new text may replace an old one: not if it is a part of the old letters and digits, or the same without a
    scientific mark. Numbers, and texts without letters and digits, may always be replaced."""
    a, b = printed_value(old), printed_value(new)
    compact = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", "")
    x, y = compact(a), compact(b)
    shorter = (F.length(y) < F.length(x)) & x.contains(y)
    lost = F.exists(F.array(*map(F.lit, SCIENTIFIC_MARKS)), lambda m: a.contains(m) & ~b.contains(m))
    free = (F.lower(F.coalesce(kind, F.lit("string"))) == "number") | old.isNull() | new.isNull() | (flat_text(a) == flat_text(b)) | (x == "") | (y == "")
    return F.coalesce(free | ~(shorter | ((x == y) & lost)), F.lit(True))


def target_present(text: Column, target: Column) -> Column:
    """Whether a text names a target: as words, with or without what is in brackets; closed up (five letters or more); or by a
    word one edit away (five letters or more in both)."""
    bare = F.trim(F.regexp_replace(F.coalesce(target, F.lit("")), r"\s*\([^)]*\)", ""))
    flat = lambda t: F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9]", "")
    words, s = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), sequence_text(text)

    def named(t: Column) -> Column:
        c = flat(t)
        return contains_words(s, sequence_text(t)) | ((F.length(c) >= 5) & (flat(text).contains(c) | F.exists(words, lambda w: (F.length(w) >= 5) & within_one_edit(w, c))))

    return named(F.coalesce(target, F.lit(""))) | named(bare)


def attested_keys(expected: DataFrame, sources: DataFrame) -> DataFrame:
    """table, key: expected keys (arrays of parts) of which one source of the table's paper has all parts as words.

    expected: table, paper_id, key; sources: paper_id, text (a title or a page each). Keys without parts, or with empty ones, are
    none. A key meets each block of its paper's sources once, as numbers whose bits are sources.
    """
    sound = expected.where("size(key) > 0").where(~F.exists("key", lambda p: flat_text(p) == "")).distinct()
    parts = F.transform("key", lambda p: sequence_text(p))
    asked = sound.select("paper_id", parts.alias("parts")).distinct().where("trim(parts[0]) <> ''")
    text = sources.where("paper_id is not null").select("paper_id", sequence_text("text").alias("s"))
    sizes = text.groupBy("paper_id").agg(F.ceil(F.count("*") / SOURCES_AT_ONCE).cast("int").alias("blocks"))
    asked = cut(asked.join(sizes, "paper_id"))
    large = F.broadcast(asked.where("blocks > 1").select("paper_id", "blocks").distinct())
    # Papers of more sources than a block's are parted, their keys go to each part; texts go through once, words never with a text.
    spread = F.pmod(F.xxhash64("s"), F.coalesce("blocks", F.lit(1))).cast("int")
    blocks = text.join(asked.select("paper_id").distinct(), "paper_id", "left_semi").join(large, "paper_id", "left").select("paper_id", spread.alias("block"), F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("parts"), "s")
    keys = asked.select("paper_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("kind"), "parts", F.lit(None).cast("string").alias("s"))
    rows = keys.unionByName(blocks).repartition(parallelism(sources.sparkSession), "paper_id", "block").sortWithinPartitions("paper_id", "block", "kind")
    found = rows.mapInArrow(_attested, "paper_id string, parts array<string>").distinct()
    return sound.select("table", "paper_id", "key", parts.alias("parts")).join(found, ["paper_id", "parts"]).select("table", "key").distinct()


def _attested(batches):
    """Of rows by paper, block and kind (0: parts of a key, 1: a source) the keys of which a source has all parts."""
    import pyarrow as pa

    schema = pa.schema([("paper_id", pa.string()), ("parts", pa.list_(pa.string()))])
    at, keys, texts, out = None, [], {}, []

    def settle():
        """Places of texts as bits of numbers, one number a word that is asked for."""
        words = {w for parts in keys for p in parts for w in p.split()}
        of = dict.fromkeys(words, 0)
        for i, s in enumerate(texts):
            for w in words.intersection(s.split()):
                of[w] |= 1 << i
        whole = list(texts)
        for parts in keys:
            left = -1
            for p in parts:
                for w in p.split():
                    left &= of[w]
            if left == -1:  # parts without words are in every text
                left = (1 << len(texts)) - 1
            longer = [p for p in parts if p.strip().count(" ") or not p.strip()]
            while left and longer and not all(p in whole[(left & -left).bit_length() - 1] for p in longer):
                left &= left - 1
            if left:
                out.append((at[0], parts))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

    for batch in batches:
        for paper, block, kind, parts, s in zip(*(batch.column(c).to_pylist() for c in ("paper_id", "block", "kind", "parts", "s"))):
            if (paper, block) != at:
                settle()
                at, keys, texts = (paper, block), [], {}
            if kind == 0:
                keys.append(parts)
            elif keys:
                texts[s] = None  # equal ones once
        if len(out) >= 10_000:
            yield batch_of(out)
            out.clear()
    settle()
    if out:
        yield batch_of(out)


def visual_locators(evidence: DataFrame, most: int = 3) -> DataFrame:
    """query_id, paper_id, page, object_id, place: the places of tables and figures that are worth looking at, the surest first.

    evidence: query_id, paper_id, source_type, page, object_id, confidence, seq; each place once; `most` a paper.
    """
    seen = evidence.where(F.col("source_type").isin("table", "figure") & (F.col("page") >= 1)).groupBy("query_id", "paper_id", "page", "object_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "seq")).alias("b"))
    ranked = seen.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "paper_id").orderBy("b")))
    return ranked.where(F.col("place") <= most).select("query_id", "paper_id", "page", "object_id", "place")


def last_rows(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """by, values: of rows with the same key the last by `seq`, whole."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*values), F.struct("seq", *values)).alias("r")).select(*by, "r.*")


def paper_rows(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """table, label, seq: rows of tables with a row a paper: the paper's title, or what was printed, each label of a table once.

    rows: table, paper_id, printed, seq; titles: paper_id, title. Rows without either are dropped.
    """
    met = rows.join(titles, "paper_id", "left").withColumn("label", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.nullif(F.trim("printed"), F.lit(""))))
    return met.where("label is not null").groupBy("table", flat_text("label").alias("k")).agg(F.min_by("label", "seq").alias("label"), F.min("seq").alias("seq")).select("table", "label", "seq")


def scalar_fills(rows: DataFrame, routes: DataFrame, evidence: DataFrame) -> DataFrame:
    """table, key, value, filled: null cells filled from the only number that the one sure owner of a row has as a quote.

    rows: table, key, value; routes: table, key, paper_id, status, score; evidence: table, paper_id, quote. A quote counts if it
    is nothing but a number (with ± or %). Rows with several owners, or owners with several numbers, keep their null.
    """
    number = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
    said = evidence.where(F.trim("quote").rlike(rf"^{number}(?:\s*±\s*{number})?%?$")).select("table", "paper_id", number_or_null(F.regexp_extract(F.trim("quote"), f"^({number})", 1)).alias("n")).where("n is not null").distinct()
    one = said.groupBy("table", "paper_id").agg(F.count("*").alias("k"), F.max("n").alias("n")).where("k = 1").drop("k")
    owned = routes.where(f"status = 'owned' and score >= {SURE_OWNER}").groupBy("table", "key").agg(F.count_distinct("paper_id").alias("k"), F.min("paper_id").alias("paper_id")).where("k = 1").drop("k")
    met = rows.join(owned, ["table", "key"], "left").join(one, ["table", "paper_id"], "left")
    return met.select("table", "key", F.coalesce("value", "n").alias("value"), (F.col("value").isNull() & F.col("n").isNotNull()).alias("filled"))


def alias_targets(aliases: DataFrame, targets: DataFrame) -> DataFrame:
    """table, alias, key: the only target of a table that has all words of an alias.

    aliases: table, alias; targets: table, key. An alias of one word must look like an identifier: a digit, or two capitals.
    An alias that fits several targets is none.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9]+)"), 1))
    a = aliases.select("table", "alias", words(F.col("alias")).alias("aw")).distinct().where("size(aw) > 0")
    a = a.where((F.size("aw") > 1) | F.col("alias").rlike(r"\d|[A-Z].*[A-Z]"))
    t = targets.select("table", "key", words(F.col("key")).alias("kw")).distinct()
    one = a.withColumn("word", F.element_at("aw", 1)).join(t.select("table", "key", "kw", F.explode("kw").alias("word")), ["table", "word"]).where(F.size(F.array_except("aw", "kw")) == 0)
    return one.groupBy("table", "alias").agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")


def preferred_papers(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """table, key, papers: owners of all expected keys that a printed key may stand for.

    rows: table, key; routes: table, expected, paper_id. A table has few keys; keys meet only within their table.
    """
    met = rows.select("table", "key").distinct().join(routes.where("paper_id is not null").distinct(), "table").where(tolerant(F.col("key"), F.col("expected")))
    return met.groupBy("table", "key").agg(F.array_join(F.array_sort(F.collect_set("paper_id")), ",").alias("papers"))


def emitted_value(literal: Column, typed: Column, candidates: Column, policy: str) -> Column:
    """The value of a fact by policy: `literal` as printed, `typed` if there is one, `scorer` the first candidate; else as printed."""
    if policy == "literal":
        return literal
    if policy == "typed":
        return F.coalesce(typed, literal)
    if policy == "scorer":
        return F.coalesce(F.get(candidates, F.lit(0)), literal)
    raise ValueError(f"no policy {policy}")


def null_fill_proofs(base: DataFrame, filled: DataFrame, proofs: DataFrame, table: str, row: str, value: str) -> DataFrame:
    """table, accepted, reason: whether a table filled elsewhere may be taken, all or nothing.

    It must have the same rows, no value of the base changed or taken away, and a proof (table, row) for each cell that is new.
    """
    b = base.select(table, row, F.col(value).alias("old"), F.lit(True).alias("in_base"))
    f = filled.select(table, row, F.col(value).alias("new"), F.lit(True).alias("in_filled"))
    p = proofs.select(table, row).distinct().withColumn("proved", F.lit(True))
    met = b.join(f, [table, row], "full").join(p, [table, row], "left")
    checks = met.groupBy(table).agg(F.max(F.col("in_base").isNull() | F.col("in_filled").isNull()).alias("rows"), F.max(F.col("old").isNotNull() & ~F.col("old").eqNullSafe(F.col("new"))).alias("changed"), F.max(F.col("old").isNull() & F.col("new").isNotNull() & F.col("proved").isNull()).alias("unproved"))
    reason = F.when(F.col("rows"), "other_rows").when(F.col("changed"), "changed_value").when(F.col("unproved"), "no_proof").otherwise("accepted")
    return checks.select(table, (reason == "accepted").alias("accepted"), reason.alias("reason"))
