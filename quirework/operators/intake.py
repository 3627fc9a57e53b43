"""What comes in: pages, failed documents, typed cells of proposed rows, and checks before a run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import number_or_null

TRUTH = {"true": True, "false": False, "yes": True, "no": False}


def numbered_pages(documents: DataFrame, keep: list[str], pages: str) -> DataFrame:
    """keep, page from 1, text: the pages of documents (an array of texts), in order; a null page is an empty one."""
    return documents.select(*keep, F.posexplode(pages).alias("i", "t")).select(*keep, (F.col("i") + 1).alias("page"), F.coalesce("t", F.lit("")).alias("text"))


def artifacts(documents: DataFrame, parsed: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """key, lists, error: one record a document: what was parsed, or empty lists and why not.

    parsed: key, lists, error. A document with an error, or that nobody parsed (`not parsed`), has empty lists; null lists are empty.
    Of several results of a document one without an error counts, of those the first by its texts.
    """
    best = parsed.groupBy(key).agg(F.min_by(F.struct(*lists, "error"), F.struct(F.col("error").isNotNull(), F.to_json(F.struct(*lists, "error")))).alias("r"))
    met = documents.select(key).distinct().join(best, key, "left")
    error = F.when(F.col("r").isNull(), "not parsed").otherwise(F.col("r.error"))
    kinds = {f.name: f.dataType for f in parsed.schema}
    return met.select(key, *[F.when(error.isNull(), F.coalesce(F.col(f"r.{c}"), F.array().cast(kinds[c]))).otherwise(F.array().cast(kinds[c])).alias(c) for c in lists], error.alias("error"))


def collection_key(rows: DataFrame, key: str, order: str, model: str) -> DataFrame:
    """key: a name for what was made of these ids in this order by this model; other texts under the same ids don't change it.

    Each id is hashed with its place; the hashes are summed, so that no list of all ids is ever in one place. Ids must have
    different places.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws(":", F.col(order).cast("string"), F.col(key))), 1, 12), 16, 10).cast("decimal(38,0)")
    whole = rows.where(F.col(key).isNotNull()).agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("s"))
    return whole.select(F.sha2(F.concat_ws("|", F.lit(model), "n", "s"), 256).alias("key"))


def typed_cells(cells: DataFrame) -> DataFrame:
    """row_id, name, kind, number, truth, words: cells (row_id, name, kind, raw) as what their column holds; what is none is null.

    A number may have a percent sign, thousands commas and white space around it; a truth value is true, false, yes or no;
    a text is trimmed, white space collapsed, and `-`, `n/a` and `none` are no texts. A name that a row has twice voids the row.
    """
    raw = F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"\s+", " "))
    number = number_or_null(F.regexp_replace(F.regexp_replace(raw, r"\s*%$", ""), r"(?<=\d),(?=\d{3}(?:\D|$))", ""))
    truth = F.create_map(*[F.lit(x) for pair in TRUTH.items() for x in pair])[F.lower(raw)]
    words = F.when((raw != "") & ~F.lower(raw).isin("-", "n/a", "none"), raw)
    void = cells.groupBy("row_id", "name").agg(F.count("*").alias("n")).where("n > 1").select("row_id").distinct()
    kind = F.col("kind")
    return cells.join(void, "row_id", "left_anti").select("row_id", "name", "kind", F.when(kind == "number", number).alias("number"), F.when(kind == "boolean", truth).alias("truth"), F.when(kind == "string", words).alias("words"))


def preflight(stores: dict[str, tuple[DataFrame, str]], aligned: list[tuple[str, str]]) -> DataFrame:
    """store, check, n: what is wrong before a run: no rows, null or repeated ids, ids of one store that another lacks.

    stores: name to table and its id; aligned: pairs of names, the ids of the first of which must be in the second. Checks without
    faults have no row.
    """

    def fault(store: str, check: str, n: Column, df: DataFrame) -> DataFrame:
        return df.agg(n.alias("n")).select(F.lit(store).alias("store"), F.lit(check).alias("check"), F.col("n").cast("long").alias("n"))

    found = []
    for name, (df, key) in stores.items():
        found.append(fault(name, "empty", F.when(F.count("*") == 0, 1).otherwise(0), df))
        found.append(fault(name, "null_id", F.count_if(F.col(key).isNull()), df))
        found.append(fault(name, "repeated_id", F.count("*"), df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("k")).where("k > 1")))
    for a, b in aligned:
        (left, x), (right, y) = stores[a], stores[b]
        ids = right.select(F.col(y).alias("__id")).where("__id is not null").distinct()
        found.append(fault(a, f"not_in_{b}", F.count("*"), left.where(F.col(x).isNotNull()).select(F.col(x).alias("__id")).distinct().join(ids, "__id", "left_anti")))
    return reduce(DataFrame.unionByName, found).where("n > 0")
