"""Builds the stores that strategies read (passages, objects, aliases, relations) from pages and papers, and opens them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..cluster import cut
from ..operators import corpus as C, entities as N
from ..sinks.files import write_store

#: What each store holds; stores are opened with this schema, whatever else lies in the files.
STORES = {
    "passages": "chunk_id string, paper_id string, page int, section_kind string, text string",
    "objects": "object_key string, paper_id string, source_type string, scorer_visible_id string, parser_visible_id string, page int, caption string",
    "aliases": "alias string, alias_key string, expansion string, paper_id string, page int, source string, support string, scope string, df long, confidence double",
    "relations": "relation_id string, source_paper_id string, target_paper_id string, mention string, support struct<page: int, source_type: string, text: string>, confidence double, resolution_status string",
}
CONFIDENCES = {"body_definition": 1.0, "title": 1.0, "abstract": 1.0, "body_coinage": 0.9, "bare_mixedcase": 0.4}


def passage_records(pages: DataFrame, headings: DataFrame, most: int = 300) -> DataFrame:
    """pages: paper_id, page, text; headings: paper_id, page, line_no, kind. Ids are `paper:pPAGE:cN`."""
    placed = C.active_section(pages, headings, "paper_id", "page", "line_no")
    packed = C.passages(placed, ["paper_id", "page", "section_kind"], "text", most)
    return packed.select(F.concat(F.col("paper_id"), F.lit(":p"), "page", F.lit(":c"), "n").alias("chunk_id"), "paper_id", "page", "section_kind", F.col("passage").alias("text"))


def object_records(lines: DataFrame) -> DataFrame:
    """Captions as objects; of the captions of one object the first counts. lines: paper_id, page, line_no, line."""
    found = C.captions(lines)
    key = F.concat_ws(":", "paper_id", "source_type", F.regexp_extract("scorer_visible_id", r"(\d+)$", 1))
    rest = ["source_type", "scorer_visible_id", "parser_visible_id", "page", "caption"]
    first = found.groupBy("paper_id", key.alias("object_key")).agg(F.min_by(F.struct(*rest), F.struct("page", "line_no", "caption")).alias("r"))
    return first.select("object_key", "paper_id", "r.*")


def alias_records(pages: DataFrame, papers: DataFrame) -> DataFrame:
    """Aliases that pages, titles and abstracts define, coin, or use again and again, with their scope over all papers."""
    about = papers.select("paper_id", F.explode(F.create_map(F.lit("title"), "title", F.lit("abstract"), "abstract")).alias("source", "text")).where("text is not null")
    texts = pages.select("paper_id", "page", F.lit("body_definition").alias("source"), "text").unionByName(about.select("paper_id", F.lit(None).cast("int").alias("page"), "source", "text"))
    keys = ["paper_id", "page", "source"]
    defined = N.defined_aliases(texts, keys, "text").select(*keys, "alias", "expansion")
    coined = N.coined_aliases(pages, ["paper_id", "page"], "text").select("paper_id", "page", F.lit("body_coinage").alias("source"), "alias", F.lit("").alias("expansion"))
    whole = texts.select("paper_id", "text")
    bare = N.cued_names(N.recurring_names(whole, "paper_id", "text"), whole, "paper_id", "text", papers.select("paper_id", "title"))
    bare = bare.select("paper_id", F.lit(None).cast("int").alias("page"), F.lit("bare_mixedcase").alias("source"), "alias", F.lit("").alias("expansion"))
    worth = F.create_map(*[F.lit(x) for pair in CONFIDENCES.items() for x in pair])
    hits = defined.unionByName(coined).unionByName(bare)
    hits = hits.select("*", F.concat_ws(" ", "expansion", F.concat(F.lit("("), "alias", F.lit(")"))).alias("support"), worth[F.col("source")].alias("confidence"), F.struct(F.coalesce("page", F.lit(0)).alias("p"), "alias", "expansion").alias("seq"))
    kept = cut(N.collected_aliases(hits))
    scopes = N.alias_scope(kept, papers.agg(F.count_distinct("paper_id").alias("n")))
    return kept.join(scopes, "alias_key").select("alias", "alias_key", "expansion", "paper_id", "page", "source", "support", "scope", "df", "confidence")


def relation_records(objects: DataFrame, passages: DataFrame, papers: DataFrame) -> DataFrame:
    found = cut(N.mentions(objects.where("source_type = 'table'").select("paper_id", "page", "caption"), passages.select("paper_id", "page", "section_kind", "text")))
    edges = N.relations(found, N.resolve_mentions(found, papers))
    best = found.select(F.col("paper_id").alias("source_paper_id"), "mention", F.struct("page", "source_type", F.col("support_text").alias("text")).alias("support"))
    return edges.drop("source_type").join(best, ["source_paper_id", "mention"]).select("relation_id", "source_paper_id", "target_paper_id", "mention", "support", "confidence", "resolution_status")


def build_indexes(pages: DataFrame, papers: DataFrame, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """Writes all stores, or those named and what they are made of, under the folder and opens them. pages: paper_id, page, text; papers: paper_id, title, abstract.

    Pages without a paper or a number are left out, pages of the same number are put together in no other order than their
    texts'. A folder that has a store already is refused before anything is written.
    """
    spark = papers.sparkSession
    sc = spark.sparkContext
    names = list(names or STORES)
    if unknown := set(names) - STORES.keys():
        raise KeyError(f"no stores {sorted(unknown)}")
    for name in STORES:
        at = sc._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            raise FileExistsError(f"{folder}/{name}")
    p = cut(pages.where("paper_id is not null and page is not null and text is not null").groupBy("paper_id", F.col("page").cast("int").alias("page")).agg(F.array_join(F.array_sort(F.collect_list("text")), "\n").alias("text")))
    lines = C.page_lines(p, ["paper_id", "page"], "text")
    made = {"passages": passage_records(p, C.sections(lines).select("paper_id", "page", "line_no", "kind")), "objects": object_records(lines)}
    for name, df in made.items():
        if name in names or "relations" in names:
            _write(df, name, folder)
    if "aliases" in names:
        _write(alias_records(p, papers), "aliases", folder)
    if "relations" in names:
        opened = load_indexes(spark, folder, ["passages", "objects"])
        _write(relation_records(opened["objects"], opened["passages"], papers), "relations", folder)
    return load_indexes(spark, folder, names)


def _write(records: DataFrame, name: str, folder: str) -> None:
    order = {"relations": ["source_paper_id"]}.get(name, ["paper_id"])
    write_store(records, f"{folder}/{name}", order)


def load_indexes(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    """The stores by name, with their schemas; nothing is parsed again."""
    return {name: spark.read.schema(STORES[name]).parquet(f"{folder}/{name}") for name in names or STORES}


def build_report(stores: dict[str, DataFrame]) -> DataFrame:
    """store, records, papers: what a build gave."""
    out = None
    for name, df in stores.items():
        paper = "source_paper_id" if name == "relations" else "paper_id"
        row = df.agg(F.lit(name).alias("store"), F.count("*").alias("records"), F.count_distinct(paper).alias("papers"))
        out = row if out is None else out.unionByName(row)
    return out
