"""Graphs as tables of edges: connected components and consensus in cohorts of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..cluster import cut, release

LEAST_RECORDS, LEAST_VOTES, MOST_PAPERS = 6, 2, 5


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component: the least node that each can reach. nodes: node; edges: a, b.

    Large-star and small-star steps alternate (Kiveris and others): each joins every node's neighbours to the least of them,
    and the edges become stars in a logarithmic number of rounds; each round's table replaces the one before. Only edges are
    shuffled, none are gathered; the joins on a hub are between many edges and one row. Null ends and loops are no edges; a
    node without edges is its own component.
    """
    links = cut(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        for large in (True, False):
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            near = both if large else both.where("v <= u")
            least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            # Large star: neighbours above the node; small star: those below it and itself.
            joined = near.join(least, "u")
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
            old, links = links, cut(out.where("u <> v").distinct())
            release(old)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return nodes.join(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")), "node", "left").select("node", F.coalesce(F.least("node", "m"), "node").alias("component"))


def contained_names(names: DataFrame, least: int = 4) -> DataFrame:
    """name, other: names of at least so many characters of which one contains the other, both ways. names: name.

    A name that another contains begins with one of the other's runs of `least` characters: they are met there, then verified.
    """
    n = names.where(F.length("name") >= least).select("name").distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (least - 1)), lambda i: F.col("name").substr(i, F.lit(least))))
    whole = n.select(F.col("name").alias("other"), F.explode(runs).alias("run"))
    met = n.withColumn("run", F.substring("name", 1, least)).join(whole, "run").where(F.col("other").contains(F.col("name")) & (F.col("other") != F.col("name"))).select("name", "other")
    return met.unionByName(met.select(F.col("other").alias("name"), F.col("name").alias("other")))


def cohort_edges(papers: DataFrame, methods: DataFrame, anchors: DataFrame, contained: bool = True) -> DataFrame:
    """a, b: pairs of an anchor and another question that have a paper or a method name in common.

    papers: query_id, paper_id; methods: query_id, method (a key); anchors: query_id. Method names are in common when equal or,
    if `contained`, when one contains the other and both have four characters. Many questions with one paper need no pairs
    among all: each is joined to the least anchor of that paper, and each anchor likewise, which gives the same components.
    """
    named = methods.where(F.length("method") >= 3)
    shared = papers.select("query_id", F.concat(F.lit("p:"), "paper_id").alias("key")).unionByName(named.select("query_id", F.concat(F.lit("m:"), "method").alias("key"))).where("key is not null").distinct()
    central = shared.join(anchors.select("query_id"), "query_id", "left_semi")
    if contained:  # an anchor is also where its names' longer and shorter forms are
        forms = contained_names(named.select(F.col("method").alias("name"))).select(F.concat(F.lit("m:"), "name").alias("key"), F.concat(F.lit("m:"), "other").alias("form"))
        central = cut(central.unionByName(central.join(forms, "key").select("query_id", F.col("form").alias("key"))).distinct())
        shared = shared.unionByName(central).distinct()
    least = central.groupBy("key").agg(F.min("query_id").alias("b"))
    return shared.join(least, "key").select(F.col("query_id").alias("a"), "b").where("a <> b").distinct()


def cohort_consensus(members: DataFrame, papers: DataFrame, least_records: int = LEAST_RECORDS, least_votes: int = LEAST_VOTES, most_papers: int = MOST_PAPERS) -> DataFrame:
    """component, paper_id, votes, rank: papers that several questions of a large enough component have.

    members: node (a query_id), component; papers: query_id, paper_id, position. A question has one vote a paper. Papers with
    too few votes are out; a component counts if two to `most_papers` remain. Order: votes, best position, first question, id.
    """
    rows = papers.groupBy("query_id", "paper_id").agg(F.min("position").alias("position")).join(members.select(F.col("node").alias("query_id"), "component"), "query_id")
    size = members.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least_records)
    votes = rows.join(size.select("component"), "component").groupBy("component", "paper_id").agg(F.count("*").alias("votes"), F.min("position").alias("best"), F.min(F.struct("query_id", "position")).alias("seen")).where(F.col("votes") >= least_votes)
    kept = votes.withColumn("k", F.count("*").over(Window.partitionBy("component"))).where(F.col("k").between(2, most_papers))
    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("votes"), "best", "seen", "paper_id"))
    return kept.select("component", "paper_id", "votes", rank.alias("rank"))
