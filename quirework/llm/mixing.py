"""Mixes sources to target shares of all tokens.

Each source's documents are used floor(rate) times, and once more with the probability that is left of the rate. Which
ones, the cube method decides: the vector of probabilities walks at random inside the unit cube, along directions that
change neither the expected number of documents nor the expected number of tokens, until almost all coordinates are 0 or
1. With two balancing totals any three open documents span such a direction, in closed form. The walk goes through blocks
of bounded size in parallel; of each block at most two documents stay open. They meet in a next round of blocks, until one
block a source is left, whose last documents land with the tokens' balance given up first, then the documents'.
"""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..cluster import cut
from .tokens import DEFAULT_VOCABULARY, token_counter

#: Documents of a block; a source of any size is spread over as many blocks as it needs.
BLOCK = 5_000
_EPS = 1e-9


def flight(chances: list[float], tokens: list[float], rng: random.Random) -> list[float]:
    """The chances after the walk: 0 or 1 but for at most two, with unchanged sums of chances and of chances x tokens."""
    end = list(chances)
    open_: list[int] = []
    for k in [*range(len(end)), None]:
        if k is not None and _EPS < end[k] < 1 - _EPS:
            open_.append(k)
        elif k is not None:
            end[k] = float(round(end[k]))
        while len(open_) == 3 or (len(open_) == 2 and tokens[open_[0]] == tokens[open_[1]]):
            if len(open_) == 3:
                a, b, c = (tokens[i] for i in open_)
                way = (c - b, a - c, b - a)
                if not any(way):
                    way = (1.0, -1.0, 0.0)
            else:
                way = (1.0, -1.0)
            _step(end, open_, way, rng)
            open_ = [i for i in open_ if 0.0 < end[i] < 1.0]
    return end


def _step(end: list[float], open_: list[int], way: tuple[float, ...], rng: random.Random) -> None:
    """To one of the two faces of the cube that lie on the line, at random so that expectations stay."""
    ahead = min(((1 - end[i]) if u > 0 else end[i]) / abs(u) for i, u in zip(open_, way) if u)
    back = min((end[i] if u > 0 else (1 - end[i])) / abs(u) for i, u in zip(open_, way) if u)
    by = ahead if rng.random() * (ahead + back) < back else -back
    for i, u in zip(open_, way):
        x = end[i] + by * u
        end[i] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x


def landing(chances: list[float], tokens: list[float], rng: random.Random) -> list[float]:
    """What the flight left open: first only the number of documents is kept, then nothing."""
    end = list(chances)
    while len(open_ := [i for i, x in enumerate(end) if 0.0 < x < 1.0]) > 1:
        _step(end, open_[:2], (1.0, -1.0), rng)
    for i in open_:
        end[i] = float(rng.random() < end[i])
    return end


def _blocks(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        # Long documents first: those still open at the end, whose tokens the landing gives up, are then short ones.
        table = table.sort_by([("n_tokens", "descending"), ("__order", "ascending")])
        key = f"{seed}|{level}|{table['source'][0]}|{table['__block'][0]}"
        rng = random.Random(int.from_bytes(hashlib.sha256(key.encode()).digest()[:8], "big"))
        tokens = [float(x) for x in table["n_tokens"].to_pylist()]
        end = flight(table["chance"].to_pylist(), tokens, rng)
        if last:
            end = landing(end, tokens, rng)
        return table.set_column(table.schema.get_field_index("chance"), "chance", pa.array(end, pa.float64()))

    return run


def _cube(open_: DataFrame, largest: int, seed: int) -> DataFrame:
    """doc_id, source and whether chosen (0 or 1) for documents with a chance; `largest` is the largest source's count."""
    done = None
    for level in range(20):
        blocks = max(1, -(-largest // BLOCK))
        order = F.xxhash64(F.lit(seed + level), F.col("doc_id").cast("string"))
        rows = open_.withColumn("__order", order).withColumn("__block", F.pmod(F.shiftrightunsigned("__order", 7), F.lit(blocks)))
        after = rows.groupBy("source", "__block").applyInArrow(_blocks(seed, level, blocks == 1), rows.schema).drop("__order", "__block")
        after = cut(after)
        settled = after.where("chance = 0 or chance = 1")
        done = settled if done is None else done.unionByName(settled)
        if blocks == 1:
            return done
        open_, largest = after.where("chance > 0 and chance < 1"), 2 * blocks
    raise AssertionError("each round leaves at most two documents a block")


def _name(source):
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str, text: str, source: str, seed: int = 1, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The chosen repeats of each document, and the shares that each source reaches.

    targets: source, target_share, max_repeats. Sources are compared trimmed and in lower case. The mix is as large as all
    documents of listed sources, in tokens; a source's rate is its target over its own tokens, but at most max_repeats.
    First result: doc_id, source (as in targets), n_tokens, repeats, a row for each document of a listed source. Second
    result: source, target_share, max_repeats, n_docs, n_tokens, target_tokens, used_tokens, reached_share (of the tokens
    used), short (all its documents, repeated as often as allowed, are fewer tokens than its target), a row for each source.

    Documents with null or unlisted sources are not used. Null and empty texts have no tokens and are repeated like
    others. Rows with the same doc_id and source are one document (the longest counts). A null target_share is 0, a null
    max_repeats 1; of several rows for a source the largest values hold. Without documents nothing is reached.
    """
    spark = docs.sparkSession
    goal = targets.where(targets["source"].isNotNull()).groupBy(_name(targets["source"]).alias("__name")).agg(F.min("source").alias("source"), F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    goal = cut(goal)  # a row a source
    kind = docs.schema[doc_id].dataType.simpleString()
    listed = docs.select(docs[doc_id].alias("doc_id"), _name(docs[source]).alias("__name"), docs[text].alias("text")).join(goal.select("__name", "source"), "__name").select("doc_id", "source", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(vocabulary)
        for batch in batches:
            n = pa.array([counter(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=["doc_id", "source", "n_tokens"])

    sized = listed.mapInArrow(count, f"doc_id {kind}, source string, n_tokens long")
    sized = cut(sized.groupBy("doc_id", "source").agg(F.max("n_tokens").alias("n_tokens")))
    totals = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    whole = F.coalesce(F.sum("n_tokens").over(_everything()), F.lit(0))  # over a row a source
    plan = goal.drop("__name").join(totals, "source", "left").fillna(0, ["n_docs", "n_tokens"]).withColumn("target_tokens", F.col("target_share") * whole)
    plan = plan.withColumn("rate", F.when(F.col("n_tokens") > 0, F.least(F.col("target_tokens") / F.col("n_tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0))
    plan = cut(plan.withColumn("short", F.col("n_tokens") * F.col("max_repeats") < F.col("target_tokens")))
    rated = sized.join(plan.select("source", "rate"), "source").select("doc_id", "source", "n_tokens", F.floor("rate").alias("sure"), (F.col("rate") - F.floor("rate")).alias("chance"))
    largest = plan.agg(F.max("n_docs")).first()[0] or 0
    chosen = _cube(rated.where("chance > 0"), largest, seed)
    sure = rated.where("chance = 0").select("doc_id", "source", "n_tokens", F.col("sure").alias("repeats"))
    repeats = sure.unionByName(chosen.select("doc_id", "source", "n_tokens", (F.col("sure") + F.col("chance").cast("long")).alias("repeats")))
    used = repeats.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("used_tokens"))
    shares = plan.join(used, "source", "left").fillna(0, ["used_tokens"])
    shares = shares.withColumn("reached_share", F.coalesce(F.col("used_tokens") / F.nullif(F.sum("used_tokens").over(_everything()), F.lit(0)), F.lit(0.0)))
    return repeats, shares.select("source", "target_share", "max_repeats", "n_docs", "n_tokens", "target_tokens", "used_tokens", "reached_share", "short")


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
