"""Pairs and groups of records that are the same but for small edits, by prefixes under several global orders.

Two sets whose Jaccard similarity reaches the threshold must, under every total order of all elements, share an element
early in both: among the first |x| - a + 1 of the one and the first |y| - a + 1 of the other, where a is the overlap that
the threshold asks for. Each order is a filter of its own, and a pair is a candidate only if it passes all of them. The
orders used put elements that are rare in the whole collection first, but break ties (most elements are rare) differently,
so that two records which share but some common phrase rarely pass all. A pair is dropped where it is met if the parities
of the two sets (one bit for each of 256 parts of all elements) differ in more places than the sets may. What is left is
verified on the whole sets.

Rarity is estimated by counters in a table of fixed size over the records' elements, all of them; any order gives the same
pairs, a good one gives fewer candidates. Records with equal sets are one class from the start, so that many copies cost no
more than one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..cluster import cut
from .consistent import ConsistentForm, words_of

#: Counters for the elements' frequencies; their number is fixed, whatever the collection.
COUNTERS = 1 << 18
ORDERS = 2
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt * 0x9E3779B9 + 0x7F4A7C15)) * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    return x ^ (x >> np.uint64(29))


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    import xxhash

    if len(words) < n:
        return np.empty(0, np.int64)
    ids = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = _mixed(h ^ ids[k : k + len(h)], k + 1)
    return np.unique(h.view(np.int64))


def element_sets(df: DataFrame, key: str, texts: list[str], n: int) -> DataFrame:
    """key, elements: the distinct runs of n words of the texts, joined by spaces; rows with a null or empty text are out."""
    usable = [df[t].isNotNull() & (df[t] != "") for t in texts]
    rows = df.where(df[key].isNotNull())
    for x in usable:
        rows = rows.where(x)
    rows = rows.select(df[key].alias("key"), F.concat_ws(" ", *[df[t] for t in texts]).alias("text"))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form = ConsistentForm()
        for batch in batches:
            sets = [shingle_hashes(words_of(t), n) for t in form(batch.column(1)).to_pylist()]
            offsets = pa.array(np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32))
            flat = pa.array(np.concatenate(sets) if sets else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["key", "elements"])

    return rows.mapInArrow(run, f"key {kind}, elements array<long>").where("size(elements) > 0")


def _least_overlap(a, b, threshold):
    """The overlap that the threshold asks of two sets of these sizes; the small amount is for rounding."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def _parities(x: np.ndarray) -> np.ndarray:
    """Four numbers of 64 bits: of each part, whether it has an odd number of the elements. An element that only one of two
    sets has changes one bit, so the sets differ in at least as many elements as their parities in bits."""
    odd = np.bincount((_mixed(x, 999) >> np.uint64(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(counters: np.ndarray, threshold: float, orders: int):
    """Each set's elements that the filters need: order, element, position, size, whether a shorter set's prefix has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            owners, bits = [], []
            offsets, flat = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy().view(np.uint64)
            for i in range(batch.num_rows):
                x = flat[offsets[i] : offsets[i + 1]]
                size = len(x)
                bits.append(_parities(x))
                count = counters[x % np.uint64(len(counters))]
                probe = size - int(np.ceil(threshold * size - 1e-9)) + 1  # as the longer set of a pair
                index = size - int(_least_overlap(size, size, threshold)) + 1  # as the shorter one
                for o in range(orders):
                    # The second and further orders see frequencies only roughly, so their ties differ.
                    rank = count if o == 0 else np.log2(count + 1).astype(np.int64)
                    first = np.lexsort((_mixed(x, o + 101), rank))[: max(probe, index)]
                    out[0].append(np.full(len(first), o, np.int8))
                    out[1].append(x[first].view(np.int64))
                    out[2].append(np.arange(len(first), dtype=np.int32))
                    out[3].append(np.full(len(first), size, np.int32))
                    out[4].append(np.arange(len(first)) < index)
                    owners.append(np.full(len(first), i))
            if owners:
                who = np.concatenate(owners)
                parity = np.stack(bits)[who]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), *(pa.array(np.concatenate(c)) for c in out), *(pa.array(parity[:, k]) for k in range(4))], names=["id", "o", "element", "at", "size", "short", "b0", "b1", "b2", "b3"])

    return run


def _frequencies(sets: DataFrame, counters: int) -> np.ndarray:
    """How often the elements of each counter occur, over all sets; as many numbers as there are counters come back."""
    rows = sets.select(F.explode("elements").alias("e")).select((F.pmod("e", F.lit(counters))).alias("e")).groupBy("e").agg(F.count("*").alias("n"))
    table = rows.toArrow()
    out = np.zeros(counters, np.int64)
    out[table["e"].to_numpy()] = table["n"].to_numpy()
    return out


def _unsigned_mod(counters: int) -> None:
    """pmod on signed numbers equals the remainder of the unsigned ones, for powers of two."""
    if counters & (counters - 1):
        raise ValueError("counters must be a power of two")


def similar_sets(sets: DataFrame, threshold: float, orders: int = ORDERS, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and all pairs of classes whose Jaccard similarity is at least `threshold`.

    sets: key, elements (sorted, distinct). First result: key, id (of the set), class (the least key with that set). Second
    result: p, q (ids), a, b (their classes, in order), overlap, similarity. Exact but for equal 64-bit hashes of different elements.
    """
    spark = sets.sparkSession
    _unsigned_mod(counters)
    if not 0 < threshold <= 1:
        raise ValueError("0 < threshold <= 1 must hold")
    # A hash of the whole set stands for it.
    marked = cut(sets.withColumn("id", F.xxhash64("elements")))
    classes = marked.select("key", "id").distinct()
    names = classes.groupBy("id").agg(F.min("key").alias("class"))
    leaders = cut(marked.groupBy("id").agg(F.first("elements").alias("elements")))
    shared = spark.sparkContext.broadcast(_frequencies(leaders, counters))  # of fixed size

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _prefixes(shared.value, threshold, orders)(batches)

    rows = cut(leaders.mapInArrow(prefixes, "id long, o tinyint, element long, at int, size int, short boolean, b0 long, b1 long, b2 long, b3 long"))
    x, y = rows.where("short").alias("x"), rows.alias("y")
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("x.size") + F.col("y.size")) - F.lit(1e-9))
    # The first element that a pair shares leaves room for the overlap only if it lies early in both.
    early = F.least(F.col("x.size") - F.col("x.at"), F.col("y.size") - F.col("y.at")) >= need
    apart = sum((F.bit_count(F.col(f"x.b{k}").bitwiseXOR(F.col(f"y.b{k}"))) for k in range(4)), F.lit(0))
    met = x.join(
        y,
        (F.col("x.o") == F.col("y.o"))
        & (F.col("x.element") == F.col("y.element"))
        & ((F.col("x.size") < F.col("y.size")) | ((F.col("x.size") == F.col("y.size")) & (F.col("x.id") < F.col("y.id"))))
        & (F.col("x.size") >= F.lit(threshold) * F.col("y.size") - F.lit(1e-9))
        & early
        & (apart <= F.col("x.size") + F.col("y.size") - 2 * need),
    )
    passed = met.groupBy(F.col("x.id").alias("p"), F.col("y.id").alias("q")).agg(F.count_distinct("x.o").alias("orders")).where(F.col("orders") == orders)
    passed = cut(passed.select("p", "q"))
    wanted = leaders.join(passed.select(F.explode(F.array("p", "q")).alias("id")).distinct(), "id", "left_semi")
    both = passed.join(wanted.select(F.col("id").alias("p"), F.col("elements").alias("ep")), "p").join(wanted.select(F.col("id").alias("q"), F.col("elements").alias("eq")), "q")
    overlap = both.select("p", "q", F.size(F.array_intersect("ep", "eq")).alias("overlap"), (F.size("ep") + F.size("eq")).alias("sum"))
    similarity = F.col("overlap") / (F.col("sum") - F.col("overlap"))
    found = cut(overlap.select("p", "q", "overlap", similarity.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12))
    pairs = found.join(names.select(F.col("id").alias("p"), F.col("class").alias("cp")), "p").join(names.select(F.col("id").alias("q"), F.col("class").alias("cq")), "q")
    pairs = pairs.select("p", "q", F.least("cp", "cq").alias("a"), F.greatest("cp", "cq").alias("b"), "overlap", "similarity")
    return classes.join(names, "id").select("key", "id", "class"), pairs


def near_duplicates(df: DataFrame, key: str, texts: list[str], words: int = 5, threshold: float = 0.8, orders: int = ORDERS) -> tuple[DataFrame, DataFrame]:
    """Classes of records with equal content, and the pairs of classes that are near duplicates of each other.

    Content is the set of runs of `words` words of the texts in their consistent, lower-cased form. First result: key, id,
    class for each distinct key with all texts neither null nor empty (and at least `words` words); second: p, q (ids), a, b
    (classes), overlap, similarity (Jaccard, at least `threshold`). No link between different contents is lost, copies within a class
    are not multiplied. Rows with a null key are out; a key with several rows is one record, which has the content of each
    of them: it is in the class of each and linked by each. Other columns are ignored. Empty tables give empty results.
    """
    return similar_sets(element_sets(df, key, texts, words), threshold, orders)


def expand_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: all pairs of different keys, a < b, within a class or across two linked ones. As many rows as there are pairs."""
    one, two = classes.select(F.col("key").alias("a"), F.col("id").alias("p")), classes.select(F.col("key").alias("b"), F.col("id").alias("q"))
    within = one.join(two, F.col("p") == F.col("q")).select("a", "b").where("a < b")
    across = pairs.select("p", "q").join(one, "p").join(two, "q").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    return within.unionByName(across).distinct()
