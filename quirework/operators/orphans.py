"""References to records that do not exist at the time of the reference.

Keys are placed in equal ranges of their 64-bit hash, so that ranges are even without sampling. The parents of a range
become sorted arrays (hash, begin of validity, latest end so far), and the references of that range stream past them in
Arrow batches, each batch looked up by binary search. A range with many references is served by several tasks, each with
its own copy of that range's parents, so no key can make one task large: memory is that of one range's parents and one
batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..cluster import parallelism

_FOREVER = np.iinfo(np.int64).max
#: References that one task should get, and parents that one range should hold.
REFERENCES_PER_TASK, PARENTS_PER_RANGE = 2_000_000, 250_000


def clean_key(key):
    """Without Unicode white space around it, in lower case."""
    return F.lower(F.regexp_replace(key, r"(?U)^\s+|\s+$", ""))


class _Parents:
    """The parents of one range, as sorted arrays."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks() if batches else None
        if table is None or not table.num_rows:
            self.h = np.empty(0, np.int64)
            return
        h = table["h"].to_numpy()
        begin = table["t"].cast(pa.int64())
        unknown = pc.is_null(begin).to_numpy(zero_copy_only=False)
        b = pc.fill_null(begin, _FOREVER).to_numpy()
        e = pc.fill_null(table["until"].cast(pa.int64()), _FOREVER).to_numpy()
        keys = table["key"].to_numpy()
        # Equal hashes of different keys are told apart by the key itself.
        order = np.lexsort((b, keys, h)) if len(np.unique(h)) != len(np.unique(keys)) else np.lexsort((b, h))
        h, b, e, keys, unknown = h[order], b[order], e[order], keys[order], unknown[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (keys[1:] != keys[:-1])]
        self.first = np.flatnonzero(new)
        self.past = np.r_[self.first[1:], len(h)]
        self.h, self.keys, self.begin = h[self.first], keys[self.first], b
        group = np.cumsum(new) - 1
        e = np.where(unknown, np.iinfo(np.int64).min, e)  # a row without a begin never holds
        self.latest = _running_max(e, group)
        self.earliest = np.where(unknown[self.first], _FOREVER, b[self.first])
        self.dated = ~unknown[self.first]

    def probe(self, h: np.ndarray, keys: np.ndarray, t: np.ndarray, timed: np.ndarray) -> np.ndarray:
        """0 present, 1 missing, 2 late, 3 deleted; for a reference without a time only 0 or 1."""
        out = np.ones(len(h), np.int8)
        if not len(self.h):
            return out
        at = np.searchsorted(self.h, h)
        found = np.full(len(h), -1)
        open_ = np.flatnonzero((at < len(self.h)) & (self.h[np.minimum(at, len(self.h) - 1)] == h))
        while len(open_):  # more than one round only where hashes collide
            same = self.keys[at[open_]] == keys[open_]
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[(at[open_] < len(self.h))]
            open_ = open_[self.h[at[open_]] == h[open_]]
        known = np.flatnonzero(found >= 0)
        k = found[known]
        lo, hi, when = self.first[k].copy(), self.past[k].copy(), t[known]
        while (gap := lo < hi).any():  # the first begin after `when`, within the key
            mid = (lo + hi) // 2
            right = gap & (self.begin[np.minimum(mid, len(self.begin) - 1)] <= when)
            lo, hi = np.where(right, mid + 1, lo), np.where(gap & ~right, mid, hi)
        before = lo > self.first[k]
        holds = before & (self.latest[np.maximum(lo - 1, 0)] > when)
        late = self.dated[k] & (self.earliest[k] > when)
        out[known] = np.where(holds | ~timed[known], 0, np.where(late, 2, 3))
        return out


def _running_max(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    import pandas as pd

    return pd.Series(values).groupby(group).cummax().to_numpy()


_REASONS = pa.array(["present", "missing", "late", "deleted"])


def _probe(carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, waiting, parents = None, [], None
        for batch in batches:
            slots = batch.column("slot").to_numpy()
            for begin, end in _runs(slots):
                part = batch.slice(begin, end - begin)
                if slots[begin] != slot:
                    slot, waiting, parents = slots[begin], [], None
                n = int(pc.sum(pc.invert(part.column("is_ref"))).as_py() or 0)
                if n:
                    waiting.append(part.slice(0, n))
                    part = part.slice(n)
                if not part.num_rows:
                    continue
                if parents is None:
                    parents, waiting = _Parents(waiting), []
                t = part.column("t").cast(pa.int64())
                code = parents.probe(part.column("h").to_numpy(), part.column("key").to_numpy(zero_copy_only=False), pc.fill_null(t, 0).to_numpy(), pc.is_valid(t).to_numpy(zero_copy_only=False))
                bad = pa.array(code > 0)
                if code.any():
                    rows = part.filter(bad)
                    yield pa.RecordBatch.from_arrays([rows.column("kept").field(i) for i in range(len(carried))] + [rows.column("t"), _REASONS.take(pa.array(code[code > 0]))], names=[*carried, "referred_at", "reason"])

    return run


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.r_[0, np.flatnonzero(x[1:] != x[:-1]) + 1, len(x)] if len(x) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def orphan_references(
    refs: DataFrame,
    parents: DataFrame,
    ref_key: str,
    ref_time: str,
    carry: list[str],
    parent_key: str,
    valid_from: str,
    valid_until: str,
    references_per_task: int = REFERENCES_PER_TASK,
    parents_per_range: int = PARENTS_PER_RANGE,
) -> DataFrame:
    """One row for each reference to a parent that is not present at the time of the reference.

    A parent is present at t if one of its rows has valid_from <= t and valid_until null or > t. Result: the columns in
    `carry`, referred_at, and reason: `missing` (no such key at all), `late` (every row begins after t) or `deleted`.
    Keys are compared trimmed and in lower case, on both sides. A null key is no reference. A reference without a time
    is only checked for `missing`. A parent row without a begin never holds, nor makes a reference `late`. Repeated
    references are reported each, repeated parents count once, other columns are ignored whatever their names. Without
    parents every reference is `missing`; without references the result is empty.
    """
    spark = refs.sparkSession
    kept = F.struct(*[refs[c].alias(c) for c in carry])
    left = refs.select(clean_key(refs[ref_key].cast("string")).alias("key"), refs[ref_time].cast("timestamp_ntz").alias("t"), kept.alias("kept")).where("key is not null").withColumn("h", F.xxhash64("key"))
    right = parents.select(clean_key(parents[parent_key].cast("string")).alias("key"), parents[valid_from].cast("timestamp_ntz").alias("t"), parents[valid_until].cast("timestamp_ntz").alias("until")).where("key is not null").distinct().withColumn("h", F.xxhash64("key"))
    width = parallelism(spark)
    ranges = max(width, -(-right.count() // parents_per_range))
    place = F.least(F.lit(ranges - 1), F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * ranges)).cast("int")
    left, right = left.withColumn("place", place), right.withColumn("place", place)
    # As many rows as there are ranges come to the driver.
    load = {r["place"]: r["n"] for r in left.groupBy("place").agg(F.count("*").alias("n")).collect()}
    copies, start, begin = [], [], 0
    for p in range(ranges):
        copies.append(max(1, -(-load.get(p, 0) // references_per_task)))
        start.append(begin)
        begin += copies[-1]
    plan = spark.createDataFrame([(p, s, c) for p, (s, c) in enumerate(zip(start, copies))], "place int, first int, copies int")
    plan = F.broadcast(plan)  # one short row a range
    spread = F.pmod(F.xxhash64("kept", "t"), F.col("copies")) if max(copies) > 1 else F.lit(0)
    left = left.join(plan, "place").select((F.col("first") + spread).cast("int").alias("slot"), F.lit(True).alias("is_ref"), "h", "key", "t", F.lit(None).cast("timestamp_ntz").alias("until"), "kept")
    right = right.join(plan, "place").select(F.explode(F.sequence("first", F.col("first") + F.col("copies") - 1)).alias("slot"), F.lit(False).alias("is_ref"), "h", "key", "t", "until", F.lit(None).cast(left.schema["kept"].dataType).alias("kept"))
    slots = right.unionByName(left).repartitionById(min(begin, 4 * width) if begin > width else begin, F.col("slot") % F.lit(min(begin, 4 * width) if begin > width else begin)).sortWithinPartitions("slot", "is_ref")
    types = {f.name: f.dataType for f in left.schema["kept"].dataType}
    schema = ", ".join(f"`{c}` {types[c].simpleString()}" for c in carry) + ", referred_at timestamp_ntz, reason string"
    return slots.mapInArrow(_probe(carry), schema)


def orphan_report(orphans: DataFrame, by: list[str]) -> DataFrame:
    """Orphans per table (the columns in `by`), month and reason. Orphans without a time are under a null month."""
    return orphans.groupBy(*by, F.date_format("referred_at", "yyyy-MM").alias("month"), "reason").agg(F.count("*").alias("n_rows"))
