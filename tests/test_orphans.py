import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirework.operators.orphans import orphan_references, orphan_report

T0 = datetime(2024, 1, 1)


def brute(refs, parents):
    clean = lambda k: k.strip().lower()
    out = []
    for row, key, t in refs:
        if key is None:
            continue
        mine = [p for p in parents if p[0] is not None and clean(p[0]) == clean(key)]
        if not mine:
            out.append((row, "missing"))
        elif t is not None and not any(a is not None and a <= t and (w is None or w > t) for _, a, w in mine):
            dated = [a for _, a, _ in mine if a is not None]
            out.append((row, "late" if dated and min(dated) > t else "deleted"))
    return sorted(out)


def frames(spark, refs, parents):
    r = spark.createDataFrame([(*x, "clash", 1) for x in refs], "row_id long, paper string, seen timestamp_ntz, slot string, h int")
    p = spark.createDataFrame([(*x, "clash") for x in parents], "paper string, since timestamp_ntz, until timestamp_ntz, key string")
    return r, p


@pytest.mark.parametrize("per_task, per_range", [(10**6, 10**6), (7, 5)])
def test_against_brute_force(spark, per_task, per_range):
    rng = random.Random(3)
    at = lambda: T0 + timedelta(days=rng.randint(0, 9))
    keys = [f"k{i}" for i in range(25)]
    parents = [(rng.choice([k, k.upper(), f" {k} "]), rng.choice([None, at(), at()]), rng.choice([None, at()])) for k in keys[:20] for _ in range(rng.randint(0, 4))]
    parents += parents[:3] + [(None, T0, None)]
    refs = [(i, "hot" if i % 3 == 0 else rng.choice([*keys, None, " K1 ", ""]), rng.choice([None, at(), at(), at()])) for i in range(600)]
    parents += [("hot", at(), at()) for _ in range(8)]
    r, p = frames(spark, refs, parents)
    got = orphan_references(r, p, "paper", "seen", ["row_id"], "paper", "since", "until", per_task, per_range)
    assert sorted((x["row_id"], x["reason"]) for x in got.collect()) == brute(refs, parents)
    report = orphan_report(got.withColumn("src", F.lit("r")), ["src"])
    assert sum(x["n_rows"] for x in report.collect()) == len(brute(refs, parents))


def test_empty(spark):
    refs, parents = [(1, "a", T0), (1, "a", T0), (2, None, T0)], [("a", T0, None)]
    r, p = frames(spark, refs, parents)
    args = ("paper", "seen", ["row_id", "slot"], "paper", "since", "until")
    assert orphan_references(r, p, *args).count() == 0
    assert [x["reason"] for x in orphan_references(r, p.limit(0), *args).collect()] == ["missing"] * 2
    assert orphan_references(r.limit(0), p, *args).count() == 0
