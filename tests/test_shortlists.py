import random

from quirework.operators.shortlists import target_of


def test_targets_of_names(spark):
    """As by comparing each name with each target of its question; the many titles of a question make no pairs."""
    rng = random.Random(7)
    some = lambda: " ".join(rng.choice(["Alpha", "beta", "Gamma-2", "x"]) for _ in range(rng.randint(1, 4)))
    names = [(f"q{rng.randint(0, 3)}", some()) for _ in range(60)] + [("q0", " K7 "), ("q0", "!!"), ("q0", None), ("q9", "alone"), ("q1", "ALPHA"), ("q1", "alpha")]
    targets = [(f"q{rng.randint(0, 3)}", i, f"k{i}", rng.choice([some(), "the x", "", None]), rng.choice(["target", "constraint"])) for i in range(40)]
    flat = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in (t or '').lower()).split())} "
    held = lambda a, b: len(flat(b)) > 2 and flat(b) in flat(a)
    due = set()
    for q, name in names:
        met = [(i, k, role) for p, i, k, text, role in targets if p == q and (name is not None and name.strip().lower() == k or held(text, name) or held(name, text))]
        due.add((q, name, *(min(met)[1:] if met and name is not None else (name and name.strip(), "target"))))
    got = target_of(spark.createDataFrame(names, "query_id string, name string"), spark.createDataFrame(targets, "query_id string, seq int, key string, text string, role string"))
    assert {tuple(r) for r in got.collect()} == due
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert not [line for line in plan.splitlines() if "join" in line and "contains" in line and "query_id" in line]
