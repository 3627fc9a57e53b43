import random
from itertools import combinations

import pytest

from quirework.llm.near import expand_pairs, near_duplicates


def grams(text, n):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1))


@pytest.mark.parametrize("n, threshold", [(3, 0.55), (5, 0.8), (1, 1.0)])
def test_pairs_against_brute_force(spark, n, threshold):
    rng = random.Random(n)
    rows = []
    for i in range(120):
        w = [f"w{min(rng.randint(0, 400), rng.randint(0, 400))}" for _ in range(rng.randint(1, 60))]
        rows.append((f"k{i:03}", " ".join(w[:3]), " ".join(w[3:]), "x"))
        for j in range(rng.choice([0, 0, 1, 4])):
            v = list(w)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(v))
                v[at : at + rng.randint(0, 1)] = rng.choice([[], ["new"], ["a", "b"]])
                v = v or ["z"]
            rows.append((f"k{i:03}v{j}", " ".join(v[:3]).upper(), " ".join(v[3:]), "y"))
    rows += [rows[0], rows[1], ("n1", None, "a b c d e f", "x"), ("n2", "a b c", "", "x"), (None, "a b c", "d e f", "x"), ("long", "a b c", "t u v " * 30_000, "x")]
    texts = {k: f"{t} {a}" for k, t, a, _ in rows if k and t and a}
    sets = {k: grams(t, n) for k, t in texts.items()}
    due = {(a, b) for a, b in combinations(sorted(k for k, s in sets.items() if s), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame(rows, "paper string, title string, abstract string, elements string")
    classes, pairs = near_duplicates(df, "paper", ["title", "abstract"], n, threshold)
    got = {(r["a"], r["b"]) for r in expand_pairs(classes, pairs).collect()}
    assert got == due and len(due) > 50
    member = {r["key"]: r["class"] for r in classes.collect()}
    assert member == {k: min(j for j in sets if sets[j] == s) for k, s in sets.items() if s}
    for r in pairs.collect():
        a, b = sets[r["a"]], sets[r["b"]]
        assert r["overlap"] == len(a & b) and r["similarity"] == pytest.approx(len(a & b) / len(a | b))


def test_a_key_with_two_contents(spark):
    w = [f"w{i}" for i in range(40)]
    one, two = " ".join(w[:20]), " ".join(w[20:])
    df = spark.createDataFrame([("a", one), ("a", two), ("b", one), ("c", two)], "paper string, title string")
    got = expand_pairs(*near_duplicates(df, "paper", ["title"]))
    assert {(r["a"], r["b"]) for r in got.collect()} == {("a", "b"), ("a", "c")}


def test_nothing(spark):
    df = spark.createDataFrame([], "paper string, title string, abstract string")
    classes, pairs = near_duplicates(df, "paper", ["title", "abstract"])
    assert classes.count() == 0 and pairs.count() == 0 and expand_pairs(classes, pairs).count() == 0
    with pytest.raises(ValueError):
        near_duplicates(df, "paper", ["title"], threshold=0)
