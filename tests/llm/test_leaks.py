import random

import numpy as np
from pyspark.sql import functions as F

from quirework.llm.leaks import _edit_distances, build_index, find_leaks, _match


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 4, (500, 9)), rng.integers(0, 4, (500, 9))
    b[:200] = a[:200]
    b[np.arange(200), rng.integers(0, 9, 200)] = 9
    got = _edit_distances(a, b, 3)
    assert [min(levenshtein(list(x), list(y)), 4) for x, y in zip(a, b)] == got.tolist()


def words(rng, n, pool=400):
    return [f"w{rng.randint(0, pool)}" for _ in range(n)]


def test_recall_with_edits():
    rng = random.Random(2)
    items = [(i, words(rng, 20, 3000)) for i in range(600)]
    index = build_index([(i, " ".join(w)) for i, w in items], 13, 1)
    texts = []
    for _, w in items:
        w = w[3:16]
        k = rng.randrange(13)
        w = rng.choice([w[:k] + ["zz"] + w[k + 1 :], w[:k] + w[k + 1 :] + ["zz"], w[:k] + ["zz"] + w[k:12]])
        texts.append(" ".join(["aa"] * 5 + w + ["bb"] * 5))
    text, item, _, _ = _match(index, texts)
    found = set(zip(text.tolist(), item.tolist()))
    due = [i for i, t in enumerate(texts) if any(levenshtein(t.split()[k : k + 13], items[i][1][j : j + 13]) <= 1 for k in range(4, 7) for j in range(2, 5))]
    assert len(due) > 100 and sum((i, i) in found for i in due) >= 0.9 * len(due)


def test_recall_by_kind_of_edit():
    """A word replaced, put in or left out in the middle of an item; all are expected."""
    rng = random.Random(3)
    items = [(i, words(rng, 20, 3000)) for i in range(900)]
    index = build_index([(i, " ".join(w)) for i, w in items], 13, 1)
    texts = []
    for i, w in items:
        k = rng.randint(9, 10)
        texts.append(" ".join(["aa"] * 5 + w[:k] + [["zz"], ["zz", w[k]], []][i % 3] + w[k + 1 :] + ["bb"] * 5))
    text, item, far, _ = _match(index, texts)
    found = set(zip(text.tolist(), item.tolist()))
    for kind in range(3):
        assert sum((i, i) in found for i in range(kind, 900, 3)) >= 0.9 * 300, kind
    assert set(far.tolist()) == {1}


def test_edit_distances_of_other_lengths():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 3, (300, 8)), rng.integers(0, 3, (300, 9))
    a[:150] = np.delete(b[:150], 4, axis=1)
    for x, y in ((a, b), (b, a)):
        assert [min(levenshtein(list(p), list(q)), 3) for p, q in zip(x, y)] == _edit_distances(x, y, 2).tolist()


def test_exact_against_brute_force(spark):
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(5, 60), 50)) for i in range(30)]
    docs = []
    for d in range(200):
        w = words(rng, rng.randint(0, 80), 50)
        for _ in range(rng.randint(0, 3)):
            i = rng.choice(items)[1]
            a = rng.randrange(len(i))
            k = rng.randrange(len(w) + 1)
            w[k:k] = i[a : a + rng.randint(10, 16)]
        docs.append((d, w))
    grams = lambda w: {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
    due = {(d, i) for d, w in docs for i, v in items if grams(w) & grams(v)}
    rows = [(d, "  ".join(x.upper() if d % 2 else x for x in w)) for d, w in docs] + [(900, None), (901, ""), (902, "w1 " * 20000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumn("item_id", F.lit("clash")).withColumn("edits", F.lit(9))
    its = spark.createDataFrame([(i, " ".join(v)) for i, v in items] + [(3, " ".join(items[3][1])), (77, None), (78, "")], "item_id int, item_text string")
    for chars in (10**6, 1500):
        got = find_leaks(df, its, "doc_id", "text", "item_id", "item_text", chars_per_block=chars)
        assert {(r["doc_id"], r["item_id"]) for r in got.where("edits = 0").collect()} == due
    assert len(due) > 20
    assert find_leaks(df.limit(0), its, "doc_id", "text", "item_id", "item_text").count() == 0
    assert find_leaks(df, its.limit(0), "doc_id", "text", "item_id", "item_text").count() == 0


def test_blocks_change_nothing(spark):
    """The same rows whatever fits into a block, also where an item has several texts."""
    rng = random.Random(9)
    items = [(i % 7, " ".join(words(rng, 30))) for i in range(20)]
    docs = [(i, " ".join(words(rng, 5) + t.split()[i % 9 : i % 9 + 15] + words(rng, 4))) for i, (_, t) in enumerate(items)]
    docs += [(100, items[0][1] + " " + items[7][1])]
    left, right = spark.createDataFrame(docs, "d int, t string"), spark.createDataFrame(items, "i int, x string")
    found = [sorted(map(tuple, find_leaks(left, right, "d", "t", "i", "x", chars_per_block=n).collect())) for n in (8_000_000, 10)]
    assert found[0] == found[1] and len(found[0]) >= 20
