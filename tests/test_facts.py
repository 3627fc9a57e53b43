import random

from quirework.operators import facts


def test_attested_keys_in_blocks(spark, monkeypatch):
    """As by looking into each text, however many sources of a paper are taken together, and no text with each of its words."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 14)}"
    sources = [(f"p{rng.choice([0, 0, 0, 1, 2])}", " ".join(word() for _ in range(6))) for _ in range(80)] + [("p0", None), (None, "w1 w2"), ("p1", "W1,  w2!"), ("p1", "W1,  w2!")]
    keys = [(i, f"p{rng.randint(0, 3)}", rng.choice([[word()], [word(), word()], [f"{word()} {word()}"], [word(), f"{word()}-{word()}"]])) for i in range(120)]
    keys += [(200, "p1", ["w1 W2"]), (201, "p1", ["w1", " "]), (202, "p1", []), (203, "p1", ["!", "w1"]), (204, "p1", ["w1", "!"]), (205, None, ["w1"])]
    flat = lambda t: f" {' '.join(''.join(c if c.isalnum() else ' ' for c in t.lower()).split())} "
    due = {(i, "|".join(k)) for i, p, k in keys if k and all(x.strip() for x in k) and any(q == p and t and p and all(flat(x) in flat(t) and flat(x).strip() for x in k) for q, t in sources)}
    expected, texts = spark.createDataFrame(keys, "table int, paper_id string, key array<string>"), spark.createDataFrame(sources, "paper_id string, text string")
    for most in (4_096, 7):
        monkeypatch.setattr(facts, "SOURCES_AT_ONCE", most)
        assert {(r["table"], "|".join(r["key"])) for r in facts.attested_keys(expected, texts).collect()} == due and due
