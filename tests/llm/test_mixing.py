import random

import pytest

from quirework.llm import mixing
from quirework.llm.mixing import flight, landing, mix_sources
from quirework.llm.tokens import DEFAULT_PATTERN, DEFAULT_VOCABULARY, token_counter


def test_flight_keeps_both_totals_and_expectations():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 1000):
        tokens = [float(rng.choice([1, 5, 5, 5, 100, 30_000, rng.randint(1, 999)])) for _ in range(n)]
        start = [rng.random() for _ in range(n)]
        end = flight(start, tokens, rng)
        assert sum(0 < x < 1 for x in end) <= 2
        assert sum(end) == pytest.approx(sum(start), abs=1e-6)
        assert sum(a * t for a, t in zip(end, tokens)) == pytest.approx(sum(a * t for a, t in zip(start, tokens)), rel=1e-6)
        assert set(landing(end, tokens, rng)) <= {0.0, 1.0}
    start, tokens = [0.3, 0.7, 0.5, 0.5, 0.9], [1.0, 2.0, 3.0, 9.0, 4.0]
    mean = [sum(x) / 4000 for x in zip(*(landing(flight(start, tokens, rng), tokens, rng) for _ in range(4000)))]
    assert mean == pytest.approx(start, abs=0.04)


def test_token_counter():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(DEFAULT_VOCABULARY, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=DEFAULT_PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng, count = random.Random(2), token_counter()
    for _ in range(500):
        text = "".join(rng.choice(["a", "the", " ", " ", "\n", "\n\n", "'s", "12", "é", " ", ".", "ß", "<|endoftext|>"]) for _ in range(rng.randint(0, 40)))
        assert count(text) == len(encoding.encode_ordinary(text)), repr(text)
    assert count(None) == count("") == 0


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 50)
    rng = random.Random(3)
    docs = [(i, "word " * rng.randint(1, 60), rng.choice(["Big", " big", "BIG ", "small"] if i % 20 else ["tiny", None, "other"]), "x") for i in range(1500)]
    docs += [docs[1], docs[1], (9000, None, "big", "y"), (9001, "", "small", "z")]
    frame = spark.createDataFrame(docs, "doc_id int, text string, source string, rate string")
    targets = spark.createDataFrame([("Big", 0.2, 3), ("small", 0.5, 4), ("tiny", 0.25, 2), ("none", 0.05, 9)], "source string, target_share double, max_repeats int")
    repeats, shares = mix_sources(frame, targets, "doc_id", "text", "source")
    repeats = repeats.collect()
    kind = {d: (s or "").strip().lower() for d, _, s, _ in docs}
    assert sorted(r["doc_id"] for r in repeats) == sorted(d for d, k in kind.items() if k in ("big", "small", "tiny"))
    got = {r["source"]: r for r in shares.collect()}
    total = sum(r["n_tokens"] for r in repeats)
    for name in ("Big", "small"):
        mine = [r for r in repeats if r["source"] == name]
        assert got[name]["used_tokens"] == sum(r["repeats"] * r["n_tokens"] for r in mine)
        assert got[name]["used_tokens"] == pytest.approx(got[name]["target_tokens"], abs=130)  # two documents
        rate = got[name]["target_tokens"] / got[name]["n_tokens"]
        assert {r["repeats"] for r in mine} <= {int(rate), int(rate) + 1}
        assert sum(r["repeats"] for r in mine) == pytest.approx(rate * len(mine), abs=1.001)
    assert got["Big"]["target_tokens"] == pytest.approx(0.2 * total)
    assert {r["repeats"] for r in repeats if r["source"] == "tiny"} == {2}
    assert {s for s, r in got.items() if r["short"]} == {"tiny", "none"} and got["none"]["used_tokens"] == 0
    assert sum(r["reached_share"] for r in got.values()) == pytest.approx(1)
    again = {r["doc_id"]: r["repeats"] for r in mix_sources(frame, targets, "doc_id", "text", "source")[0].collect()}
    assert again == {r["doc_id"]: r["repeats"] for r in repeats}


def test_mix_of_nothing(spark):
    frame = spark.createDataFrame([], "doc_id int, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1), (None, None, None), ("b", None, None)], "source string, target_share double, max_repeats int")
    repeats, shares = mix_sources(frame, targets, "doc_id", "text", "source")
    assert repeats.count() == 0 and {(r["source"], r["reached_share"], r["short"]) for r in shares.collect()} == {("a", 0.0, False), ("b", 0.0, False)}
