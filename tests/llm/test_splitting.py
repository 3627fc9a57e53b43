import random
import re

import pytest

from quirework.llm.splitting import MOST_WORDS, split_oversized

SPACES = [" ", "\n", " ", "　", "\t", "  ", "\n \n", "\n\n", "\r\n"]


def kind(text, limit):
    stretches = re.split(r"(?<=[.!?])\s+|[^\S\n]*\n[^\S\n]*\n\s*", text)
    return "forced" if any(len(x.split()) > limit for x in stretches) else "natural"


def texts():
    rng = random.Random(3)
    for i in range(300):
        words = [("wörd%d" % rng.randint(0, 99)) + rng.choice(["", "", "", ".", "!", "?", ","] if i % 3 else [""]) for _ in range(rng.randint(0, 120))]
        yield "".join(w + rng.choice(SPACES if i % 2 else [" "]) for w in words) + rng.choice(["", "end"])


def test_pieces(spark):
    limit, overlap = 20, 5
    rows = [(i, t) for i, t in enumerate(texts())] + [(1000, None), (1001, ""), (1002, " \n " * 90), (1003, "x" * 500_000), (1004, "a. " * 5000), (1004, "a. " * 5000)]
    got = split_oversized(spark.createDataFrame(rows, "id int, text string"), "text", limit, overlap, ["id"]).collect()
    count = lambda t: len((t or "").split())
    assert sorted(r["id"] for r in got) == sorted(i for i, t in rows if count(t) > limit)
    source = dict(rows)
    for r in got:
        text, pieces = source[r["id"]], r["pieces"]
        assert "".join(p["fresh"] for p in pieces) == text
        assert r["n_words"] == count(text) and r["cut_kind"] == kind(text, limit), r["id"]
        done = ""
        for k, p in enumerate(pieces):
            assert p["piece_no"] == k + 1 and count(p["overlap"] + p["fresh"]) <= limit
            assert p["overlap"].split() == (done.split()[-overlap:] if k else [])
            done += p["fresh"]
            if k + 1 < len(pieces):
                natural = bool(re.search(r"[.!?]\s+\Z|\n[^\S\n]*\n\s*\Z", p["fresh"]))
                assert natural == (p["cut"] in ("paragraph", "sentence"))
                if not natural:  # no natural boundary was within reach
                    reach = re.match(r"\s*(?:\S+\s*){%d}" % (limit if not k else limit - overlap), text[len(done) - len(p["fresh"]) :])
                    assert not re.search(r"[.!?]\s|\n[^\S\n]*\n", reach[0].rstrip())
            else:
                assert p["cut"] == "end"


def test_edges(spark):
    empty = spark.createDataFrame([], "id int, text string, n_words int, pieces string, m string, k int")
    assert split_oversized(empty, "text", 10, 2, ["id"]).count() == 0
    one = spark.createDataFrame([(1, "a " * 5000, 3, "x", "y", 4)], empty.schema)
    got = split_oversized(one, "text", MOST_WORDS, 0, ["id", "m", "k"]).collect()[0]
    assert len(got["pieces"]) == 5 and got["m"] == "y" and got["cut_kind"] == "forced"
    with pytest.raises(ValueError):
        split_oversized(one, "text", 10, 10, ["id"])
