import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quirework.operators import answers, rank, select
from quirework.operators.shortlists import source_owners
from quirework.operators.answers import _by_paths, _by_sets, agreed, assemble, assign, choose_options, consensus, fill_nulls, missing_rows, route_rows, tolerant
from quirework.operators.evidence import emit, object_label, quote_on_page, resolve_quotes, value_in
from quirework.operators.score import cells_match, set_scores
from quirework.operators.select import answer_bearing, clause_owners, constraint_coverage, merge_routes, recall_safe, target_coverage, venue_constraint
from quirework.operators.strategies import paper_count


def test_assignment_against_all_ways(spark):
    rng = random.Random(1)
    edges = [(g, a, b, rng.randint(1, 4)) for g in range(40) for a in range(rng.randint(1, 4)) for b in range(4) if rng.random() < 0.6]
    edges += [(100, a, b, 1) for a in range(20) for b in range(20) if (a + b) % 3]
    got = assign(spark.createDataFrame(edges + [(1, None, 1, 1), (1, 1, 1, 0)], "g int, a int, b int, w int"), "g", "a", "b", "w").collect()
    for g in {e[0] for e in edges if e[0] < 100}:
        w = {(a, b): x for h, a, b, x in edges if h == g}
        ways = {}
        lefts = sorted({a for a, _ in w})
        for pick in itertools.product([None, *range(4)], repeat=len(lefts)):
            pairs = [(a, b) for a, b in zip(lefts, pick) if b is not None]
            if len({b for _, b in pairs}) == len(pairs) and all(p in w for p in pairs):
                ways[tuple(pairs)] = (sum(w[p] for p in pairs), len(pairs))
        best = max(ways.values())
        mine = sorted((r["a"], r["b"]) for r in got if r["g"] == g)
        assert ways[tuple(mine)] == best
        assert {r["unique"] for r in got if r["g"] == g} == {sum(v == best for v in ways.values()) == 1}
    big = [(r["a"], r["b"]) for r in got if r["g"] == 100]
    assert len(big) == len({a for a, _ in big}) == len({b for _, b in big}) == 20
    assert _by_sets([], [], {}) == ([], True) and _by_paths([1], [], {}) == ([], False)


def test_paths_are_as_good_as_sets():
    rng = random.Random(2)
    for _ in range(400):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        w = {(a, b): rng.randint(1, 9) for a in range(n) for b in range(m) if rng.random() < 0.7}
        value = lambda pairs: (sum(w[p] for p in pairs), len(pairs))
        assert value(_by_paths(list(range(n)), list(range(m)), w)[0]) == value(_by_sets(list(range(n)), list(range(m)), w)[0]), w


def test_paths_at_seventeen():
    # A heavy pair that would block two lighter ones, many times over.
    w = {(a, b): 2 if a == b else 3 for a in range(18) for b in (a, a + 1) if b < 18}
    w[17, 17] = 1
    pairs = _by_paths(list(range(18)), list(range(18)), w)[0]
    assert sum(w[p] for p in pairs) == max(17 * 3, 17 * 2 + 1) and len({a for a, _ in pairs}) == len(pairs)


def test_constraints_in_questions(spark):
    cases = [
        ("A CVPR paper is cited by two ICCV 2025 papers", "iccv", "2025", 2),
        ("2025 ICCV papers on maps", "iccv", "2025", None),
        ("Name two ICCV 2025 works", "iccv", "2025", 2),
        ("Both the DETR paper and the YOLO paper", None, None, 2),
        ("Is CVPR or ICCV better in 2024?", None, None, None),
        ("What did ICCV bring in 2024", "iccv", "2024", None),
        ("three scenes of the papers, two papers", None, None, 2),
        ("two in-context papers", None, None, 2),
        ("two works, three papers and four papers", None, None, None),
        (None, None, None, None),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "q string")
    venue, year = venue_constraint(F.col("q"), ["cvpr", "iccv"])
    assert [tuple(r) for r in df.select(venue, year, paper_count(F.col("q"), ["cvpr", "iccv"])).collect()] == [c[1:] for c in cases]


def test_tolerant_keys(spark):
    cases = [("Alpha", "alpha", True), ("alpha (ours)", "Alpha", True), ("alp", "alpha", True), ("al", "alpha", False), ("alphq", "alpha", True), ("abc", "abd", False), ("", "alpha", False), (None, "", True), ("x", None, True), ("w/ Ground Truth", "ground-truth prompts", True), ("R-C-N-Net", "rcnnet", False), ("w/ a b", "ab", False)]
    df = spark.createDataFrame([c[:2] for c in cases], "x string, e string")
    assert [r[0] for r in df.select(tolerant(F.col("x"), F.col("e"))).collect()] == [c[2] for c in cases]


def test_tables(spark):
    rows = spark.createDataFrame([(1, " A", False, 1, None, 5), (1, "a", True, 2, 7, 6), (1, "b", False, 3, None, None), (1, None, True, 4, 1, 1), (2, "a", False, 1, 3, None)], "t int, key string, preferred boolean, seq int, x int, y int")
    got = {(r["t"], r["key"]): (r["x"], r["y"], r["first"]) for r in assemble(rows, ["t"], ["x", "y"]).collect()}
    assert got == {(1, "a"): (7, 6, 1), (2, "a"): (3, None, 1)}
    expected = spark.createDataFrame([(1, "A"), (1, "c"), (1, "one two three four"), (2, None)], "t int, key string")
    assert not missing_rows(expected, rows, ["t"]).collect()  # one alone may be a row in another spelling
    more = expected.union(spark.createDataFrame([(1, "Dd"), (1, "e (f)"), (1, "g with h"), (2, "k")], "t int, key string"))
    assert sorted((r["t"], r["key"]) for r in missing_rows(more, rows, ["t"]).collect()) == [(1, "c"), (1, "dd")]
    printed = spark.createDataFrame([(2, "k l m n o p"), (2, "a (whole)"), (2, None)], "t int, key string")
    assert sorted((r["t"], r["key"]) for r in missing_rows(expected, rows, ["t"], printed).collect()) == [(2, "k l m n o p")]
    reads = spark.createDataFrame([(1, 1, "u", 5, 0), (1, 1, "v", 5, 0), (1, 1, "w", 6, 0), (1, 2, "u", 1, 0), (1, 1, "u", 9, 1), (2, 1, "u", None, 0)], "t int, r int, reader string, x int, seq int")
    assert {(r["t"], r["r"]): r["x"] for r in consensus(reads, "t", "r", "reader", ["x"]).collect()} == {(1, 1): 5, (2, 1): None}
    facts = spark.createDataFrame([("a", 1, "f"), ("a", 1, "g"), ("b", 1, "f"), ("b", 2, "g"), ("c", 1, "f"), ("c", 1, "g"), ("c", 2, "f"), ("c", 2, "g"), ("d", None, "f")], "t string, v int, f string")
    assert {r["t"]: (r["status"], r["v"]) for r in agreed(facts, ["t"], "v", "f").collect()} == {"a": ("agreed", 1), "b": ("missing", None), "c": ("conflict", None)}
    base = spark.createDataFrame([(1, 1, None), (1, 2, 5), (2, 1, 4), (2, 2, None), (3, 1, None), (3, 1, None), (4, 1, None)], "t int, r int, v int")
    other = spark.createDataFrame([(1, 1, 9), (1, 2, 5), (2, 1, 3), (2, 2, 8), (3, 1, 1)], "t int, r int, v int")
    filled = [(r["t"], r["r"], r["v"], r["filled"]) for r in fill_nulls(base, other, "t", "r", ["v"]).collect()]
    assert sorted(filled, key=str) == sorted([(1, 1, 9, 1), (1, 2, 5, 0), (2, 1, 4, 0), (2, 2, None, 0), (3, 1, None, 0), (3, 1, None, 0), (4, 1, None, 0)], key=str)


def test_choices_and_routing(spark):
    q = spark.createDataFrame([("1", {"A": "x", "B": "y"}), ("2", {"A": "x", "B": "X"}), ("3", {"A": "x"}), ("4", {}), ("5", None)], "query_id string, mc_options map<string,string>")
    v = spark.createDataFrame([("1", " Y ", True), ("2", "x", True)], "query_id string, value string, grounded boolean")
    p = spark.createDataFrame([("2", "b")], "query_id string, pick string")
    assert {r["query_id"]: (r["label"], r["confidence"]) for r in choose_options(q, v, p).collect()} == {"1": ("B", 1.0), "2": ("B", 0.5), "3": ("A", 0.1)}
    keys = spark.createDataFrame([("q", "Kelvea"), ("q", "shared"), ("q", None)], "query_id string, key string")
    papers = spark.createDataFrame([("q", "p1", "Kelvea: shared words", "KSW", ["one"]), ("q", "p2", "Other shared", "OS", None)], "query_id string, paper_id string, title string, acronym string, pages array<string>")
    assert {(r["key"], r["status"], r["paper_id"]) for r in route_rows(keys, papers).collect()} == {("Kelvea", "owned", "p1"), ("shared", "ambiguous", "p1"), ("shared", "ambiguous", "p2")}


def test_routing_in_blocks(spark, monkeypatch):
    """Keys of several words, acronyms, equal scores, keys that nothing has: by brute force, in blocks of few rows, texts apart from papers."""
    monkeypatch.setattr(answers, "ROWS_OF_BLOCK", 50)
    rng = random.Random(7)
    words = ["self-trained", "Map", "of", "Öl", "nets", "x1", "graph", "KSW", "deep"]
    some = lambda n: " ".join(rng.choices(words, k=n))
    texts = [(f"p{i}", some(4), rng.choice(["KSW", "ofx1", "", None]), rng.choice([None, [], [some(3)], [some(2), None, some(2), "deep graph nets"]])) for i in range(25)]
    pairs = sorted({(f"q{rng.randrange(4)}", f"p{rng.randrange(25)}") for _ in range(80)})
    keys = [(f"q{rng.randrange(5)}", rng.choice([some(1), some(2), "of x1", "ksw", "nowhere", "-", "", None, "x1 graph, of"])) for _ in range(120)]
    flat = lambda t: " " + " ".join(re.findall("[a-z0-9]+", (t or "").lower())) + " "
    by_id, due = {t[0]: t for t in texts}, set()
    for q, key in set(keys):
        k, found = flat(key), []
        for p in (p for r, p in pairs if r == q and key is not None):
            _, title, acronym, pages = by_id[p]
            places = [(title, 10_000), *zip(pages or [], (4_000, 2_500, 1_500))]
            found.append((-max([0, *(x for t, x in places if len(k) > 2 and k in flat(t)), 9_000 * (len(k.replace(" ", "")) >= 3 and (acronym or "").lower() == k.replace(" ", ""))]), p))
        found.sort()
        score, second = (-x for x in ([f[0] for f in found] + [0, 0])[:2])
        owned = score >= 1500 and score - second >= 500
        due |= {(q, key, "owned" if owned else "ambiguous", p, -x) for x, p in (found[:1] if owned else found)}
    k = spark.createDataFrame(keys, "query_id string, key string")
    kind = "title string, acronym string, pages array<string>"
    t, ids = spark.createDataFrame(texts, "paper_id string, " + kind), spark.createDataFrame(pairs, "query_id string, paper_id string")
    for got in (answers.route_rows(k, ids, t), route_rows(k, ids.join(t, "paper_id"))):
        rows = [(r["query_id"], r["key"], r["status"], r["paper_id"], r["score"]) for r in got.collect()]
        assert len(rows) == len(due) and set(rows) == due
    assert {"owned", "ambiguous"} == {d[2] for d in due} and len(due) > 200


def test_evidence(spark):
    df = spark.createDataFrame([("Tab. 4", "table"), ("(6)", "equation_algorithm"), ("Table A1", "table"), ("4.1", "table"), ("Figure 2: words", "figure"), ("x", "text_span"), (None, "table"), ("Table 4.", "table"), ("Table 4. Results", "table"), ("Fig. 3b", "figure")], "r string, k string")
    assert [r[0] for r in df.select(object_label(F.col("r"), F.col("k"))).collect()] == ["Table 4", "Equation 6", "Table A1", "4.1", "Figure 2", None, None, "Table 4.", "Table 4. Results", "Figure 3b"]
    t = spark.createDataFrame([("15.66 and 1.", "1"), ("15.66", "1"), ("a (b) c", "(b)"), ("x", ""), (None, "1"), ("a\\Eb", "\\E")], "t string, v string")
    assert [r[0] for r in t.select(value_in(F.col("t"), F.col("v"))).collect()][:5] == [True, False, True, False, False]
    assert spark.sql("select 'alpha beta gamma' p").select(quote_on_page(F.col("p"), F.lit("gamma alpha beta delta"))).first()[0]
    blocks = spark.createDataFrame([("p", "b1", "table", "One  two three"), ("p", "b2", "text_span", "one two three four"), ("p", "b3", "text_span", "five six"), ("p", "b4", "text_span", "five six")], "paper_id string, block_id string, source_type string, text string")
    targets = spark.createDataFrame([("t1", "p", "one two three", None), ("t2", "p", "five six", None), ("t3", "p", "five", "table"), ("t4", "p", "zzzz", None), ("t5", "p", "two three four", None), ("t6", "p", "three four", None), ("t7", "p", None, None)], "target_id string, paper_id string, quote string, source_type string")
    got = {r["target_id"]: (r["status"], r["block_id"]) for r in resolve_quotes(targets, blocks).collect()}
    assert got == {"t1": ("resolved", "b1"), "t2": ("ambiguous_anchor", None), "t3": ("wrong_source_type", None), "t4": ("no_anchor", None), "t5": ("ambiguous_anchor", None), "t6": ("ambiguous_anchor", None), "t7": ("no_anchor", None)}
    ranked = spark.createDataFrame([("q", "p", "table", 1, "Tab. 1", 1), ("q", "p", "table", 1, "Table 1", 2), ("q", "p", "text_span", 0, None, 3), ("q", "p", "video", 1, None, 4), ("q", "p", "text_span", 2, None, 5)], "query_id string, paper_id string, source_type string, page int, object_id string, place int")
    assert [(r["place"], r["slot"]) for r in emit(ranked).orderBy("slot").collect()] == [(1, 1), (5, 2)]


def test_selection(spark):
    rows = spark.createDataFrame([(2, "q", "a", ["x", "y"], [("r", 3, None, None, "t")], None), (1, "q", "b", None, [], "rel"), (3, "q", "a", ["z", "x"], [("r", 1, 2.0, None, "u")], None), (4, "q", None, [], None, None)], "row_id int, query_id string, paper_id string, provenance array<string>, route_signals array<struct<route string, rank int, score double, group_key string, role string>>, relation_support string").withColumn("support", F.array())
    got = {r["paper_id"]: r for r in merge_routes(rows).collect()}
    assert got["a"]["provenance"] == ["x", "y", "z"] and got["a"]["position"] == 1 and got["b"]["relation"] == "rel" and got["b"]["signals"] is None
    assert [tuple(s) for s in got["a"]["signals"]] == [("r", None, 1, 2.0, "t")]
    safe = spark.createDataFrame([("q", 1, True), ("q", 2, None), ("r", 3, False), ("r", 4, None)], "q string, i int, ok boolean")
    assert {r["i"] for r in recall_safe(safe, "q", F.col("ok")).collect()} == {1, 3, 4}
    strengths = spark.createDataFrame([("q", 0, "a", 1, 0), ("q", 1, "a", 1, 0), ("q", 1, "b", 2, 1), ("q", 2, "a", 0, 0)], "query_id string, target int, paper_id string, strength int, position int")
    assert {(r["target"], r["paper_id"]) for r in target_coverage(strengths).collect()} == {(0, "a"), (1, "b")}
    cands = spark.createDataFrame([("q", "a", 0, "nothing", "which"), ("q", "b", 1, "red box and blue bolt here", "which"), ("s", "c", 0, None, None)], "query_id string, paper_id string, position int, evidence string, question string")
    cover = constraint_coverage(cands, spark.createDataFrame([("q", "Red box"), ("q", "blue  bolt"), ("q", "Blue bolt")], "query_id string, surface string"))
    assert {(r["query_id"], r["paper_id"], r["rescued"]) for r in answer_bearing(cover, cands.where("position = 0").select("query_id", "paper_id")).collect()} == {("q", "b", True), ("s", "c", False)}
    papers = spark.createDataFrame([("a", "alpha beta gamma", "delta"), ("b", "alpha beta gamma", None), ("c", "omega sigma", "theta iota")], "paper_id string, title string, abstract string")
    phrases = spark.createDataFrame([("1", "q", ["alpha", "beta", "gamma"]), ("2", "q", ["omega", "sigma", "theta"])], "phrase_id string, query_id string, words array<string>")
    present = spark.createDataFrame([("q", "a"), ("q", "c")], "query_id string, paper_id string")
    assert [(r["phrase_id"], r["paper_id"]) for r in clause_owners(phrases, papers, present).collect()] == [("2", "c")]  # a tie has no owner


def test_scores(spark):
    g = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "a")], "q string, k string")
    p = spark.createDataFrame([("q", "a"), ("q", "c"), ("z", "a")], "q string, k string")
    assert {r["q"]: (r["precision"], r["recall"], r["f1"]) for r in set_scores(g, p, "q", "k").collect()} == {"q": (0.5, 0.5, 0.5), "r": (0.0, 0.0, 0.0)}
    c = spark.createDataFrame([("1.0", "1"), (" A", "a "), (None, None), (None, "x"), ("2", "3")], "g string, s string")
    assert [r[0] for r in c.select(cells_match(F.col("g"), F.col("s"))).collect()] == [True, True, True, False, False]


def test_dense_blocks(spark, monkeypatch):
    """The same neighbours however many queries are broadcast together."""
    rng = random.Random(6)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4), (61, None)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    found = []
    for most in (20_000, 7):
        monkeypatch.setattr(rank, "QUERIES_AT_ONCE", most)
        found.append(sorted(map(tuple, rank.dense_top(df, "i", df, "i", "v", 3).collect())))
    assert found[0] == found[1] and len(found[0]) == 61 * 3
    assert not rank.dense_top(df.limit(0), "i", df, "i", "v", 3).collect()


def test_lexical_statistics(spark):
    """Small and large sets of asked terms, documents in several rows, and documents without any asked term."""
    docs = spark.createDataFrame([("a", "graph nets"), ("a", "graph"), ("b", "other words entirely"), ("c", None), ("d", "graph words")], "d string, t string")
    asked = spark.createDataFrame([("q", "graph"), ("r", None), ("s", "nothing here")], "q string, t string")
    got = {(r["query"], r["doc"]): r["score"] for r in rank.bm25(asked, "q", "t", docs, "d", "t").collect()}
    n, avg, df = 4, (3 + 3 + 0 + 2) / 4, 2
    score = lambda tf, dl: math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))
    assert got == {("q", "a"): pytest.approx(score(2, 3)), ("q", "d"): pytest.approx(score(1, 2))}


def test_owners_of_sources(spark):
    papers = spark.createDataFrame([("p1", "FastNet: a method"), ("p2", "Graph Nets for all"), ("p3", "Twice Told: one"), ("p4", "Twice Told: two"), ("p5", None)], "paper_id string, title string")
    cases = {"a": "What does FastNet report on it?", "b": "Is it better in FastNet than FastNet?", "c": "according to Graph Nets for all, why?", "d": "in Twice Told, what?", "e": "fastnet reports it", "f": None, "g": "We like FastNet"}
    rows = spark.createDataFrame(list(cases.items()), "query_id string, question string")
    assert {r["query_id"]: r["paper_id"] for r in source_owners(rows, papers).collect()} == {"a": "p1", "c": "p2"}


def test_clause_owners_in_blocks(spark, monkeypatch):
    """The same owners as by brute force, however many papers are scored at once; common terms make no pairs."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    papers = [(f"p{i:03}", " ".join(rng.sample(vocabulary[:12] if i % 2 else vocabulary, rng.randint(2, 7))), " ".join(rng.sample(vocabulary, rng.randint(0, 9)))) for i in range(120)] + [("n", None, None)]
    phrases = [(f"f{i}", f"q{i % 3}", rng.sample((papers[i % 120][1] or "").split(), min(5, len(papers[i % 120][1].split())))) for i in range(150)] + [("none", "q0", []), ("long", "q0", vocabulary + [f"x{i}" for i in range(70)])]
    present = [(f"q{k}", p) for k in range(3) for i, (p, _, _) in enumerate(papers) if i % 4 != k]
    due = set()
    for phrase, q, words in phrases:
        scored = []
        for p, title, abstract in papers:
            t, d = set((title or "").split()), set(f"{title or ''} {abstract or ''}".split())
            th, h = len(t & set(words)), len(d & set(words))
            scored.append((-(3 * th + h), p, th, h))
        (s, p, th, h), second = sorted(scored)[0], -sorted(scored)[1][0]
        if words and h >= max(3, math.ceil(len(words) * 0.65)) and (th >= 2 or h >= 4) and -s - second >= 2 and (q, p) in present:
            due.add((phrase, q, p, -s, second))
    frames = spark.createDataFrame(phrases, "phrase_id string, query_id string, words array<string>"), spark.createDataFrame(papers, "paper_id string, title string, abstract string"), spark.createDataFrame(present, "query_id string, paper_id string")
    for most in (32_768, 25):
        monkeypatch.setattr(select, "PAPERS_AT_ONCE", most)
        assert set(map(tuple, clause_owners(*frames).collect())) == due and due
