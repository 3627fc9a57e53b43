import random
import time

from quirework.operators import entities
from quirework.operators.graph import cohort_edges, components
from quirework.plans.graph_queries import paper_components


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 60), 100 + rng.randint(0, 60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)]
    nodes = sorted({x for e in edges for x in e} | {500})
    root = {x: x for x in nodes}
    for _ in nodes:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame([(x,) for x in nodes], "node int"), spark.createDataFrame(edges, "a int, b int"))
    assert {r["node"]: r["component"] for r in got.collect()} == root


def test_paper_components(spark, tmp_path):
    """Lines of any quantity, also none, join orders; a part that many orders have is one component."""
    rng = random.Random(3)
    lines = [(o, rng.randint(1, 90), rng.choice([None, 1.0, 20.0, 49.0, 50.0])) for o in range(1, 61)] + [(100 + i, 500, 1.0 + i % 50) for i in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    root = {o: o for o, _, _ in lines}
    for _ in lines:
        for o, p, _ in lines:
            root[o] = min(root[x] for x, q, _ in lines if q == p)
    got = {r["node"]: r["component"] for r in paper_components(spark, str(tmp_path)).collect()}
    assert got == root


def test_cohort_edges_with_contained_names(spark):
    """The components of all pairs of an anchor and another question with a paper in common, or names that match."""
    rng = random.Random(5)
    pool = ["dfine", "deimdfinex", "fine", "finex", "net", "netx", "abc", "xabcx", "retina", "retinanet", "maskformer", "former", "solo", "unique"]
    methods = [(q, rng.choice(pool)) for q in range(24) for _ in range(rng.randint(0, 1))] + [(40, "dfine"), (41, "deimdfinex"), (50, "net"), (51, "netx")]
    papers = [(q, f"p{rng.randint(0, 60)}") for q in range(24) for _ in range(2)]
    anchors = [0, 3, 7, 11, 40, 50]
    match = lambda a, b: a == b or (min(len(a), len(b)) >= 4 and (a in b or b in a))
    every = {q for q, _ in methods + papers}
    pairs = [(a, q) for a in anchors for q in every if a != q and (any(match(m, n) for x, m in methods if x == a for y, n in methods if y == q) or {p for x, p in papers if x == a} & {p for y, p in papers if y == q})]

    def parts(edges):
        root = {x: x for e in edges for x in e}
        for _ in root:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        return root

    got = cohort_edges(spark.createDataFrame(papers, "query_id int, paper_id string"), spark.createDataFrame(methods, "query_id int, method string"), spark.createDataFrame([(a,) for a in anchors], "query_id int"))
    root = parts([tuple(r) for r in got.collect()])
    assert root == parts(pairs) and root[40] == root[41] and 51 not in root


def test_names_of_no_title_are_not_ranked(spark, monkeypatch):
    """Only a name that a title has as a word, and more than three papers as an alias, goes on to the ranking."""
    papers = [(f"p{i}", f"Known-Net of kind{i}", "OtherNet everywhere") for i in range(5)] + [("q", "RareNet here", None), ("r", "lower known-net2", None), ("s", None, "about Known-Net")]
    names, asked = ["Known-Net", "OtherNet", "RareNet", "Known-Net2", "KNOWNNET2", "Net"], []
    rank = entities.bm25
    monkeypatch.setattr(entities, "bm25", lambda q, *a: asked.extend(r["mention"] for r in q.collect()) or rank(q, *a))
    got = entities.resolve_mentions(spark.createDataFrame([(n,) for n in names], "mention string"), spark.createDataFrame(papers, "paper_id string, title string, abstract string"))
    assert sorted(asked) == ["KNOWNNET2", "Known-Net", "Known-Net2"]
    assert {(r["mention"], r["target"], r["how"]) for r in got.collect()} == {("Known-Net", "p0", "words"), ("Known-Net2", "r", "words"), ("RareNet", "q", "alias")}


def test_texts_are_not_shuffled_with_each_word(spark):
    """Names near cues come out as they should, and what is shuffled is of the size of the texts."""
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(3000))
    texts = spark.createDataFrame([("p", f"{long} our method FooNet is"), ("p", "FooNet FooNet"), ("p", None), ("q", "xBar xBar xBar of it"), ("q", "xBar: kernels"), ("r", "zLone zLone zLone")], "paper_id string, text string")
    titles = spark.createDataFrame([("q", "About Kernels"), ("s", None)], "paper_id string, title string")
    written = lambda: sum(spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(i).totalShuffleWrite() for i in range(1))
    names = entities.recurring_names(texts, "paper_id", "text").localCheckpoint()
    before = written()
    got = entities.cued_names(names, texts, "paper_id", "text", titles).collect()
    assert {tuple(r) for r in got} == {("p", "FooNet", 3), ("q", "xBar", 4)}
    assert written() - before < 1_000_000


def test_names_that_stand_often_and_long_sentences(spark):
    """A text is split once a name; a sentence is tried once for a definition; a name inside a longer word doesn't stand there."""
    often = " ".join(["FooNet abcdef ghijkl"] * 6000)
    texts = spark.createDataFrame([("p", often), ("p", f"{often} the FooNet of our method"), ("q", "Bar_x Bar_y Bar_z model"), ("r", "zBar zBar zBar"), ("r", "my_zBar method")], "paper_id string, text string")
    titles = spark.createDataFrame([("s", None)], "paper_id string, title string")
    began = time.time()
    got = entities.cued_names(entities.recurring_names(texts, "paper_id", "text"), texts, "paper_id", "text", titles).collect()
    assert {tuple(r) for r in got} == {("p", "FooNet", 12001)}
    long = "word " * 30_000
    texts = spark.createDataFrame([(1, long), (2, f"{long}Deep Neural Nets (DNN). Other Nets: (ON) A Big (b) Big Cat (BC)")], "id int, text string")
    got = entities.defined_aliases(texts, ["id"], "text").collect()
    assert {tuple(r) for r in got} == {(2, "DNN", "Deep Neural Nets"), (2, "BC", "Big Cat")}
    assert time.time() - began < 15
