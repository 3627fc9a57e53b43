import pytest

from quirework.plans import backends
from quirework.plans.build import STORES, build_indexes, build_report, load_indexes


def test_build_and_reload(spark, tmp_path):
    pages = [
        ("p1", 1, "Introduction\nWe propose Gated Graph Nets (GGN) for parsing. We call it FastGGN.\nTable 1: GGN against OldNet"),
        ("p1", 2, "Related Work\nOldNet is a baseline. FastGGN is a method. FastGGN wins. FastGGN holds. We compare with OldNet."),
        ("p1", 2, "a page in two parts"),
        ("p2", 1, "OldNet is here.\nFig. 3 shows OldNet"),
        ("p2", None, "nowhere"),
        (None, 1, "nobody"),
        ("p3", 1, None),
    ]
    papers = [("p1", "FastGGN: parsing with graphs", "about it"), ("p2", "OldNet: the first", None), ("p3", None, None)]
    df, pool = spark.createDataFrame(pages, "paper_id string, page int, text string"), spark.createDataFrame(papers, "paper_id string, title string, abstract string")
    stores = build_indexes(df, pool, f"file://{tmp_path}/x")
    assert list(stores) == list(STORES)
    passages = {r["chunk_id"]: r["section_kind"] for r in stores["passages"].collect()}
    assert passages == {"p1:p1:c0": "other", "p1:p2:c0": "related_work", "p2:p1:c0": None}
    assert {(r["object_key"], r["caption"]) for r in stores["objects"].collect()} == {("p1:table:1", "Table 1: GGN against OldNet"), ("p2:figure:3", "Fig. 3 shows OldNet")}
    aliases = {(r["paper_id"], r["alias"], r["source"], r["expansion"]) for r in stores["aliases"].collect()}
    assert ("p1", "GGN", "body_definition", "Gated Graph Nets") in aliases and ("p1", "FastGGN", "body_coinage", "") in aliases and ("p1", "FastGGN", "bare_mixedcase", "") in aliases
    relations = stores["relations"].collect()
    assert {(r["source_paper_id"], r["target_paper_id"], r["support"]["source_type"]) for r in relations if r["mention"] == "OldNet" and r["source_paper_id"] == "p1"} == {("p1", "p2", "table")}
    again = load_indexes(spark, f"file://{tmp_path}/x")
    assert {n: sorted(map(str, d.collect())) for n, d in again.items()} == {n: sorted(map(str, d.collect())) for n, d in stores.items()}
    assert {r["store"]: r["papers"] for r in build_report(again).collect()}["passages"] == 2
    with pytest.raises(FileExistsError):
        build_indexes(df, pool, f"file://{tmp_path}/x")
    empty = build_indexes(df.limit(0), pool.limit(0), f"file://{tmp_path}/y")
    assert [d.count() for d in empty.values()] == [0, 0, 0, 0]


def test_backends(spark):
    r = backends.Registry("thing", {"a": len})

    @r.register("b")
    def b(x):
        return x

    assert r["b"](3) == 3 and list(r) == ["a", "b"] and [n for n, _ in r.known(["b", "x", "b", "a"])] == ["b", "a"]
    with pytest.raises(KeyError, match="no thing x; there are a, b"):
        r["x"]
    with pytest.raises(ValueError):
        r.register("a", len)
    assert backends.cascade([]) == [] and [n for n, _ in backends.cascade(["attestation", "llm-validator"])] == ["attestation", "llm-validator"]
    with pytest.raises(KeyError):
        backends.cascade(["attestation", "none"])
    rows = spark.createDataFrame([("q1", "a", 1), ("q2", "b", 2)], "query_id string, paper_id string, position int")
    given = backends.routed(rows.limit(1), ["x", "s", "s"], {"s": (rows,)}, backends.Registry("strategy", {"s": lambda d: d}))
    assert list(given) == ["s"] and [r["paper_id"] for r in given["s"].collect()] == ["a"]
    accepted = spark.createDataFrame([("q1", "a", 0.5)], "query_id string, paper_id string, confidence double")
    assert backends.POLICIES["gate"](rows, accepted).count() == 1 and backends.POLICIES["rank"](rows, accepted).count() == 2


def test_only_the_store_that_is_asked_for(spark, tmp_path):
    pages = spark.createDataFrame([("p1", 1, "Table 1: GGN against OldNet")], "paper_id string, page int, text string")
    papers = spark.createDataFrame([("p1", "FastGGN: parsing with graphs", "about it")], "paper_id string, title string, abstract string")
    stores = build_indexes(pages, papers, f"file://{tmp_path}/x", ["objects"])
    assert list(stores) == ["objects"] and stores["objects"].count() == 1
    assert [p.name for p in (tmp_path / "x").iterdir()] == ["objects"]
    with pytest.raises(KeyError):
        build_indexes(pages, papers, f"file://{tmp_path}/y", ["objects", "things"])
