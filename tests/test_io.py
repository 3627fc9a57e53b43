import json

import pytest
from pyspark.sql import functions as F

from quirework.operators.manifest import latest
from quirework.operators.rank import document_frequency, postings
from quirework.sinks.files import append_log, write_store, write_submission
from quirework.sources.files import artifacts, binary_documents, fetched, first_documents, json_lines, options_of
from quirework.sources.pool import load_pool
from quirework.streaming.incremental import keep_statistics, statistics, watch_documents, windowed_counts


def test_json_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "x"}\n\n{"id": 2}\nnot json\n')
    assert {r["id"] for r in json_lines(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()} == {1, 2}
    with pytest.raises(Exception):
        json_lines(spark, str(tmp_path / "a.jsonl"), "id int, t string", strict=True).collect()
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "p1.json").write_text(json.dumps({"pages": [{"page": 1, "text": "one"}]}, indent=1))
    (folder / "p2.json").write_text("{broken")
    got = artifacts(spark, str(folder), "pages array<struct<page int, text string>>").collect()
    assert [(r["artifact_id"], r["pages"][0]["text"]) for r in got] == [("p1", "one")]


def test_binary(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>")
    docs = binary_documents(spark, str(tmp_path))
    assert {(r["doc_id"], r["bytes"], r["is_pdf"]) for r in docs.collect()} == {("a", 10, True), ("b", 6, False)}
    asked = spark.createDataFrame([("a",), ("c",)], "paper_id string")
    assert {(r["paper_id"], r["bytes"]) for r in fetched(asked, docs, "paper_id").collect()} == {("a", 10), ("c", None)}


def test_options(spark):
    df = spark.sql("select array(named_struct('label', ' a', 'text', 'x'), named_struct('label', 'A', 'text', 'y'), named_struct('label', 'b', 'text', 'z')) as l, map('Q', 'q') as m")
    assert df.select(options_of(F.col("l"), F.col("m")).alias("o")).first()["o"] == {"A": "x", "B": "z"}
    assert df.select(options_of(F.lit(None).cast("array<struct<label string, text string>>"), F.col("m")).alias("o")).first()["o"] == {"Q": "q"}


def test_pool_and_bound(spark):
    rows = spark.createDataFrame([(2, "a", "second", None, None, "X"), (1, "a", "first", None, ["n"], None), (3, "b", None, "t", None, "Y"), (4, None, "z", "z", None, "Z")], "row_id int, paper_id string, title string, abstract string, authors array<string>, venue string")
    pool = {r["paper_id"]: r for r in load_pool(rows).collect()}
    assert set(pool) == {"a", "b"} and pool["a"]["title"] == "first" and pool["a"]["abstract"] == "" and pool["b"]["authors"] == [] and pool["b"]["venue"] == "y"
    assert [r["row_id"] for r in first_documents(rows, "row_id", 2).collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    log = str(tmp_path / "log")
    for k in range(3):
        append_log(spark.createDataFrame([("a", k), ("b", -k), (None, 9)], "key string, seq int"), log)
    assert {(r["key"], r["seq"]) for r in latest(spark.read.parquet(log), "key", ["seq"]).collect()} == {("a", 2), ("b", 0)}
    store = str(tmp_path / "store")
    write_store(spark.range(10), store, ["id"])
    with pytest.raises(Exception):
        write_store(spark.range(10), store)
    kind = "query_id string, gold_papers array<string>, evidence array<struct<paper_id string, source_type string, page int>>, choice string"
    questions = spark.createDataFrame([("q1", {"A": "x"}), ("q2", None)], "query_id string, mc_options map<string,string>")
    good = [("q1", ["p"], [("p", "table", 1)], "A"), ("q2", [], [], None)]
    write_submission(spark.createDataFrame(good, kind), questions, str(tmp_path / "sub"))
    assert spark.read.json(str(tmp_path / "sub")).count() == 2
    for bad in (good[:1], [*good, good[0]], [("q1", ["p", "p"], [("p", "table", 0)], "B"), good[1]]):
        with pytest.raises(ValueError):
            write_submission(spark.createDataFrame(bad, kind), questions, str(tmp_path / "other"))


def test_incremental_statistics(spark, tmp_path):
    docs, store = str(tmp_path / "in"), str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"alpha beta{i % 3} gamma{i % 5} alpha") for i in range(30)] + [(99, None)], "doc_id int, text string")
    rows.repartition(3).write.parquet(docs)
    schema = "doc_id int, text string"
    for _ in range(2):  # what was taken already is not counted again
        keep_statistics(watch_documents(spark, docs, schema, 1), "doc_id", "text", store, str(tmp_path / "check"), once=True).awaitTermination()
    rows2 = spark.createDataFrame([(200, "alpha delta")], schema)
    rows2.write.mode("append").parquet(docs)
    keep_statistics(watch_documents(spark, docs, schema, 1), "doc_id", "text", store, str(tmp_path / "check"), once=True).awaitTermination()
    due = {r["term"]: r["df"] for r in document_frequency(postings(rows.unionByName(rows2), "doc_id", "text")).collect()}
    got = statistics(spark, store).collect()
    assert {r["term"]: r["df"] for r in got} == due and {r["n"] for r in got} == {32}


def test_windows(spark, tmp_path):
    events = spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, 0, 20 * cast(id as int), 0) as ts, cast(id % 2 as string) as kind from range(12)")
    events.write.parquet(str(tmp_path / "e"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "ts", "kind")
    stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert sum(r["n"] for r in spark.table("counted").collect()) == 12
