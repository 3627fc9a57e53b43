from quirework.plans.strategy_queries import caption_strategy


def test_captions_for_every_question(spark, tmp_path):
    """Questions that speak of no table have figures and tables, names have rows of their own, the filter comes after the hits."""
    asked = [("q1", "accuracy of Kelvea"), ("q2", "which table has accuracy"), ("q3", None)]
    objects = [(1, "a", "accuracy of Kelvea", "figure"), (2, "b", "accuracy on the set", "table"), (3, "c", "accuracy elsewhere", None), (4, None, "accuracy again", "table"), (5, "d", "nothing of it", "figure")]
    spark.createDataFrame(asked, "query_id string, question string").write.parquet(f"{tmp_path}/questions.parquet")
    spark.createDataFrame(objects, "row_id long, paper_id string, caption string, source_type string").write.parquet(f"{tmp_path}/objects.parquet")
    rows = caption_strategy(spark, str(tmp_path)).collect()
    got = {}
    for r in rows:
        got.setdefault((r["query_id"], r["group_key"]), set()).add((r["paper_id"], r["hits"]))
    every = {("a", "1"), ("b", "2"), ("c", "3")}
    assert got == {("q1", None): every, ("q1", "Kelvea"): every, ("q2", None): {("b", "2")}}
    assert [r["paper_id"] for r in rows if r["group_key"] == "Kelvea" and r["rank"] == 0] == ["a"]
