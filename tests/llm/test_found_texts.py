from evidence_engine.llm import lsh_forest


def test_texts_are_found_alike_whether_ids_are_sent_or_joined(spark, docs, odd, monkeypatch):
    """Rounds take their texts from those already read."""
    order = ["doc_id", "h"]
    for table in (docs, odd[0]):
        sent = lsh_forest.near_duplicates(table, 3, 85).orderBy(*order).collect()
        monkeypatch.setattr(lsh_forest, "SENT_IDS", 0)
        assert lsh_forest.near_duplicates(table, 3, 85).orderBy(*order).collect() == sent
        monkeypatch.undo()


def test_no_text_is_shuffled_to_be_found(spark, docs, monkeypatch):
    plans = []
    write = lsh_forest.Scratch.write

    def kept(self, df, name):
        if name == "forest-texts":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(lsh_forest.Scratch, "write", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lsh_forest.near_duplicates(docs, 3, 85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans and not any("SortMergeJoin" in plan for plan in plans)
