from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import chunking, index, retrieval, store as stores
from evidence_engine.operators.answers import answer_queries
from evidence_engine.operators.store import ChunkStore
from evidence_engine.sources.exclusive import publish
from evidence_engine.streaming import ingest as streams

TEXTS = {"a.md": "报销材料在十个工作日内提交。", "b.md": "P0 事件 must be reported in 15 minutes.", "c.md": "the cat sat " * 60}


def raw(spark, texts):
    return spark.createDataFrame(list(texts.items()), "source string, text string")


def listing(store):
    counted = [(r["source"], r["chunk_count"]) for r in chunking.list_documents(store.load()).collect()]
    assert counted == [(r["source"], r["chunk_count"]) for r in store.list_documents().collect()]
    return counted


def listing_at(store, version):
    return sorted(r["source"] for r in store.list_documents(version).collect())


def same_index(store):
    """Statistics summed up from changes equal those of an index built anew."""
    kept, fresh = store.index(), index.build_index(store.load())
    summed = kept.doc_freq.groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0")
    assert sorted(map(tuple, summed.collect())) == sorted(map(tuple, fresh.doc_freq.collect()))
    assert kept.stats.first() == fresh.stats.first()
    assert sorted(r["chunk_id"] for r in kept.chunks.collect()) == sorted(r["chunk_id"] for r in fresh.chunks.collect())


def test_ingest_search_answer_and_persistence(spark, folder):
    results = ChunkStore(spark, folder).ingest(raw(spark, TEXTS))
    assert sorted((r["source"], r["chunk_count"]) for r in results.collect()) == [("a.md", 1), ("b.md", 1), ("c.md", 2)]
    store = ChunkStore(spark, folder)
    assert listing(store) == [("a.md", 1), ("b.md", 1), ("c.md", 2)]
    questions = spark.createDataFrame([(1, " 报销材料多久提交？ ")], "query_id int, question string")
    hits = retrieval.search(store.index(), retrieval.prepare_queries(questions), ks=(2,))
    assert hits.where("rank = 1").first()["source"] == "a.md"
    answer = answer_queries(questions, hits).first()
    assert answer["question"] == " 报销材料多久提交？ "
    assert "报销材料在十个工作日内提交。 [1]" in answer["answer"] and len(answer["citations"]) == 2
    same_index(store)


def test_an_empty_store(spark, folder):
    store = ChunkStore(spark, folder)
    assert store.version() == 0 and store.load().count() == 0
    assert store.index().stats.first()["n_chunks"] == 0
    assert store.delete_documents(spark.createDataFrame([("x",)], "document_id string")) is False
    assert store.version() == 0


def test_replacing_moves_to_the_end_and_keeps_one_copy(spark, folder):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    before = {r["chunk_id"] for r in store.load().collect()}
    store.ingest(raw(spark, {"a.md": TEXTS["a.md"] + " \n"}))
    rows = store.load().orderBy("doc_ord").collect()
    assert {r["chunk_id"] for r in rows} == before and len(rows) == len(before)
    assert rows[-1]["source"] == "a.md"
    same_index(store)


def test_changed_text_is_another_document(spark, folder):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, {"a.md": "one"}))
    store.ingest(raw(spark, {"a.md": "two"}))
    assert listing(store) == [("a.md", 1), ("a.md", 1)]


def test_copies_within_a_batch_count_once(spark, folder):
    store = ChunkStore(spark, folder)
    rows = spark.createDataFrame([("a", "x"), ("a", " x "), ("a", "y"), ("b", "x"), ("b", " ")], "source string, text string")
    assert store.ingest(rows).count() == 3
    assert store.load().count() == 3


def test_blank_documents(spark, folder):
    store = ChunkStore(spark, folder)
    with pytest.raises(ValueError, match="blank"):
        store.ingest(raw(spark, {"a": " 　"}), strict=True)
    assert store.ingest(raw(spark, {"a": " 　"})).count() == 0


def test_delete(spark, folder):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    ids = store.load().where("source <> 'b.md'").select("document_id").distinct()
    assert store.delete_documents(ids) is True
    assert listing(store) == [("b.md", 1)]
    same_index(store)
    assert store.delete_documents(ids) is False
    assert store.version() == 2
    store.ingest(raw(spark, TEXTS))
    assert listing(store) == [("a.md", 1), ("b.md", 1), ("c.md", 2)]
    same_index(store)


def test_versions_and_compaction(spark, folder):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    store.delete_documents(store.load().where("source = 'a.md'").select("document_id"))
    before = sorted(map(str, store.load().collect()))
    version = store.compact()
    assert version == 3 and sorted(map(str, store.load().collect())) == before
    same_index(store)
    assert store.load(1).count() == 4 and store.load(2).count() == 3
    store.ingest(raw(spark, {"b.md": TEXTS["b.md"], "d.md": "new"}))
    assert listing(store) == [("b.md", 1), ("c.md", 2), ("d.md", 1)]
    same_index(store)


def test_an_unfinished_change_is_invisible(spark, folder, monkeypatch):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patched:
        patched.setattr(ChunkStore, "_commit", fail)
        with pytest.raises(RuntimeError):
            store.ingest(raw(spark, {"x.md": "half done", "a.md": TEXTS["a.md"]}))
        with pytest.raises(RuntimeError):
            store.delete_documents(store.load().select("document_id"))
    assert listing(store) == [("a.md", 1), ("b.md", 1), ("c.md", 2)]
    same_index(store)
    assert store.delete_documents(store.load().where("source = 'b.md'").select("document_id"))
    assert listing(store) == [("a.md", 1), ("c.md", 2)]
    same_index(store)
    store.ingest(raw(spark, {"y.md": "done"}))
    assert listing(store) == [("a.md", 1), ("c.md", 2), ("y.md", 1)]
    same_index(store)


def test_one_of_two_writers_wins_and_the_other_starts_over(spark, folder, monkeypatch):
    store, other = ChunkStore(spark, folder), ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    commit, late = ChunkStore._commit, [True]

    def overtaken(self, *args):
        if self is store and late:
            late.clear()
            other.ingest(raw(spark, {"x.md": "from the other writer", "b.md": TEXTS["b.md"]}))
        return commit(self, *args)

    monkeypatch.setattr(ChunkStore, "_commit", overtaken)
    store.ingest(raw(spark, {"x.md": "from the other writer", "y.md": "mine"}))
    assert store.version() == 3
    assert listing(store) == [("a.md", 1), ("b.md", 1), ("c.md", 2), ("x.md", 1), ("y.md", 1)]
    same_index(store)
    assert listing_at(store, 2) == ["a.md", "b.md", "c.md", "x.md"]

    late.append(True)
    assert store.delete_documents(store.load().where("source in ('b.md', 'x.md')").select("document_id")) is True
    assert store.version() == 5
    assert listing(store) == [("a.md", 1), ("c.md", 2), ("y.md", 1)]
    same_index(store)


def test_a_writer_that_always_loses_gives_up(spark, folder, monkeypatch):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    monkeypatch.setattr(stores, "TRIES", 2)
    monkeypatch.setattr(stores, "publish", lambda *_: False)
    with pytest.raises(stores.ChangedMeanwhile):
        store.compact()
    assert store.version() == 1


def test_two_threads_create_one_file(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: publish(spark, folder, "one", f"{n}\n"), range(8)))
    assert sum(won) == 1
    assert spark.read.text(f"{folder}/one").first()[0] == str(won.index(True))


def test_a_changed_version_is_read_without_a_shuffle(spark, folder, capsys):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    store.delete_documents(store.load().where("source = 'a.md'").select("document_id"))
    store.load().explain()
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_many_ids_are_joined(spark, folder, monkeypatch):
    monkeypatch.setattr(stores, "BROADCAST_IDS", 0)
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, TEXTS))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert store.delete_documents(store.load().where("source <> 'c.md'").select("document_id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert listing(store) == [("c.md", 2)]
    same_index(store)


def test_streams(spark, folder):
    uploads, questions = folder + "/uploads", folder + "/questions"
    raw(spark, TEXTS).write.parquet(uploads)
    incoming = spark.readStream.schema("source string, text string").parquet(uploads)
    for _ in range(2):
        streams.ingest_stream(incoming, folder + "/store", folder + "/c1").awaitTermination()
        raw(spark, {"d.md": "later", "a.md": TEXTS["a.md"]}).write.mode("append").parquet(uploads)
    streams.ingest_stream(incoming, folder + "/store", folder + "/c1").awaitTermination()
    store = ChunkStore(spark, folder + "/store")
    assert listing(store) == [("a.md", 1), ("b.md", 1), ("c.md", 2), ("d.md", 1)]
    same_index(store)
    spark.createDataFrame([(7, "报销材料"), (8, " ")], "query_id int, question string").write.parquet(questions)
    asked = spark.readStream.schema("query_id int, question string").parquet(questions)
    streams.answer_stream(asked, store.index, folder + "/answers", folder + "/c2", k=1).awaitTermination()
    answers = spark.read.parquet(folder + "/answers").collect()
    assert [(a["query_id"], [c["source"] for c in a["citations"]]) for a in answers] == [(7, ["a.md"])]


def test_order_of_ingestion_decides_ties(spark, folder):
    store = ChunkStore(spark, folder)
    store.ingest(raw(spark, {"a.md": "same words", "b.md": "same words"}))
    store.ingest(raw(spark, {"a.md": "same words"}))
    questions = retrieval.prepare_queries(spark.createDataFrame([(1, "same")], "query_id int, question string"))
    hits = retrieval.search(store.index(), questions, ("bm25",), (2,)).orderBy("rank").collect()
    assert [h["source"] for h in hits] == ["b.md", "a.md"]
    assert store.load().select(F.max(F.substring("doc_ord", 1, 19).cast("int"))).first()[0] == 2
