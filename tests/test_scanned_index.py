"""A corpus that is searched once: its chunks are not written, and its hits are those of a written index."""

from pyspark.sql import functions as F

from evidence_engine.operators import index, retrieval
from evidence_engine.operators.chunking import chunk_documents, identify_documents
from evidence_engine.plans import queries
from evidence_engine.sources import driver_tables as given

SF_DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hits_of_a_scanned_index(spark, folder):
    texts = [(f"d/{i}", t) for i, t in enumerate(["red fox " * 90, "blue 雪山 fox", "red", "。", "a.b blue " * 70])]
    chunks = chunk_documents(identify_documents(spark.createDataFrame(texts, "source string, text string")), 100, 20)
    scanned, written = index.scanned_index(chunks), index.write_index(chunks, folder + "/index")
    assert rows(scanned.doc_freq) == rows(written.doc_freq) and rows(scanned.stats) == rows(written.stats)
    asked = [(1, "red fox"), (2, "雪山 blue"), (3, "?!"), (4, "unknown")]
    asked = retrieval.prepare_queries(spark.createDataFrame(asked, "query_id int, question string"))
    for keep in (("source",), ("source", "text")):
        found = [retrieval.search(corpus, asked, ("bm25", "dense", "hybrid"), (1, 3), keep) for corpus in (scanned, written)]
        assert rows(found[0]) == rows(found[1]) != []
    ranked = [rows(retrieval.rank_chunks(corpus, asked, ("bm25",), 2, ("chunk_id", "text"))) for corpus in (scanned, written)]
    assert ranked[0] == ranked[1]
    own = [rows(retrieval.search(*retrieval.embed(corpus, asked, queries.letter_counts), embedding="vectors")) for corpus in (scanned, written)]
    assert own[0] == own[1] != []
    empty = index.scanned_index(chunks.limit(0))
    assert rows(empty.stats) == [(0, 0.0)] and rows(empty.doc_freq) == []
    assert retrieval.search(empty, asked, ("bm25", "hybrid"), (3,)).isEmpty()


def test_the_ablation_writes_no_index(spark, monkeypatch):
    monkeypatch.setattr(given, "write_index", None)
    monkeypatch.setattr(given, "_WRITTEN", {})
    found = queries.chunk_ablation(spark, SF_DIR)
    assert found.select("chunk_size").distinct().count() == len(queries.ABLATION_SIZES)


def test_the_vocabulary_is_not_broadcast(spark, folder, monkeypatch):
    plans, weigh = [], retrieval.weigh
    monkeypatch.setattr(retrieval, "weigh", lambda *parts: plans.append(weigh(*parts)) or plans[-1])
    corpus = given.corpus_index(spark, SF_DIR)
    asked = given.questions(spark, SF_DIR)
    asked = asked.join(asked.select("query_id").withColumn("n", F.lit(1)).crossJoin(spark.range(1)), "query_id")
    retrieval.search(corpus, retrieval.prepare_queries(asked), ("bm25",), (1,), ("source",)).count()
    plan = plans[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint" not in plan and "leftHint=(strategy=broadcast)" in plan
