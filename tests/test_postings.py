"""The written index: BM25 from postings and dense search over written vectors give what a scan gives."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from evidence_engine.operators import index, postings, retrieval
from evidence_engine.operators.chunking import chunk_documents, identify_documents, unique_documents


def documents(n, seed):
    r = random.Random(seed)
    words = ["w%d" % int(r.paretovariate(0.7)) for _ in range(4000)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(n)]
    texts += [texts[0]] * (n // 3) + ["。", "雪 山 雪山 a.b c+d", "rare-word " + texts[1]]
    return [(f"d/{i % 7}/{i}", t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def corpus(spark):
    raw = spark.createDataFrame(documents(400, 1), "source string, text string").repartition(5)
    return chunk_documents(unique_documents(identify_documents(raw)), 100, 20)


@pytest.fixture(scope="module", params=[2_048, 16])
def written(request, spark, corpus, tmp_path_factory):
    patch = pytest.MonkeyPatch()
    patch.setattr(postings, "WINDOW", request.param)
    patch.setattr(postings, "WINDOWS_TOGETHER", 3)
    yield index.write_index(corpus, f"file://{tmp_path_factory.mktemp('index')}")
    patch.undo()


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(2)
    questions = [" ".join("w%d" % int(r.paretovariate(0.7)) for _ in range(r.randint(1, 8))) for _ in range(30)]
    questions += ["rare-word", "unknown-word", "w1 w1 w1 w2", "雪 山", "?!", documents(400, 1)[0][1]]
    return retrieval.prepare_queries(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"))


def rows(hits):
    return sorted(tuple(r) for r in hits.select("ranking", "query_id", "rank", "chunk_id", "source", "score", "doc_ord", "chunk_index").collect())


@pytest.mark.parametrize("k", [1, 3, 40])
def test_bm25_from_postings(written, asked, k):
    scanned = rows(retrieval.rank_chunks(written, asked, ("bm25",), k, bm25_from="chunks"))
    assert scanned and rows(retrieval.rank_chunks(written, asked, ("bm25",), k, bm25_from="postings")) == scanned
    assert rows(retrieval.rank_chunks(written, asked, ("bm25",), k)) == scanned
    other = {"k1": 0.3, "b": 1.0}
    looked_up = rows(retrieval.rank_chunks(written, asked, ("bm25",), k, bm25_from="postings", **other))
    assert looked_up == rows(retrieval.rank_chunks(replace(written, postings=None), asked, ("bm25",), k, **other))


def test_both_rankings(written, asked):
    both = rows(retrieval.rank_chunks(written, asked, ("dense", "bm25"), 5, bm25_from="postings"))
    assert both == rows(retrieval.rank_chunks(replace(written, postings=None, hashed=None), asked, ("dense", "bm25"), 5))
    many = rows(retrieval.rank_chunks(written, asked, ("dense",), 5, dimension=7))
    assert many == rows(retrieval.rank_chunks(replace(written, hashed=None), asked, ("dense",), 5, dimension=7))


def test_several_passes(written, asked, monkeypatch):
    once = rows(retrieval.rank_chunks(written, asked, ("bm25",), 5, bm25_from="postings"))
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 7)
    assert rows(retrieval.rank_chunks(written, asked, ("bm25",), 5, bm25_from="postings")) == once


def test_what_is_written(written):
    fresh = index.document_frequency(written.chunks)
    assert sorted(map(tuple, written.doc_freq.collect())) == sorted(map(tuple, fresh.collect()))
    own = written.postings.rows.where("part < 0")
    assert own.agg(F.sum("n")).first()[0] == written.chunks.count() == written.chunks.select("place").distinct().count()
    assert written.postings.rows.where("part >= 0").select("term", "window").distinct().count() == written.postings.rows.where("part >= 0").count()


def test_windows_are_skipped(written, asked):
    """Of a question that a few chunks answer well, and of few words, little is read."""
    one = asked.where("question = 'rare-word'")
    use = retrieval.block_use(written, one, 1).first()
    assert use["windows"] >= use["taken"] == use["decoded"] == use["blocks"] >= 1
    assert use["blocks"] < written.postings.rows.count() / 10
    all_of_them = retrieval.block_use(written, asked, 1).first()
    assert all_of_them["taken"] <= all_of_them["windows"] and all_of_them["decoded"] <= all_of_them["blocks"]
    if postings.WINDOW == 16:
        assert all_of_them["taken"] < 0.9 * all_of_them["windows"]
    assert tuple(retrieval.block_use(written, asked.limit(0)).first()) == (0, 0, 0, 0)


def test_an_empty_corpus(spark, corpus, asked, folder):
    empty = index.write_index(corpus.limit(0), f"{folder}/empty")
    assert retrieval.rank_chunks(empty, asked, ("bm25", "dense"), 3, bm25_from="postings").collect() == []


def test_where_bm25_reads_from(written, asked):
    with pytest.raises(ValueError, match="elsewhere"):
        retrieval.rank_chunks(written, asked, ("bm25",), 3, bm25_from="elsewhere")
    with pytest.raises(ValueError, match="postings"):
        retrieval.rank_chunks(replace(written, postings=None), asked, ("bm25",), 3, bm25_from="postings")
