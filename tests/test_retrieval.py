import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidence_engine.functions.text import tokenize
from evidence_engine.operators import index, kernels, retrieval, scoring, vectors
from evidence_engine.sources.scratch import append

TEXTS = [
    "员工报销需在十个工作日内提交。",
    "P0 事件 must be reported in 15 minutes; P0 first.",
    "the cat sat on the mat",
    "the cat sat on the mat",
    "。！？",
    "cat cat cat dog",
    "报销 材料 提交 deadline",
    "élan vital",
    "the dog and the cat and the mat",
    "中 a 文 b 字",
]
QUESTIONS = ["报销材料多久提交？", "cat", "cat cat mat", "？！", "P0 事件 dog", "unknownword", "the the the mat 文字", "a b"]


@pytest.fixture(scope="module")
def many():
    rnd = random.Random(11)
    words = ["cat", "dog", "mat", "the", "p0", "报", "销", "中", "文", "x1", "y2", "z3"]
    texts = [" ".join(rnd.choices(words, k=rnd.randint(0, 12))) for _ in range(300)]
    return TEXTS + texts


def corpus(spark, texts, partitions=3):
    rows = [(f"c{n}", f"d{n}", f"s{n}", text, (0,), f"{n:05d}") for n, text in enumerate(texts)]
    random.Random(7).shuffle(rows)
    schema = "chunk_id string, document_id string, source string, text string, metadata struct<chunk_index:int>, doc_ord string"
    return index.build_index(spark.createDataFrame(rows, schema).repartition(partitions))


def asked(spark, questions=QUESTIONS):
    return retrieval.prepare_queries(spark.createDataFrame(list(enumerate(questions)), "query_id long, question string"))


def as_lists(hits):
    found = {}
    for row in hits.collect():
        found.setdefault((row["strategy"], row["k"], row["query_id"]), []).append(row)
    return {key: sorted(rows, key=lambda r: r["rank"]) for key, rows in found.items()}


def check(hits, texts, questions, strategy, k, expected):
    lists = as_lists(hits.where((F.col("strategy") == strategy) & (F.col("k") == k)))
    for number, question in enumerate(questions):
        rows = lists.get((strategy, k, number), [])
        wanted = expected(texts, question, k)
        assert [r["chunk_id"] for r in rows] == [f"c{i}" for i, _ in wanted], (strategy, k, question)
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert np.allclose([r["score"] for r in rows], [s for _, s in wanted], atol=1e-8)


@pytest.mark.parametrize("which", ["few", "many"])
def test_strategies_equal_brute_force(spark, many, which):
    texts = many if which == "many" else TEXTS
    hits = retrieval.search(corpus(spark, texts), asked(spark), ("hybrid", "dense", "bm25"), (1, 4)).cache()
    for k in (1, 4):
        check(hits, texts, QUESTIONS, "dense", k, brute.dense)
        check(hits, texts, QUESTIONS, "bm25", k, brute.bm25)
        check(hits, texts, QUESTIONS, "hybrid", k, brute.fused)


def test_odd_dimension_has_signs(spark, many):
    hits = retrieval.search(corpus(spark, many), asked(spark), ("dense",), (300,), dimension=7)
    assert hits.where("score < 0").count() > 0
    check(hits, many, QUESTIONS, "dense", 300, lambda t, q, k: brute.dense(t, q, k, dimension=7))


def test_weights_and_md5(spark, many):
    options = dict(rrf_k=5, dense_weight=0.5, sparse_weight=3.0)
    hits = retrieval.search(corpus(spark, many), asked(spark), ks=(3,), family="md5", **options)
    check(hits, many, QUESTIONS, "hybrid", 3, lambda t, q, k: brute.fused(t, q, k, family="md5", **options))


def test_small_passes_small_batches_and_salted_merge(spark, many, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 3)
    monkeypatch.setattr(retrieval, "MERGE_GROUPS", 3)
    monkeypatch.setattr(kernels, "BLOCK_CELLS", 4_000)
    monkeypatch.setattr(kernels, "POOL_ROWS", 1)
    assert len(list(retrieval.query_passes(asked(spark), ["tokens"], 4))) > 1
    hits = retrieval.search(corpus(spark, many, 9), asked(spark), ("hybrid", "dense"), (4,)).cache()
    check(hits, many, QUESTIONS, "hybrid", 4, brute.fused)
    check(hits, many, QUESTIONS, "dense", 4, brute.dense)


def test_passes_write_ranks_without_texts_and_give_broadcasts_back(spark, many, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERIES_PER_PASS", 2)
    payloads, live, most = [], set(), []
    context = type(spark.sparkContext)
    monkeypatch.setattr(retrieval, "append", lambda df, path: payloads.append(df.columns) or append(df, path))
    broadcast = context.broadcast

    def tracked(self, value):
        shared = broadcast(self, value)
        live.add(shared)
        most.append(len(live))
        destroy = shared.destroy
        shared.destroy = lambda *args: (live.discard(shared), destroy(*args))
        return shared

    monkeypatch.setattr(context, "broadcast", tracked)
    hits = retrieval.search(corpus(spark, many), asked(spark), ("hybrid",), (4,))
    assert len(payloads) > 1 and not any("text" in columns or "tokens" in columns for columns in payloads)
    assert max(most) == 1 and not live
    assert len(payloads) >= 4 and "Union" not in hits._jdf.queryExecution().optimizedPlan().toString()
    texts = {f"c{n}": text for n, text in enumerate(many)}
    assert all(row["text"] == texts[row["chunk_id"]] for row in hits.collect())
    check(hits, many, QUESTIONS, "hybrid", 4, brute.fused)


def test_bm25_in_blocks_of_any_length(monkeypatch):
    """Rare terms that many queries share are added in bounded blocks; the sums are the same."""
    rnd = np.random.default_rng(3)
    words = [f"w{n}" for n in range(40)]
    term, query = np.nonzero(rnd.random((40, 30)) < 0.5)
    parts = (pa.array(words), np.zeros(40), (term, query, rnd.random(len(term))), 30, 8.0, 1.5, 0.75)
    table = pa.table({"tokens": [list(rnd.choice(words, rnd.integers(0, 12))) for _ in range(50)]})
    whole = kernels.Bm25Scorer(*parts)(table)
    assert whole.any()
    for cells in (1, 7, 100):
        monkeypatch.setattr(kernels, "BLOCK_CELLS", cells)
        assert np.allclose(kernels.Bm25Scorer(*parts)(table), whole)


def test_a_third_of_all_chunks_is_one_text(spark, many):
    texts = many[:200] + [many[1]] * 50 + many[200:] + [many[1]] * 105
    hits = retrieval.search(corpus(spark, texts, 7), asked(spark), ("hybrid", "dense", "bm25"), (5, 200)).cache()
    for k in (5, 200):
        check(hits, texts, QUESTIONS, "dense", k, brute.dense)
        check(hits, texts, QUESTIONS, "bm25", k, brute.bm25)
        check(hits, texts, QUESTIONS, "hybrid", k, brute.fused)


def test_query_without_tokens(spark):
    """Dense returns the first chunks of the corpus with score 0, BM25 nothing."""
    lists = as_lists(retrieval.search(corpus(spark, TEXTS), asked(spark, ["？"]), ("bm25", "dense"), (3,)))
    assert [(r["chunk_id"], r["score"]) for r in lists["dense", 3, 0]] == [("c0", 0.0), ("c1", 0.0), ("c2", 0.0)]
    assert ("bm25", 3, 0) not in lists


def test_exact_ties_follow_corpus_order(spark):
    lists = as_lists(retrieval.search(corpus(spark, TEXTS), asked(spark, ["the cat on the mat"]), ("dense",), (2,)))
    assert [r["chunk_id"] for r in lists["dense", 2, 0]] == ["c2", "c3"]


def test_empty_corpus_and_no_queries(spark):
    empty = corpus(spark, TEXTS)
    none = index.build_index(empty.chunks.drop("tokens", "n_tokens").limit(0))
    assert retrieval.search(none, asked(spark), ("hybrid", "bm25", "dense")).count() == 0
    assert retrieval.search(corpus(spark, TEXTS), asked(spark, ["  "])).count() == 0
    stats = none.stats.first()
    assert (stats["n_chunks"], stats["avg_len"]) == (0, 0.0)


def test_blank_queries(spark):
    questions = spark.createDataFrame([(1, " 　"), (2, " x ")], "query_id int, question string")
    assert [r["query_id"] for r in retrieval.blank_queries(questions).collect()] == [1]
    assert [r["searched"] for r in retrieval.prepare_queries(questions).collect()] == ["x"]
    with pytest.raises(Exception, match="blank question: 1"):
        retrieval.prepare_queries(questions, strict=True).collect()


@pytest.mark.parametrize("strategies, ks", [(("bm42",), (1,)), ((), (1,)), (("bm25",), (0,))])
def test_bad_arguments(spark, strategies, ks):
    with pytest.raises(ValueError):
        retrieval.search(corpus(spark, TEXTS), asked(spark), strategies, ks)


def test_strategies_are_used_once():
    assert retrieval.check_strategies(["dense", "bm25", "dense"]) == ["dense", "bm25"]


def test_scores_of_pairs(spark, many):
    pairs = spark.createDataFrame([(q, f"c{n}") for q in range(len(QUESTIONS)) for n in range(0, 310, 7)], "query_id long, chunk_id string")
    built = corpus(spark, many)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in scoring.bm25_score(built, asked(spark), pairs).collect()}
    assert len(got) == pairs.count()
    for number, question in enumerate(QUESTIONS):
        wanted = {f"c{i}": s for i, s in brute.bm25(many, question, len(many))}
        for (query, chunk), score in got.items():
            if query == number:
                assert score == pytest.approx(wanted.get(chunk, 0.0), abs=1e-9)


def test_statistics_count_chunks_without_tokens(spark):
    built = corpus(spark, TEXTS)
    lengths = [len(brute.terms(t)) for t in TEXTS]
    stats = built.stats.first()
    assert (stats["n_chunks"], stats["avg_len"]) == (len(TEXTS), sum(lengths) / len(TEXTS))
    df = {r["term"]: r["df"] for r in built.doc_freq.collect()}
    assert df["cat"] == 4 and df["报销"] == 2 and df["中文"] == 1


def test_hash_golden():
    number = int(kernels.hash_terms(["p0"], "blake2b")[0])
    assert (number % 384, number % 2) == (372, 0)
    assert kernels.hash_terms(["p0", "中"], "md5").tolist() == [
        int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in ("p0", "中")
    ]
    with pytest.raises(ValueError):
        kernels.hash_terms(["p0"], "crc")


@pytest.mark.parametrize("dimension", [7, 384])
def test_hash_embed(spark, dimension):
    built = corpus(spark, TEXTS)
    rows = vectors.hash_embed(built.chunks, dimension).collect()
    for number, text in enumerate(TEXTS):
        wanted = {b: n for b, n in brute.hashed(text, dimension).items() if n}
        own = [r for r in rows if r["chunk_id"] == f"c{number}"]
        assert {r["bucket"]: r["count"] for r in own} == wanted
        assert sum(r["value"] ** 2 for r in own) == pytest.approx(1.0 if wanted else 0.0)


def test_external_vectors(spark):
    rnd = np.random.default_rng(3)
    data, queries = rnd.normal(size=(60, 5)), rnd.normal(size=(4, 5))
    data[10] = 0
    rows = [(f"c{n}", f"s{n}", (0,), f"{n:03d}", v.tolist()) for n, v in enumerate(data)]
    schema = "chunk_id string, source string, metadata struct<chunk_index:int>, doc_ord string, vector array<double>"
    chunks = spark.createDataFrame(rows, schema).repartition(4)
    asked_vectors = spark.createDataFrame([(n, v.tolist()) for n, v in enumerate(queries)], "query_id int, vector array<double>")
    got = retrieval.rank_vectors(chunks, asked_vectors, 60, ("chunk_id",)).collect()
    norm = np.linalg.norm(data, axis=1)
    norm[norm == 0] = 1
    scores = (queries @ data.T) / np.linalg.norm(queries, axis=1)[:, None] / norm
    for number in range(4):
        own = sorted((r["rank"], r["chunk_id"]) for r in got if r["query_id"] == number)
        assert [c for _, c in own] == [f"c{i}" for i in brute.ranked(list(scores[number]), 60)]
    short = asked_vectors.withColumn("vector", F.slice("vector", 1, 4))
    with pytest.raises(Exception, match="vector dimensions differ"):
        retrieval.rank_vectors(chunks, short, 3, ("chunk_id",)).collect()


def test_hybrid_with_a_users_embedding(spark, many):
    """The same single scan, with vectors that a column function makes of the text."""
    signs = "abcdeht中"

    def model(text):
        return F.array(*[(F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))).cast("double") for s in signs])

    def dense(texts, question, k):
        vectors_ = np.array([[t.count(s) for s in signs] for t in texts], dtype=float)
        query = np.array([question.count(s) for s in signs], dtype=float)
        norm = np.linalg.norm(vectors_, axis=1)
        norm[norm == 0] = 1
        scores = vectors_ @ query / norm / (np.linalg.norm(query) or 1)
        return [(i, scores[i]) for i in brute.ranked(list(scores), k)]

    built, queries = retrieval.embed(corpus(spark, many), asked(spark), model)
    hits = retrieval.search(built, queries, ("hybrid", "dense"), (4,), embedding="vectors").cache()
    check(hits, many, QUESTIONS, "dense", 4, dense)
    check(hits, many, QUESTIONS, "hybrid", 4, lambda t, q, k: brute.fuse(dense(t, q, 12), brute.bm25(t, q, 12), k))
    with pytest.raises(ValueError, match="unknown embedding"):
        retrieval.search(built, queries, embedding="vector")


def test_cosine(spark):
    rows = [([1.0, 0.0], [2.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0, 2.0], [-1.0, -2.0], -1.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, expected double")
    for row in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("got"), "expected").collect():
        assert row["got"] == pytest.approx(row["expected"])
    with pytest.raises(Exception, match="vector dimensions differ"):
        df.select(vectors.cosine(F.col("a"), F.slice("b", 1, 1))).collect()


def test_tokens_of_chunks_are_the_tokens_of_queries(spark):
    df = spark.createDataFrame([("Q&A: 中文 GPT-4",)], "t string")
    assert df.select(tokenize(F.col("t")).alias("r")).first()["r"] == brute.terms("Q&A: 中文 GPT-4")
