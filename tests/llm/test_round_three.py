"""Alignment of tokens, nearest neighbours and spelling variants against plain versions."""

import random

import numpy as np
import plain
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidence_engine.llm import alignment, neighbours, spelling
from evidence_engine.llm.common import bounded

FILES = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
ODD_TEXTS = [(None, "x y"), (7, None), (7, ""), (7, "a▁b"), (8, "<|endoftext|> <s> <unk> é ﬁ"), (9, " " * 300),
             (9, "\n" * 200 + "abc" * 400), (10, "a"), (10, "a"), (11, "\U0001f642é\x00 " * 60), (12, "<0x41>")]


def order(rows):
    return sorted(rows, key=repr)


# Alignment


def encoders():
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    value = alignment.byte_values()
    tokens = {i: bytes(value.get(c, 0) for c in t) for t, i in a.get_vocab().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])

    def piece(i):
        p = b.IdToPiece(i)
        return bytes([int(p[3:5], 16)]) if b.IsByte(i) else p.replace("▁", " ").encode()

    return (
        lambda t: [(i, tokens[i]) for i in a.encode(" " + t, add_special_tokens=False).ids],
        lambda t: [(i, piece(i)) for i in b.encode(t)],
    )


@pytest.mark.parametrize("common", [1 << 18, 50, 0])
def test_alignment(spark, rows, common):
    bounded(spark)
    texts = [(r[0], r[1]) for r in rows] + ODD_TEXTS
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, key int, pair int").repartition(3)
    found, pairs = alignment.align_tokens(docs, *FILES, common=common)
    assert order(map(tuple, found.collect())) == order(plain.token_alignment(texts, *encoders()))
    assert pairs.where("best").count() >= pairs.select(F.col("pair") % 32000).distinct().count()


def test_alignment_of_nothing(spark):
    found, pairs = alignment.align_tokens(spark.createDataFrame([], "doc_id long, text string"), *FILES)
    assert found.collect() == [] and pairs.collect() == []


def test_ranks_encode_as_the_file_says(rows):
    with open(FILES[0], encoding="utf-8") as file:
        both = alignment.ByteTokenizer(file.read())
    texts = [" " + (t or "") for t in [*(r[1] for r in rows), *(t for _, t in ODD_TEXTS), "x" * 20_000, " " * 20_000]]
    assert both.encode(texts) == both.encode_plainly(texts)


@given(st.lists(st.integers(1, 400), unique=True), st.lists(st.integers(1, 400), unique=True))
def test_shared_ends(a, b):
    a, b = sorted({*a, 401}), sorted({*b, 401})
    i, j = alignment.shared_ends(np.array(a), np.array(b))
    assert [a[x] for x in i] == [b[x] for x in j] == sorted(set(a) & set(b))


# Nearest neighbours


def compare(spark, rows, k=20, **options):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    frame = frame.withColumns({"class": F.lit(1), "vector": F.lit(2), "score": F.lit(3)})
    found = {}
    for r in neighbours.nearest(frame, F.pmod("vec_id", F.lit(20)) == 0, k=k, **options).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want, hits = plain.nearest(rows, k, 20), 0
    for query, expected in want.items():
        got = sorted(found.get(query, []))
        assert [x[0] for x in got] == list(range(1, len(got) + 1))
        assert [x[1:] for x in got] == sorted((x[1:] for x in got), key=lambda x: (-x[0], x[1]))
        exact = {j: -s for s, j in expected}
        near = [x for x in got if x[2] in exact]
        assert all(abs(x[1] - exact[x[2]]) <= 1e-12 * max(1, abs(x[1])) for x in near)
        hits += len(near)
    assert set(found) == set(want)
    return hits / sum(map(len, want.values())) if want else 1


def test_neighbours(spark):
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=7) * 10 ** r.uniform(-3, 3)).tolist()) for i in range(600)]
    rows += [(i, rows[0][1]) for i in range(600, 700)] + [(i, rows[0][1]) for i in range(600, 640)]
    rows += [(None, rows[1][1]), (701, None), (702, [0.0] * 7), (720, [float("nan")] * 7), (740, [1.0] * 6 + [None]),
             (760, [1.0] * 3), (780, []), (5, rows[9][1]), (20, rows[9][1]), (-20, rows[3][1]), (800, [float("inf")] * 7)]
    assert compare(spark, rows) >= 0.95
    assert compare(spark, rows[:5]) == 1
    assert compare(spark, []) == 1
    assert compare(spark, rows[20:21]) == 1
    assert compare(spark, rows[:300], recall=1.1) == 1  # then all cells are visited


def test_neighbours_in_split_regions(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=16).tolist()) for i in range(1500)]
    for name, value in (("BLOCK", 60), ("REGION", 2), ("HELD", 500)):
        monkeypatch.setattr(neighbours, name, value)
    assert compare(spark, rows) >= 0.9


def test_recall_on_the_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    assert compare(spark, rows) >= 0.9


# Spelling variants


def test_words_of_odd_texts(spark, rows):
    texts = [(r[0], r[1]) for r in rows] + [(None, "Éléphant éléphant Elephants elephants"), (3, "abcdefg" * 5000), (3, None)]
    docs = spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, word int")
    found = spelling.spelling_variants(docs).collect()
    assert sorted(map(tuple, found)) == plain.variants(plain.noisy_words(texts))


def test_variants_of_the_given_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    found = sorted(map(tuple, spelling.spelling_variants(docs).collect()))
    assert found == plain.variants(plain.noisy_words(texts)) and any(r[1] for r in found)


@pytest.mark.parametrize("limit", [0, 1, 64, 10**9])
def test_crowded_chunks(spark, limit):
    r, n = random.Random(3), {}
    for head in ("abcdef", "zzz"):
        for _ in range(500):
            n[head + "".join(r.choices("ab", k=r.randint(4, 8)))] = r.choice([2, 3, 20, 30, 300, 5000])
    for _ in range(200):
        n["".join(r.choices("aé", k=r.randint(7, 9)))] = r.choice([2, 30, 400])
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(map(tuple, spelling.group_variants(words, pairs_per_word=limit).collect())) == plain.variants(n)


def test_no_words(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []
