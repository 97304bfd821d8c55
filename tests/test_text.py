import hashlib
import random

import brute
import pytest
from pyspark.sql import functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.functions.chunk_windows import check_chunk_params, chunk_windows
from evidence_engine.functions.rounding import round_exact
from evidence_engine.operators import chunking

ALPHABET = ["a", "B", "中", "文", "。", "！", "；", "\n", "\n", "\r", " ", "\t", "　", "😀", "é", "x", "z", "?", "."]


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, t {kind}").select("i", expression(F.col("t")).alias("r"))
    return [row["r"] for row in sorted(rows.collect(), key=lambda row: row["i"])]


def random_texts(n, longest, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choices(ALPHABET, k=rnd.randint(0, longest))) for _ in range(n)]


def test_strip_removes_all_unicode_whitespace(spark):
    every = "".join(chr(i) for i in range(0x110000) if chr(i).isspace())
    assert set(every) == set(fv.WHITESPACE)
    texts = [every + "a" + every + "b" + every, every, "", "x", "\u200bx"]
    assert column(spark, texts, tx.strip) == [t.strip() for t in texts]


def test_normalize(spark):
    texts = ["a\r\nb\rc", "a \t\t b", "a\n\n\n\nb", "　 a\n \n \n b \xa0", " \n ", *random_texts(50, 80)]
    assert column(spark, texts, tx.normalize) == [brute.normalized(t) for t in texts]
    assert column(spark, ["\n \n \n"], lambda t: tx.normalize(F.concat(F.lit("a"), t, F.lit("b")))) == ["a\n \n \nb"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("中 a 文", ["中", "a", "文", "中文"]),
        ("P0 事件", ["p0", "事", "件", "事件"]),
        ("élan", ["lan"]),
        ("C++ GPT-4 a_b.c #1", ["c++", "gpt-4", "a_b.c", "#1"]),
        ("中。文，字", ["中", "文", "字", "中文", "文字"]),
        ("\u212a \u0130", []),  # letters whose lower case starts with ASCII still separate
        ("字", ["字"]),
        ("。 é", []),
        ("", []),
    ],
)
def test_tokenize(spark, text, expected):
    assert column(spark, [text], tx.tokenize) == [expected]
    assert brute.terms(text) == expected


def test_tokenize_and_count_random_texts(spark):
    texts = random_texts(80, 300, seed=2)
    assert column(spark, texts, tx.tokenize) == [brute.terms(t) for t in texts]
    counted = column(spark, texts, lambda t: tx.term_counts(tx.tokenize(t)))
    for text, counts in zip(texts, counted):
        expected = {}
        for term in brute.terms(text):
            expected[term] = expected.get(term, 0) + 1
        assert {c["term"]: c["tf"] for c in counts} == expected
        assert len(counts) == len(expected)


def test_path_order_compares_parts(spark):
    paths = ["a-b", "a/b", "a", "a/b/c", "a b", "A/z", "é/a"]
    keys = column(spark, paths, tx.path_order)
    assert [p for _, p in sorted(zip(keys, paths))] == sorted(paths, key=lambda p: p.split("/"))


@pytest.mark.parametrize("size, overlap", [(500, 80), (100, 0), (120, 119), (200, 30), (3000, 300)])
def test_chunk_windows_equal_a_plain_loop(spark, size, overlap):
    texts = [
        *random_texts(25, 4500, seed=size),
        "a" * 300 + "　" * 1500 + "b" * 700,
        "　" * 50,
        "",
        "".join(random.Random(3).choices("abc中文😀", k=5000)),
        ("短句测试。" * 80 + "\n\n") * 2,
    ]
    got = column(spark, texts, lambda t: chunk_windows(tx.normalize(t), size, overlap))
    assert [[tuple(w) for w in g] for g in got] == [brute.windows(t, size, overlap) for t in texts]


def test_blank_windows_do_not_take_an_index(spark):
    raw = spark.createDataFrame([("s", "a" * 130 + "　" * 900 + "b" * 50)], "source string, text string")
    chunks = chunking.chunk_documents(chunking.identify_documents(raw), 100, 10).orderBy("start_char").collect()
    assert [c["metadata"]["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert any(b["start_char"] - a["end_char"] > 0 for a, b in zip(chunks, chunks[1:]))


def test_chunks_overlap_and_cover(spark):
    text = "句子测试。" * 100 + "\n\n" + "句子测试。" * 100
    raw = spark.createDataFrame([("s.md", text)], "source string, text string")
    chunks = chunking.chunk_documents(chunking.identify_documents(raw), 200, 30).orderBy("start_char").collect()
    assert len(chunks) > 2 and all(c["text"] for c in chunks)
    assert chunks[0]["start_char"] == 0 and chunks[-1]["end_char"] == len(text)
    assert all(a["end_char"] - b["start_char"] == 30 for a, b in zip(chunks, chunks[1:]))


def test_ids(spark):
    raw = spark.createDataFrame([("a/b.md", "　 hello\tworld \n")], "source string, text string")
    document = chunking.identify_documents(raw).first()
    expected = hashlib.sha1("a/b.md\0hello\tworld".encode()).hexdigest()[:16]
    assert (document["document_id"], document["text"]) == (expected, "hello\tworld")
    chunk = chunking.chunk_documents(chunking.identify_documents(raw)).first()
    assert chunk["chunk_id"] == hashlib.sha1(f"{expected}:0:0:11".encode()).hexdigest()[:16]
    assert chunk["text"] == "hello world"


@pytest.mark.parametrize("size, overlap", [(99, 10), (100, 100), (100, -1), (200, 250)])
def test_bad_chunk_params(size, overlap):
    with pytest.raises(ValueError):
        check_chunk_params(size, overlap)


@pytest.mark.parametrize("decimals", [0, 2, 4, 6])
def test_round_exact_is_pythons_round(spark, decimals):
    rnd = random.Random(5)
    values = [2.675, 0.03125, 0.00625, 0.5, 1.5, 2.5, 0.0, 1 / 3, 0.00005, 0.00015, 12.0000005]
    values += [rnd.random() for _ in range(500)] + [n / 160 for n in range(300)] + [n / 20000 for n in range(999)]
    assert column(spark, values, lambda x: round_exact(x, decimals), "double") == [round(v, decimals) for v in values]
    assert column(spark, [None], lambda x: round_exact(x, decimals), "double") == [None]


def test_windows_are_cut_in_one_pass_outside_the_plan(spark):
    """No fold over an array in the plan: it took about 1,000 CPU seconds a GB."""
    table = spark.createDataFrame([("one two\n" * 200,)], "text string")
    plan = table.select(chunk_windows(F.col("text")).alias("w"))._jdf.queryExecution().toString()
    assert "aggregate(" not in plan and "ArrowEvalPython" in plan


def test_windows_of_missing_empty_and_broken_texts(spark):
    table = spark.sql("select * from values (1, cast(null as string)), (2, ''), (3, string(x'61FF62')), (4, 'ab') as t(i, text)")
    rows = table.select("i", chunk_windows(F.col("text")).alias("w")).orderBy("i").collect()
    assert [[(w["start"], w["end"], w["text"]) for w in r["w"]] for r in rows] == [[], [], [(0, 3, "a�b")], [(0, 2, "ab")]]
