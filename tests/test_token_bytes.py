"""Tokens from whole batches of bytes are those of the column expression, and a written index takes them in one pass."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import index, kernels, vectors

LETTERS = [*"abZ9_+#.- \n,", "䷿", "一", "鿿", "ꀀ", "雪", "é", "İ", "K", "\U0001f600", "\U00020000", "퟿", ""]


def texts():
    r = random.Random(3)
    found = ["".join(r.choices(LETTERS if i % 3 else LETTERS[:12], k=r.randint(0, 40))) for i in range(600)]
    return ["", *found, None, "雪", "雪山", "雪a山", "A", ""]


def test_tokens_of_bytes(spark):
    rows = spark.createDataFrame(list(enumerate(texts())), "i int, t string").select("t", tx.tokenize(F.col("t")).alias("k")).collect()
    wanted = [r["k"] for r in rows]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([r["t"] for r in rows], kind)
        assert kernels.split_tokens(column).to_pylist() == wanted
        assert kernels.split_tokens(column.slice(2, 300)).to_pylist() == wanted[2:302]
        assert kernels.split_tokens(column.slice(0, 0)).to_pylist() == []


def test_bytes_that_are_no_text(spark):
    broken = [b"a\xe4\xb8", b"\xe4\xb8\x80b\xff", b"\xe9\xe4\xb8\x80", b"\xe4b\x80", b"\xb8\x80a", b"\xe4"]
    rows = spark.createDataFrame(list(enumerate(broken)), "i int, b binary").selectExpr("i", "cast(b as string) as t")
    wanted = [r["k"] for r in rows.select("i", tx.tokenize(F.col("t")).alias("k")).orderBy("i").collect()]
    assert kernels.split_tokens(pa.array(broken, pa.binary())).to_pylist() == wanted


def test_the_index_is_written_in_one_pass(spark, folder, monkeypatch):
    rows = [(f"c{i}", t, i) for i, t in enumerate(texts()) if t]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, n int").select(
        "chunk_id", "text", F.lit("d").alias("document_id"), F.lit("s").alias("source"), F.struct(F.col("n").alias("chunk_index")).alias("metadata"), F.lit("o").alias("doc_ord")
    )
    columns = ("chunk_id", "tokens", "n_tokens", "hashed")
    wanted = vectors.with_hashed(index.with_tokens(chunks)).select(*columns).collect()
    monkeypatch.setattr(index, "with_tokens", None)
    monkeypatch.setattr(index, "with_hashed", None, raising=False)
    written = index.write_index(chunks.withColumn("tokens", F.lit("other")), folder + "/index").chunks
    assert sorted(map(tuple, written.select(*columns).collect())) == sorted(map(tuple, wanted))
