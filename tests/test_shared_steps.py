"""The steps that searches and stores share: one pass over texts, bounded batches, workers that give memory back."""

from pyspark.sql import functions as F

from evidence_engine.functions import text as tx
from evidence_engine.operators import kernels
from evidence_engine.plans import queries
from evidence_engine.sources import driver_tables

TEXTS = ["Abc zZ ÉK", "", "a  b\t\tc", "中文 A.b", "x" * 300 + "Y"]


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_counted_in_one_pass(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").repartition(1)
    counted = texts.select("i", queries.letter_counts(F.col("t")).alias("n"))
    assert "replace(" not in planned(counted)
    lower = [t.translate({ord(c): c.lower() for c in queries.LETTERS.upper()}) for t in TEXTS]
    assert {r["i"]: r["n"] for r in counted.collect()} == {i: [float(t.count(c)) for c in queries.LETTERS] for i, t in enumerate(lower)}


def test_texts_are_not_translated(spark):
    texts = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert "translate(" not in planned(texts.select(tx.tokenize(F.col("t"))))


def test_batches_are_bounded(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    driver_tables.table(spark, "/root/testdata/sf0.001", "benchmark")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 4000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_memory_is_given_back(monkeypatch):
    given = []
    monkeypatch.setattr(kernels, "give_back", lambda: given.append(1))
    rows = kernels.tidy(lambda batches: (b for b in batches))(iter([1, 2, 3]))
    assert next(rows) == 1 and not given
    rows.close()
    assert given == [1]


def test_terms_beyond_the_cache(monkeypatch):
    monkeypatch.setattr(kernels, "CACHED_TERMS", 2)
    hasher, terms = kernels.TermHasher(7, "md5"), ["a", "b", "c", "d"]
    for part in (terms[:3], terms[1:], terms):
        assert hasher._values(part).tolist() == kernels.hash_terms(part, "md5").tolist()
