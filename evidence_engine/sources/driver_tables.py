"""The given tables as documents, questions, cases, pages and vectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.operators.chunking import chunk_documents, identify_documents
from evidence_engine.operators.index import Index, read_index, scanned_index, write_index
from evidence_engine.sources.scratch import bound_batches, materialize, scratch_path, spread

ANCHOR_WORDS = 4

_WRITTEN: dict[tuple, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. A table is one file or a folder of files; a pattern that only its name fits reads both."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def raw_documents(spark: SparkSession, sf_dir: str, condition: str = "true") -> DataFrame:
    """``doc_id, source, text``; the source is made unique so that it is a path of one document."""
    documents = table(spark, sf_dir, "documents").where(condition).select("doc_id", "source", "text")
    return spread(documents, "doc_id").withColumn("source", _path())


def _path() -> Column:
    return F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 19, "0"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(raw_documents(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("question")
    )


def _state(spark: SparkSession, path: str) -> tuple:
    """What changes when a table's files do: their number, and a sum over names, lengths and times."""
    files = spark.read.format("binaryFile").load(path)  # the contents are not read
    named = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
    return tuple(files.agg(F.count(F.lit(1)), F.sum(named)).first())


def written_once(
    spark: SparkSession, name: str, key: tuple, sources: Sequence[str], write: Callable[[str], object]
) -> str:
    """Path of a table derived from ``sources``, written once by an application until one of them changes."""
    key = (spark.sparkContext.applicationId, name, *key, *(_state(spark, path) for path in sources))
    if key in _WRITTEN:
        try:
            spark.read.text(f"{_WRITTEN[key]}/*/_SUCCESS")
            return _WRITTEN[key]
        except AnalysisException:  # cleared in the meantime
            pass
    path = scratch_path(spark, name)
    write(path)
    _WRITTEN[key] = path
    return path


def corpus_index(
    spark: SparkSession, sf_dir: str, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> Index:
    """The written index of the documents, built once per application and chunking."""

    def write(path: str) -> None:
        write_index(chunk_documents(documents(spark, sf_dir), size, overlap), path)

    path = written_once(spark, "index", (sf_dir, size, overlap), [f"{sf_dir}/documents.parquet"], write)
    return read_index(spark, path)


def scanned_corpus(spark: SparkSession, sf_dir: str, size: int, overlap: int = fv.CHUNK_OVERLAP) -> Index:
    """The documents under other chunk settings, searched without a written copy of the chunks."""
    return scanned_index(chunk_documents(documents(spark, sf_dir), size, overlap))


def _words(text: Column) -> Column:
    """Words between blanks and line ends."""
    squeezed = F.regexp_replace(text, "[ \t\r\n]+", " ")
    return F.split(F.trim(squeezed), " ")


def _anchors(words: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` neighbouring words."""
    return tx.let(
        words,
        lambda w: F.when(
            F.array_size(w) >= length,
            F.transform(
                F.sequence(F.lit(1), F.array_size(w) - (length - 1)),
                lambda start: F.xxhash64(F.slice(w, start, F.lit(length))),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )


def find_passages(texts: DataFrame, passages: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where a text contains a passage as whole words.

    An equi-join on hashed runs of the passage's first words finds the few candidates, which are
    then compared in full: no text meets a passage with which it shares no run of words. The
    candidates are written first; Spark then knows how few they are, and need not shuffle texts.
    """
    items = passages.select("item_id", _words(F.col("text")).alias("words")).where("words[0] <> ''")
    least = 1 if not items.where(F.array_size("words") < ANCHOR_WORDS).isEmpty() else ANCHOR_WORDS
    lengths = sorted({least, ANCHOR_WORDS})
    run = F.when(F.array_size("words") < ANCHOR_WORDS, F.lit(least)).otherwise(F.lit(ANCHOR_WORDS))
    keyed = items.select("item_id", "words", F.xxhash64(F.slice("words", F.lit(1), run)).alias("anchor"))
    runs = F.concat(*(_anchors(_words(F.col("text")), n) for n in lengths))
    candidates = (
        texts.select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor"))
        .join(keyed.select("item_id", "anchor"), "anchor")
        .select("doc_id", "item_id")
        .distinct()
    )
    padded = F.concat(F.lit(" "), F.array_join(_words(F.col("text")), " "), F.lit(" "))
    sought = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    return (
        texts.select("doc_id", "text")
        .join(materialize(candidates, "candidates"), "doc_id")
        .join(keyed.select("item_id", "words"), "item_id")
        .where(F.contains(padded, sought))
        .select("doc_id", "item_id")
    )


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, source, lang, doc_ord``: the documents in which a question's text occurs."""

    def write(path: str) -> None:
        texts = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
        found = find_passages(texts, table(spark, sf_dir, "benchmark"))
        named = table(spark, sf_dir, "documents").select("doc_id", _path().alias("source"), "lang")
        rows = found.join(named, "doc_id").select(
            F.col("item_id").alias("case_id"), "source", "lang", tx.path_order(F.col("source")).alias("doc_ord")
        )
        rows.write.parquet(f"{path}/rows")

    sources = [f"{sf_dir}/{name}.parquet" for name in ("documents", "benchmark")]
    return spark.read.parquet(written_once(spark, "relevance", (sf_dir,), sources, write) + "/rows")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case per benchmark item; items that occur in no document should not be answered."""
    first = relevance(spark, sf_dir).groupBy("case_id").agg(F.min_by("lang", "doc_ord").alias("lang"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("question"))
    return items.join(first, "case_id", "left").select(
        "case_id",
        F.coalesce("lang", F.lit("out_of_scope")).alias("category"),
        "question",
        F.lit("").alias("reference_answer"),
        F.col("lang").isNotNull().alias("should_answer"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User vectors as a chunk table; the source of a vector is its label."""
    key = F.lpad(F.col("vec_id").cast("string"), 19, "0")
    return table(spark, sf_dir, "embeddings").select(
        key.alias("chunk_id"),
        F.concat(F.lit("label-"), F.col("label").cast("string")).alias("source"),
        F.struct(F.lit(0).alias("chunk_index")).alias("metadata"),
        key.alias("doc_ord"),
        F.col("embedding").alias("vector"),
    )


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query vector per label: the mean of its vectors, rounded so that it is the same everywhere."""
    labelled = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    means = labelled.groupBy("label", "position").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("position", "x")))
    return means.groupBy("label").agg(ordered["x"].alias("vector")).withColumnRenamed("label", "query_id")
