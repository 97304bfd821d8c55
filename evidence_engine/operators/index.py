"""Index tables over a chunk table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions.text import term_counts, tokenize
from evidence_engine.operators import kernels, postings as inverted
from evidence_engine.operators.vectors import with_hashed_tokens
from evidence_engine.sources.scratch import materialize


@dataclass(frozen=True)
class Index:
    """``chunks`` carry their tokens and their number, or only their texts; the other tables are the corpus statistics.

    A term may have several rows in ``doc_freq``, which add up: the changes of a store. A written index has
    ``postings``, which BM25 reads in place of the chunks' tokens, and its chunks have ``hashed`` vectors of the
    kind (dimension, hash family) that ``hashed`` names.
    """

    chunks: DataFrame
    doc_freq: DataFrame
    stats: DataFrame
    postings: inverted.Postings | None = None
    hashed: tuple[int, str] | None = None


def with_tokens(chunks: DataFrame) -> DataFrame:
    """Add ``tokens`` and ``n_tokens``; statistics of lengths then read one narrow column."""
    tokens = chunks.withColumn("tokens", tokenize(F.col("text")))
    return tokens.withColumn("n_tokens", F.array_size("tokens").cast("bigint"))


def term_frequency(token_chunks: DataFrame) -> DataFrame:
    """Postings ``chunk_id, term, tf``: counted inside each row, so nothing is shuffled."""
    return token_chunks.select("chunk_id", F.inline(term_counts(F.col("tokens"))))


def document_frequency(token_chunks: DataFrame) -> DataFrame:
    """Number of chunks per term; partial sums absorb frequent terms before the shuffle."""
    return (
        token_chunks.select(F.explode(F.array_distinct("tokens")).alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def chunk_length(token_chunks: DataFrame) -> DataFrame:
    return token_chunks.select("chunk_id", "n_tokens")


def corpus_stats(token_chunks: DataFrame) -> DataFrame:
    """One row; chunks without tokens count in both numbers."""
    total = F.sum("n_tokens")
    count = F.count(F.lit(1))
    return token_chunks.agg(
        count.alias("n_chunks"),
        F.when(count > 0, total.cast("double") / count).otherwise(0.0).alias("avg_len"),
    )


def weigh(query_terms: DataFrame, index: Index) -> DataFrame:
    """``query_id, term, tf`` with each term's ``df``; terms that no chunk has are dropped.

    The few query terms meet the vocabulary before it is summed up, so most of it is never shuffled.
    """
    rows = query_terms.join(index.doc_freq, "term")
    return rows.groupBy("query_id", "term", "tf").agg(F.sum("df").alias("df")).where("df > 0")


def build_index(chunks: DataFrame) -> Index:
    tokens = with_tokens(chunks)
    return Index(tokens, document_frequency(tokens), corpus_stats(tokens))


def scanned_index(chunks: DataFrame) -> Index:
    """An index of which only the statistics are written, all from one pass: searches cut and tokenize the chunks again.
    For a corpus that is searched once that is less work, and takes no room in proportion to the texts."""
    counted = chunks.select("text").mapInArrow(kernels.tidy(kernels.count_terms), "term string, df long, n_tokens long")
    sums = counted.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n_tokens").alias("n_tokens"))
    rows = materialize(sums, "statistics")
    corpus = rows.where("term is null").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("df", "n_tokens")))
    average = F.when(F.col("df") > 0, F.col("n_tokens").cast("double") / F.col("df")).otherwise(0.0)
    stats = corpus.select(F.col("df").alias("n_chunks"), average.alias("avg_len"))
    return Index(chunks, rows.where("term is not null").select("term", "df"), stats)


def write_index(
    chunks: DataFrame, path: str, dimension: int = fv.HASH_DIMENSION, family: str = "blake2b"
) -> Index:
    """Chunk, tokenize and hash once, in one pass over the texts' bytes, then derive postings and statistics from the written table."""
    spark = chunks.sparkSession
    tokens = with_hashed_tokens(chunks, dimension, family).withColumn("place", F.monotonically_increasing_id())
    tokens.write.mode("overwrite").parquet(f"{path}/chunks")
    tokens = spark.read.parquet(f"{path}/chunks")
    postings = inverted.write_postings(tokens, f"{path}/postings")
    postings.doc_freq().write.mode("overwrite").parquet(f"{path}/doc_freq")
    stats = corpus_stats(tokens).withColumns({"dimension": F.lit(dimension), "family": F.lit(family)})
    stats.write.mode("overwrite").parquet(f"{path}/stats")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    chunks, doc_freq, stats = (spark.read.parquet(f"{path}/{table}") for table in ("chunks", "doc_freq", "stats"))
    kind = stats.select("dimension", "family").first()
    postings = inverted.read_postings(spark, f"{path}/postings")
    return Index(chunks, doc_freq, stats.select("n_chunks", "avg_len"), postings, (kind["dimension"], kind["family"]))
