"""BM25 scores of given query-chunk pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions.text import term_counts
from evidence_engine.operators.index import Index, weigh


def idf(n_chunks: Column, df: Column) -> Column:
    return F.log(1 + (n_chunks - df + 0.5) / (df + 0.5))


def bm25_score(
    index: Index, queries: DataFrame, pairs: DataFrame, k1: float = fv.BM25_K1, b: float = fv.BM25_B
) -> DataFrame:
    """``query_id, chunk_id, score`` for the pairs asked for; 0 where no term is shared.

    Joins run on the pairs' keys and on (chunk, term), so no pair beyond the given ones arises.
    Repeated query terms count repeatedly.
    """
    asked = pairs.select("query_id", "chunk_id").distinct()
    query_terms = queries.select("query_id", F.inline(term_counts(F.col("tokens"))))
    weighted = weigh(query_terms, index).withColumnRenamed("tf", "qtf")
    wanted = index.chunks.join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi")
    postings = wanted.select("chunk_id", "n_tokens", F.inline(term_counts(F.col("tokens"))))
    stats = index.stats
    n_chunks = stats.select("n_chunks").scalar()
    average = stats.select(F.coalesce(F.nullif("avg_len", F.lit(0.0)), F.lit(1.0))).scalar()
    matches = asked.join(weighted, "query_id").join(postings, ["chunk_id", "term"])
    damping = k1 * (1 - b + b * F.col("n_tokens") / average)
    gain = idf(n_chunks, F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + damping)
    scores = matches.groupBy("query_id", "chunk_id").agg(F.sum(gain * F.col("qtf")).alias("score"))
    return asked.join(scores, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", F.coalesce("score", F.lit(0.0)).alias("score")
    )
