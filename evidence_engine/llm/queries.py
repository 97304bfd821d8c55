"""The training-data operators as queries over the given tables, and their checks in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evidence_engine.llm import (
    alignment,
    decontamination,
    language_model,
    line_chunks,
    lsh_forest,
    neighbours,
    packing,
    quality,
    secrets,
    spelling,
    suffix_dedup,
    url_filters,
    warc,
)
from evidence_engine.llm.common import documents, table
from evidence_engine.llm.oracles import ORACLES


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the address of every page."""
    return url_filters.judge(table(spark, sf_dir, "pages"), url_filters.rules_table(spark))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of strings of 200 bytes that repeat, removed from all documents."""
    removed = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents: three-word shingles, similarity 0.85."""
    found = lsh_forest.near_duplicates(documents(spark, sf_dir), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back through the index."""
    return warc.archive_and_read(table(spark, sf_dir, "pages")).drop("url")


def op5_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines, removed from all documents."""
    removed = line_chunks.remove_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"))
    return removed.select(
        "doc_id",
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.size("__chunks").cast("long").alias("n_chunks"),
        F.array_join(F.transform("__chunks", lambda c: F.concat_ws("+", c["line"], c["lines"])), ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def tokenizer_file() -> str:
    """The public word tokenizer; its place is a parameter of the installation."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 4,096 tokens."""
    return packing.pack(documents(spark, sf_dir), tokenizer_file())


def op7_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and log-bilinear scores of all documents."""
    return language_model.score(documents(spark, sf_dir))


def op8_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict for all documents."""
    return quality.rate(documents(spark, sf_dir), table(spark, sf_dir, "labels")).drop("h")


def op9_secret_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    found = secrets.find_secrets(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select(
        "doc_id",
        *(count(kind) for kind in ("assign", "access", "hex")),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in all documents."""
    return decontamination.find_overlaps(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("h")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers over all documents, aligned."""
    import public_tokenizers

    files = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align_tokens(documents(spark, sf_dir), *files)[0]


def op12_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every twentieth one."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling.spelling_variants(documents(spark, sf_dir))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_lsh_forest": op3_lsh_forest,
    "op4_capture_index": op4_capture_index,
    "op5_line_chunks": op5_line_chunks,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_log_bilinear": op7_log_bilinear,
    "op8_quality_ratio": op8_quality_ratio,
    "op9_secret_models": op9_secret_models,
    "op10_spaced_seeds": op10_spaced_seeds,
    "op11_token_alignment": op11_token_alignment,
    "op12_cross_polytope": op12_cross_polytope,
    "op13_spelling_variants": op13_spelling_variants,
}
