"""Report tables of an evaluation: configuration, dataset, warnings, results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.operators.evaluation import METRICS, case_counts


def category_counts(cases: DataFrame) -> DataFrame:
    return cases.groupBy("category").agg(F.count(F.lit(1)).alias("case_count")).orderBy("category")


def dataset_summary(documents: DataFrame, chunks: DataFrame, cases: DataFrame, relevance: DataFrame) -> DataFrame:
    """One row of counts, each from its own aggregate."""
    counts = case_counts(cases, relevance)
    return counts.select(
        documents.agg(F.count(F.lit(1))).scalar().alias("document_count"),
        chunks.agg(F.count(F.lit(1))).scalar().alias("chunk_count"),
        "case_count",
        F.col("evaluated_case_count").alias("answerable_case_count"),
        F.col("skipped_unanswerable_case_count").alias("unanswerable_case_count"),
    )


def dataset_warnings(summary: DataFrame) -> DataFrame:
    """Warnings about sets too small to mean anything, numbered in their fixed order."""
    rules = [
        F.struct(F.lit(n).alias("warning_no"), F.lit(text).alias("warning"), (F.col(column) < least).alias("applies"))
        for n, (column, least, text) in enumerate(fv.SIZE_WARNINGS, start=1)
    ]
    return summary.select(F.inline(F.array(*rules))).where("applies").drop("applies")


def indistinguishable(metrics: DataFrame) -> DataFrame:
    """One row ``applies``: at least two strategies, with the same rounded metrics at every K."""
    per_k = metrics.groupBy("k").agg(
        F.count_distinct("strategy").alias("strategies"), F.count_distinct(F.struct(*METRICS)).alias("outcomes")
    )
    same = F.bool_and(F.col("outcomes") == 1) & (F.max("strategies") > 1)
    return per_k.agg(F.coalesce(same, F.lit(False)).alias("applies"))


def indistinguishable_warning(metrics: DataFrame) -> DataFrame:
    """The warning in one row, or no row."""
    return indistinguishable(metrics).where("applies").select(
        F.lit(len(fv.SIZE_WARNINGS) + 1).alias("warning_no"), F.lit(fv.INDISTINGUISHABLE_WARNING).alias("warning")
    )


def all_warnings(summary: DataFrame, metrics: DataFrame) -> DataFrame:
    return dataset_warnings(summary).unionByName(indistinguishable_warning(metrics)).orderBy("warning_no")


def configuration_table(
    spark: SparkSession,
    *,
    embedding: str,
    chunk_size: int,
    chunk_overlap: int,
    ks: Sequence[int],
    documents: str,
    questions: str,
) -> DataFrame:
    values = {
        "schema_version": fv.REPORT_SCHEMA_VERSION,
        "embedding": embedding,
        "chunk_size": chunk_size,
        "chunk_overlap": chunk_overlap,
        "top_ks": ",".join(map(str, sorted(set(ks)))),
        "documents": documents,
        "questions": questions,
    }
    return spark.createDataFrame([(k, str(v)) for k, v in values.items()], "setting string, value string")


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """One JSON data set per report table, with the time of writing in each row."""
    for name, table in tables.items():
        stamped = table.withColumn("generated_at", F.current_timestamp())
        stamped.write.mode("overwrite").json(f"{path}/{name}")
