"""Documents to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.functions.chunk_windows import chunk_windows
from evidence_engine.sources.scratch import materialize


def identify_documents(raw: DataFrame) -> DataFrame:
    """``source, text[, doc_ord]`` to documents: strip, drop blank ones, add id and order key."""
    order = F.col("doc_ord") if "doc_ord" in raw.columns else tx.path_order(F.col("source"))
    stripped = raw.select("source", tx.strip(F.col("text")).alias("text"), order.alias("doc_ord"))
    return stripped.where(F.col("text") != "").select(
        tx.document_id(F.col("source"), F.col("text")).alias("document_id"), "source", "text", "doc_ord"
    )


def dedupe_documents(documents: DataFrame) -> DataFrame:
    """One row per document, at its last position; the id has 64 bits, so source and text decide.

    Rows of one id have equal content, so a partial aggregate collapses any number of copies
    before the shuffle; the texts travel once per task and id.
    """
    content = F.sha2("text", 256).alias("content")
    unique = documents.groupBy("document_id", "source", content).agg(
        F.any_value("text").alias("text"), F.max("doc_ord").alias("doc_ord")
    )
    return unique.drop("content")


def unique_documents(documents: DataFrame) -> DataFrame:
    """The same for a large table: only the texts of repeated documents are shuffled.

    Ids are counted first (a scan that shuffles 16 characters a row). The few that repeat are written,
    so that Spark knows their size; all other documents then pass through untouched.
    """
    ids = documents.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = materialize(ids.where("n > 1").select("document_id"), "repeated")
    if repeated.isEmpty():
        return documents
    once = documents.join(repeated, "document_id", "left_anti")
    return once.unionByName(dedupe_documents(documents.join(repeated, "document_id", "left_semi")))


def chunk_documents(
    documents: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP
) -> DataFrame:
    """Overlapping windows with preferred cut points; narrow, no shuffle."""
    windows = documents.select(
        "document_id",
        "source",
        "doc_ord",
        F.posexplode(chunk_windows(tx.normalize(F.col("text")), size, overlap)).alias("chunk_index", "window"),
    )
    start, end = F.col("window.start"), F.col("window.end")
    return windows.select(
        tx.chunk_id(F.col("document_id"), F.col("chunk_index"), start, end).alias("chunk_id"),
        "document_id",
        "source",
        F.col("window.text").alias("text"),
        start.alias("start_char"),
        end.alias("end_char"),
        F.struct("chunk_index").alias("metadata"),
        "doc_ord",
    )


def list_documents(chunks: DataFrame) -> DataFrame:
    return (
        chunks.groupBy("document_id", "source")
        .agg(F.count(F.lit(1)).alias("chunk_count"))
        .orderBy("source", "document_id")
    )
