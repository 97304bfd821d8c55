"""Continuous ingestion and answering: the operations of a service as streams of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidence_engine import fixed_values as fv
from evidence_engine.operators.answers import answer_queries
from evidence_engine.operators.index import Index
from evidence_engine.operators.retrieval import prepare_queries, search
from evidence_engine.operators.store import ChunkStore


def ingest_stream(
    raw: DataFrame,
    store_path: str,
    checkpoint: str,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    **trigger,
) -> StreamingQuery:
    """Upsert every micro-batch of ``source, text`` rows into a chunk store.

    A replayed batch replaces its own documents, so results are the same after a restart.
    """

    def upsert(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ChunkStore(batch.sparkSession, store_path).ingest(batch, size, overlap)

    writer = raw.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def answer_stream(
    questions: DataFrame,
    current_index: Callable[[], Index],
    output: str,
    checkpoint: str,
    k: int = fv.TOP_K,
    **trigger,
) -> StreamingQuery:
    """Answer every micro-batch of ``query_id, question`` rows against the current index."""

    def answer(batch: DataFrame, number: int) -> None:
        hits = search(current_index(), prepare_queries(batch), ("hybrid",), (k,))
        answer_queries(batch, hits).write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
