"""A chunk table that documents are added to, replaced in and deleted from, with its index.

Everything is plain Parquet that Spark appends to:

* ``chunks/version=N``   the chunks ingested by change N, with their tokens,
* ``documents/version=N`` the documents they belong to, with their numbers of chunks,
* ``removed/version=N``  ids of documents whose chunks from earlier changes are void since N,
* ``terms/version=N``    by how much change N raises or lowers document frequencies,
* ``sizes/version=N``    the same for the numbers of chunks and tokens,
* ``commits``            one file per finished change, created last.

A change costs what it brings along, not a rewrite of the table or of the index statistics;
readers see only committed versions and may pin one. Every attempt at a change writes its part of all
tables into folders of its own, which its commit names; what failed or lost is never read. Of several writers
that start from one version one creates the next version's commit; the others start over from there,
so what they make void includes what the winner wrote. ``compact`` folds the history.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple, TypeVar

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions.text import is_blank
from evidence_engine.operators.chunking import chunk_documents, identify_documents, unique_documents
from evidence_engine.operators.index import Index, document_frequency, with_tokens
from evidence_engine.sources.exclusive import publish

#: So many voided ids are sent to the chunks; more are joined with them.
BROADCAST_IDS = 250_000
#: How often a change starts over because another writer was first.
TRIES = 10

Result = TypeVar("Result")

_SCHEMAS = {
    "commits": "version bigint, base bigint, change string, attempt string, n_removed bigint",
    "chunks": (
        "chunk_id string, document_id string, source string, text string, start_char int, end_char int, "
        "metadata struct<chunk_index:int>, doc_ord string, tokens array<string>, n_tokens bigint, version bigint"
    ),
    "documents": "document_id string, source string, chunk_count bigint, version bigint",
    "removed": "document_id string, version bigint",
    "terms": "term string, df bigint, version bigint",
    "sizes": "n_chunks bigint, n_tokens bigint, version bigint",
}


class Head(NamedTuple):
    """A version, the compacted one that it builds on, its changes since, and how many ids these made void."""

    version: int
    base: int
    changes: tuple[tuple[int, str], ...] = ()
    n_removed: int = 0


class ChangedMeanwhile(RuntimeError):
    """Another writer has committed the version that this change was to become."""


def new_attempt() -> str:
    return f"a{uuid.uuid4().hex}"


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Reading

    def version(self) -> int:
        """The latest committed version, 0 for an empty store."""
        return self._head().version

    def load(self, version: int | None = None) -> DataFrame:
        """The chunk table; ``doc_ord`` puts later ingested documents behind earlier ones."""
        return self._live("chunks", self._head(version)).drop("version", "tokens", "n_tokens")

    def list_documents(self, version: int | None = None) -> DataFrame:
        """``document_id, source, chunk_count`` by source, without a look at the chunks."""
        live = self._live("documents", self._head(version)).drop("version")
        return live.orderBy("source", "document_id")

    def index(self, version: int | None = None) -> Index:
        """The chunks with their tokens; their statistics are the changes' and add up."""
        head = self._head(version)
        doc_freq = self._history("terms", head).select("term", "df")
        sizes = self._sizes(head)
        average = F.when(F.col("n_chunks") > 0, F.col("n_tokens").cast("double") / F.col("n_chunks")).otherwise(0.0)
        return Index(self._live("chunks", head).drop("version"), doc_freq, sizes.select("n_chunks", average.alias("avg_len")))

    def _head(self, version: int | None = None) -> Head:
        try:
            commits = self.spark.read.schema(_SCHEMAS["commits"]).json(f"{self.path}/commits")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return Head(0, 0)
        if version is not None:
            commits = commits.where(F.col("version") <= version)
        last = commits.agg(F.max(F.struct("version", "base")).alias("last")).first()["last"]
        if last is None:
            return Head(0, 0)
        # One short row a change, which compaction starts anew.
        rows = commits.where(F.col("version").between(last["base"], last["version"])).orderBy("version").collect()
        changes = tuple((row["version"], row["attempt"]) for row in rows)
        return Head(last["version"], last["base"], changes, sum(row["n_removed"] for row in rows))

    def _folder(self, table: str, version: int, attempt: str) -> str:
        return f"{self.path}/{table}/version={version}/attempt={attempt}"

    def _history(self, table: str, head: Head) -> DataFrame:
        """Rows of the changes from the base to the head: their folders, and no others, are read."""
        if not head.changes:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        reader = self.spark.read.schema(_SCHEMAS[table]).option("basePath", f"{self.path}/{table}")
        return reader.parquet(*(self._folder(table, *change) for change in head.changes)).drop("attempt")

    def _live(self, table: str, head: Head) -> DataFrame:
        """Rows of chunks or documents that no later change has made void; shuffled only where very many ids are."""
        rows = self._history(table, head)
        if not head.n_removed:
            return rows
        since = self._history("removed", head).withColumnRenamed("version", "void_before")
        if head.n_removed <= BROADCAST_IDS:
            since = F.broadcast(since)
        else:
            since = since.groupBy("document_id").agg(F.max("void_before").alias("void_before"))
        void = (rows["document_id"] == since["document_id"]) & (rows["version"] < since["void_before"])
        return rows.join(since, void, "left_anti")

    def _chunks_of(self, documents: DataFrame, head: Head) -> DataFrame:
        """Live chunks of some documents."""
        return self._live("chunks", head).join(documents, "document_id", "left_semi")

    def _sizes(self, head: Head) -> DataFrame:
        sums = [F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_chunks", "n_tokens")]
        return self._history("sizes", head).agg(*sums)

    # Changing

    def _started_over(self, change: Callable[[Head], Result]) -> Result:
        """Apply a change to the head, and to the next one if another writer was faster."""
        for left in reversed(range(TRIES)):
            try:
                return change(self._head())
            except ChangedMeanwhile:
                if not left:
                    raise

    def _write(self, rows: DataFrame | None, table: str, version: int, attempt: str) -> DataFrame:
        schema = self._history(table, Head(0, 0)).drop("version").schema
        path = self._folder(table, version, attempt)
        rows = self.spark.createDataFrame([], schema).coalesce(1) if rows is None else rows.select(*schema.names)
        rows.write.parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def _commit(self, version: int, base: int, change: str, attempt: str, n_removed: int = 0) -> None:
        row = {"version": version, "base": base, "change": change, "attempt": attempt, "n_removed": n_removed}
        if not publish(self.spark, f"{self.path}/commits", f"{version:019}.json", json.dumps(row) + "\n"):
            raise ChangedMeanwhile(f"version {version} of {self.path} was committed by another writer")

    def _change(self, head: Head, change: str, chunks: DataFrame | None, ids: DataFrame | None = None) -> bool:
        """Write new chunks, void what is held of their documents (or of ``ids``), and commit.

        Without new chunks and with nothing to void, nothing is committed: False.
        """
        to = head.version + 1, new_attempt()
        added = self._write(chunks, "chunks", *to)
        counts = added.groupBy("document_id", "source").agg(F.count(F.lit(1)).alias("chunk_count"))
        documents = self._write(counts, "documents", *to)
        touched = (documents if ids is None else ids).select("document_id")
        held = self._live("documents", head).join(touched, "document_id", "left_semi")
        removed = self._write(held.select("document_id").distinct(), "removed", *to)
        n_removed = removed.count()
        voided = self._chunks_of(removed, head) if n_removed else None
        if chunks is None and voided is None:
            return False
        parts = [(rows, sign) for rows, sign in ((added, 1), (voided, -1)) if rows is not None]
        terms = [document_frequency(rows).withColumn("df", F.col("df") * sign) for rows, sign in parts]
        total = reduce(DataFrame.unionByName, terms).groupBy("term").agg(F.sum("df").alias("df"))
        self._write(total.where("df <> 0"), "terms", *to)
        sizes = [rows.select((F.col("n_tokens") * sign).alias("n_tokens"), F.lit(sign).alias("n")) for rows, sign in parts]
        total = reduce(DataFrame.unionByName, sizes).agg(F.sum("n").alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
        self._write(total.na.fill(0), "sizes", *to)
        self._commit(to[0], head.base, change, to[1], n_removed)
        return True

    def replace_documents(self, chunks: DataFrame) -> int:
        """Put in the chunks of whole documents; what the store holds of these documents is void.

        Replaced documents move to the end. Returns the new version.
        """

        def change(head: Head) -> int:
            number = F.lpad(F.lit(head.version + 1).cast("string"), 19, "0")
            later = F.concat(number, F.lit("\0"), F.col("doc_ord"))
            self._change(head, "replace", with_tokens(chunks.withColumn("doc_ord", later)))
            return head.version + 1

        return self._started_over(change)

    def ingest(
        self, raw: DataFrame, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, strict: bool = False
    ) -> DataFrame:
        """Raw ``source, text`` rows to stored chunks; returns ``document_id, source, chunk_count``.

        Equal documents count once and a repeated ingest replaces itself, so a retry is harmless.
        Blank documents are an error in strict mode and left out otherwise.
        """
        if strict and not raw.where(is_blank(F.col("text"))).isEmpty():
            raise ValueError("a document is blank")
        documents = unique_documents(identify_documents(raw))
        version = self.replace_documents(chunk_documents(documents, size, overlap))
        return self._history("documents", self._head(version)).where(F.col("version") == version).drop("version")

    def delete_documents(self, ids: DataFrame) -> bool:
        """Remove documents; False, and nothing committed, if the store holds none of them."""
        return self._started_over(lambda head: self._change(head, "delete", None, ids))

    def compact(self) -> int:
        """Write the live chunks and their statistics as a new base; reads skip what lies before."""
        return self._started_over(self._compacted)

    def _compacted(self, head: Head) -> int:
        version, attempt = head.version + 1, new_attempt()
        parts = {
            "chunks": self._live("chunks", head),
            "documents": self._live("documents", head),
            "removed": None,
            "terms": self._history("terms", head).groupBy("term").agg(F.sum("df").alias("df")).where("df <> 0"),
            "sizes": self._sizes(head),
        }
        for table, rows in parts.items():
            self._write(rows, table, version, attempt)
        self._commit(version, version, "compact", attempt)
        return version
