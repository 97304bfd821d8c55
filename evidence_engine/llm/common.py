"""What the training-data operators share: session settings, written tables, keys and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from evidence_engine.sources.scratch import bound_batches, materialize, scratch_path

__all__ = [
    *("Scratch", "bounded", "documents", "keyed", "map_arrow", "materialize"),
    *("named_rows", "rows_without", "scratch_path", "table", "texts"),
]

#: Fixed: white space between words.
BLANKS = "[ \\t-\\r]+"


def bounded(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and let Spark drop a step's shuffle files when the step is written."""
    bound_batches(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, h, text``: rows with one id and one text are one document, whatever other columns hold.

    ``h`` tells apart documents whose ids repeat or are missing; a missing text counts as empty.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def with_info(docs: DataFrame, info: DataFrame, how: str = "left") -> DataFrame:
    """Join ``info``, with one row for each ``doc_id, h`` at most, to keyed documents."""
    joined = docs.join(info, same_document(docs, info), how)
    return joined.drop(info["doc_id"]).drop(info["h"])


def named_rows(docs: DataFrame) -> DataFrame:
    """All columns as one, ``row``, with ``id`` and ``h`` as in :func:`keyed`: whatever the columns are called, none clashes."""
    key = F.col("row.doc_id").cast("long").alias("id"), text_hash(F.col("row.text")).alias("h")
    return docs.select(F.struct("*").alias("row")).select("row", *key)


def rows_without(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``named`` (``doc_id, h``) does not name."""
    rows = named_rows(docs)
    gone = named.select(F.col("doc_id").alias("gone_id"), F.col("h").alias("gone_h")).distinct()
    same = rows["id"].eqNullSafe(gone["gone_id"]) & (rows["h"] == gone["gone_h"])
    return rows.join(gone, same, "left_anti").select("row.*")


def texts(column: pa.Array) -> list[bytes]:
    """A string column's values as UTF-8 bytes."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def give_back() -> None:
    """Return what a Python worker has freed to the system: it outlives its tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """``mapInArrow`` by tasks that leave no freed memory in their workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


class Scratch:
    """Written intermediate tables of one operator, deleted together when later ones replace them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        self.paths = []
