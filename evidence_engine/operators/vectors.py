"""Vectors of chunks: hashed token counts, and cosine of vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.operators import kernels


def hash_embed(
    token_chunks: DataFrame, dimension: int = fv.HASH_DIMENSION, family: str = "blake2b", key: str = "chunk_id"
) -> DataFrame:
    """Sparse hashed vectors ``chunk_id, bucket, count, value``; no shuffle.

    ``count`` is the signed number of tokens in the bucket, ``value`` the count divided by the
    vector's length. Empty buckets have no row.
    """

    @kernels.tidy
    def embed(batches):
        hasher = kernels.TermHasher(dimension, family)
        step = max(1, kernels.BLOCK_CELLS // dimension)
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                matrix = hasher.matrix(part.column(1))
                lengths = kernels.norms(matrix)
                row, bucket = np.nonzero(matrix)
                count = matrix[row, bucket]
                columns = [
                    part.column(0).take(pa.array(row)),
                    pa.array(bucket, pa.int32()),
                    pa.array(count.astype(np.int64)),
                    pa.array(count / lengths[row]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "bucket", "count", "value"])

    id_type = token_chunks.schema[key].dataType.simpleString()
    return token_chunks.select(key, "tokens").mapInArrow(
        embed, f"{key} {id_type}, bucket int, count bigint, value double"
    )


HASHED = "struct<bucket: array<int>, count: array<int>, norm: double>"


def with_hashed(token_chunks: DataFrame, dimension: int = fv.HASH_DIMENSION, family: str = "blake2b") -> DataFrame:
    """Add ``hashed``: the buckets of a chunk's tokens that are not empty, their signed counts, and the length of the vector."""

    @F.arrow_udf(HASHED)
    def embed(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = kernels.TermHasher(dimension, family)
        step = max(1, kernels.BLOCK_CELLS // dimension)
        for tokens in lists:
            parts = [kernels.sparse(hasher.matrix(tokens.slice(start, step))) for start in range(0, len(tokens), step)]
            yield pa.concat_arrays(parts or [kernels.sparse(np.zeros((0, dimension)))])
        kernels.give_back()

    return token_chunks.withColumn("hashed", embed("tokens"))


def with_hashed_tokens(chunks: DataFrame, dimension: int = fv.HASH_DIMENSION, family: str = "blake2b") -> DataFrame:
    """Add ``tokens``, ``n_tokens`` and ``hashed`` to chunks in one pass over the bytes of their texts."""

    @F.arrow_udf(f"struct<tokens: array<string>, hashed: {HASHED}>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hasher = kernels.TermHasher(dimension, family)
        step = max(1, kernels.BLOCK_CELLS // dimension)
        for texts in batches:
            tokens = kernels.split_tokens(texts)
            parts = [kernels.sparse(hasher.matrix(tokens.slice(start, step))) for start in range(0, len(tokens), step)]
            hashed = pa.concat_arrays(parts or [kernels.sparse(np.zeros((0, dimension)))])
            yield pa.StructArray.from_arrays([tokens, hashed], names=["tokens", "hashed"])
        kernels.give_back()

    rest = [F.col(c) for c in chunks.columns if c not in ("tokens", "n_tokens", "hashed")]
    read = chunks.select(*rest, embed("text").alias("__read"))
    n_tokens = F.array_size("__read.tokens").cast("bigint")
    return read.select(*rest, "__read.tokens", n_tokens.alias("n_tokens"), "__read.hashed")


def dot(left: Column, right: Column) -> Column:
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(left: Column, right: Column) -> Column:
    """Cosine of two array columns; a zero norm counts as one, other dimensions are an error."""

    def norm(vector: Column) -> Column:
        return F.coalesce(F.nullif(F.sqrt(dot(vector, vector)), F.lit(0.0)), F.lit(1.0))

    complaint = F.raise_error(F.lit("vector dimensions differ")).cast("double")
    return F.when(F.array_size(left) != F.array_size(right), complaint).otherwise(dot(left, right) / (norm(left) * norm(right)))
