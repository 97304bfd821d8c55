"""Nearest neighbours by largest inner product with cross-polytope hashing.

Equal vectors are one class with its smallest ids, so a frequent vector is one row. Classes are put on
the unit sphere by one more coordinate that fills up their lengths, which keeps the order of inner
products. Pseudo-random rotations (signs and a fast Hadamard transform, three times) take a unit
vector to the nearest of the signed axes; several such answers, the last over fewer axes, name a cell. The
number of cells follows the number of classes, so a cell holds about as many at every size. Several
tables differ in their rotations.

A query visits in each table the cells with the least loss. How many is fitted: the true neighbours of a
bounded sample of queries, found by one scan of all classes, must lie in visited cells often enough.
Neighbouring cells form a region. Visits and entries meet by table and region, in blocks of bounded size: a
query is sent once with a list of cells to each region that it visits, a task holds one block and passes queries over it. Scores are exact, in double precision and in one order of additions, and every query
brings along a lower bound of its last score from a bounded sample, so most of what is visited ends in the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from evidence_engine.llm.common import map_arrow, materialize

TABLES = 4
#: Classes that a cell holds on average, at most.
PER_CELL = 128
#: Cells in a region, and rows of a region that a task holds at once.
REGION = 32
BLOCK = 16_384
#: Queries that the number of visits is fitted on, and the share of their true neighbours to be found.
FITTED, RECALL = 256, 0.96
#: Classes that the lower bounds come from.
BOUNDING = 4096
#: Rows that a task holds before it thins them out to each query's best; it passes on what is more than half of it then.
HELD = 1 << 20
#: Room for the rounding of matrix products, relative to the lengths.
SLACK = 1e-12


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows times the normalised Hadamard matrix; the number of columns is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        x = x.reshape(len(x), -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / math.sqrt(n)


class Hashing:
    """Cells of unit vectors: ``bits`` split into signed axes of rotations, in each of ``tables``."""

    def __init__(self, dimension: int, longest: float, extra: bool, n: int, tables: int = TABLES, per_cell: int = PER_CELL):
        self.dimension, self.longest, self.extra, self.tables = dimension, longest, extra, tables
        self.width = 1 << max(1, math.ceil(math.log2(max(dimension + extra, 1))))
        bits = max(1, math.ceil(math.log2(max(n / per_cell, 2))))
        whole = self.width.bit_length()  # 2 x width signed axes
        self.axes = [self.width] * (bits // whole) + ([1 << (bits % whole - 1)] if bits % whole else [])
        self.cells = math.prod(2 * a for a in self.axes)

    def unit(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(vectors), self.width))
        if query:
            out[:, : self.dimension] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            return out
        out[:, : self.dimension] = vectors / self.longest
        if self.extra:
            out[:, self.dimension] = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", out, out)))
        return out

    def rotated(self, unit: np.ndarray, table: int) -> Iterator[np.ndarray]:
        """For each of the cell's parts the products with its signed axes."""
        random = np.random.default_rng([table, 20_011])
        for axes in self.axes:
            x = unit
            for _ in range(3):
                x = hadamard(x * random.choice([-1.0, 1.0], self.width))
            yield np.concatenate([x[:, :axes], -x[:, :axes]], axis=1)

    def cell(self, unit: np.ndarray, table: int) -> np.ndarray:
        cell = np.zeros(len(unit), np.int64)
        for products in self.rotated(unit, table):
            cell = cell * products.shape[1] + products.argmax(axis=1)
        return cell

    def visits(self, unit: np.ndarray, table: int, n: int) -> np.ndarray:
        """Each row's ``n`` cells of least loss, the best first. Losses add up, so the best beginnings suffice."""
        cells, losses = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for products in self.rotated(unit, table):
            loss = (products.max(axis=1, keepdims=True) - products) ** 2
            losses = (losses[:, :, None] + loss[:, None, :]).reshape(len(unit), -1)
            cells = (cells[:, :, None] * products.shape[1] + np.arange(products.shape[1])).reshape(len(unit), -1)
            order = np.argsort(losses, axis=1, kind="stable")[:, :n]
            losses, cells = np.take_along_axis(losses, order, 1), np.take_along_axis(cells, order, 1)
        return cells


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dimension)


def stacked(column: pa.ChunkedArray, dimension: int) -> np.ndarray:
    return np.concatenate([np.zeros((0, dimension)), *(matrix(part, dimension) for part in column.chunks)])


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products row by row; a pair's sum does not depend on what other rows there are."""
    return (np.ascontiguousarray(left) * np.ascontiguousarray(right)).sum(axis=1)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, vector, class``: rows with an id and a finite vector other than zero, equal rows once.

    Vectors whose length is not the most frequent one (the greater of two) take no part. Classes are digests of
    all components, a negative zero counting as zero.
    """
    single = dict(vectors.dtypes)[vector_column] == "array<float>"
    kind = "float" if single else "double"
    numbers = F.transform(vector_column, lambda x: x.cast(kind) + F.lit(0.0).cast(kind))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), numbers.alias("vector"))

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    good = F.col("vec_id").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0.0)
    rows = rows.where(good)
    lengths = rows.groupBy(F.array_size("vector").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    length = lengths.orderBy(F.desc("n"), F.desc("k")).first()
    rows = rows.where(F.array_size("vector") == (length["k"] if length else 0))
    digest = F.unhex(F.sha2(F.col("vector").cast("string"), 256))
    return rows.withColumn("class", digest).dropDuplicates(["vec_id", "class"])


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """``class, vector, ids``: the ``k + 1`` smallest ids of each, all that any query can need."""
    place = F.row_number().over(W.partitionBy("class").orderBy("vec_id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    return first.groupBy("class").agg(
        F.any_value("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids")
    )


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; the least where there are fewer."""
    k = min(k, scores.shape[1])
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _true_neighbours(sample: np.ndarray, k: int, dimension: int):
    """Task: each sampled query's best classes in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(0), dimension)
            if not len(vectors):
                continue
            scores = sample @ vectors.T
            query, row = np.nonzero(scores >= _best(scores, k)[:, None])
            taken = batch.column(0).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(scores[query, row]), taken], names=["q", "score", "vector"])

    return run


def fit_visits(hashing: Hashing, classes: DataFrame, sample: np.ndarray, k: int, recall: float) -> tuple[int, float]:
    """The number of cells to visit, and the share of the sample's true neighbours found with it."""
    found = map_arrow(
        classes.select("vector"),
        _true_neighbours(sample, k, hashing.dimension),
        f"q long, score double, vector {dict(classes.dtypes)['vector']}",
    )
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score")))
    true = found.withColumn("place", place).where(F.col("place") <= k).select("q", "vector").toArrow().combine_chunks()
    query = true["q"].to_numpy()
    near = hashing.unit(stacked(true["vector"], hashing.dimension), False)
    asked = hashing.unit(sample, True)
    n = 8
    while True:
        n = min(n, hashing.cells)
        first = np.full(len(query), n + 1)
        for table in range(hashing.tables):
            same = hashing.visits(asked, table, n)[query] == hashing.cell(near, table)[:, None]
            first = np.minimum(first, np.where(same.any(axis=1), same.argmax(axis=1) + 1, n + 1))
        reached = np.searchsorted(np.sort(first), np.arange(1, n + 1), side="right") / max(len(first), 1)
        enough = np.flatnonzero(reached >= recall)
        if len(enough) or n == hashing.cells:
            at = int(enough[0]) if len(enough) else n - 1
            return at + 1, float(reached[at])
        n *= 2


def _entries(hashing: Hashing):
    """Task: a row for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = hashing.unit(matrix(batch.column(1), hashing.dimension), False)
            for table in range(hashing.tables):
                cell = hashing.cell(unit, table)
                columns = [pa.array(np.full(len(batch), table, np.int32)), pa.array(cell // REGION), pa.array(cell), *batch.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["tab", "region", "cell", "class", "vector", "ids"])

    return run


def _visits(hashing: Hashing, n: int, bounding: np.ndarray, k: int):
    """Task: a row for each query, table and visited region, with its cells and a lower bound of the query's last score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                vectors = matrix(part.column(1), hashing.dimension)
                scores = vectors @ bounding.T
                slack = SLACK * hashing.longest * np.linalg.norm(vectors, axis=1)
                # Of k + 1 classes each has an id that is not the query's own, but for the query's class.
                least = _best(scores, k + 1) - slack if len(bounding) > k else np.full(len(part), -np.inf)
                unit = hashing.unit(vectors, True)
                for table in range(hashing.tables):
                    cells = hashing.visits(unit, table, n)
                    cells.sort(axis=1)
                    flat = cells.ravel()
                    region, row = flat // REGION, np.repeat(np.arange(len(part)), cells.shape[1])
                    first = np.flatnonzero((np.diff(region, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
                    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(flat)), pa.int32()), pa.array(flat))
                    at = pa.array(row[first])
                    columns = [pa.array(np.full(len(first), table, np.int32)), pa.array(region[first]), lists]
                    columns += [part.column(0).take(at), part.column(1).take(at), pa.array(least[row[first]])]
                    yield pa.RecordBatch.from_arrays(columns, names=["tab", "region", "cells", "class", "vector", "least"])

    return run


def _scored(dimension: int, k: int, longest: float):
    """Task: rows sorted by region and block, entries before queries and by cell; each query's best entries of all the task's blocks.

    Columns: tab, region, block, role, cell, class, vector, ids, cells, least.
    """

    def block_of(held: list[pa.RecordBatch]) -> tuple:
        cell = np.concatenate([b.column(4).to_numpy() for b in held])
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        bounds = dict(zip(cell[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(cell)])))
        ids = pa.concat_arrays([b.column(7) for b in held])
        return np.concatenate([matrix(b.column(6), dimension) for b in held]), ids, bounds

    def best(rows: pa.RecordBatch, block: tuple) -> Iterator[pa.RecordBatch]:
        vectors, ids, bounds = block
        starts, values = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
        for start in range(0, len(rows), 512):
            part = rows.slice(start, 512)
            asked, least = matrix(part.column(6), dimension), part.column(9).to_numpy()
            slack = SLACK * longest * np.linalg.norm(asked, axis=1)
            lists = part.column(8)
            cells, asking = lists.flatten().to_numpy(), np.repeat(np.arange(len(part)), lists.value_lengths().to_numpy())
            order = np.argsort(cells, kind="stable")
            cells, asking = cells[order], asking[order]
            edges = np.flatnonzero(np.diff(cells, prepend=-1))
            queries, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in zip(edges, [*edges[1:], len(cells)]):
                if int(cells[a]) not in bounds:
                    continue
                low, high = bounds[int(cells[a])]
                who = asking[a:b]
                scores = asked[who] @ vectors[low:high].T
                reach = np.maximum(least[who], _best(scores, k + 1) - 2 * slack[who])
                i, j = np.nonzero(scores >= reach[:, None])
                queries.append(who[i])
                found.append(low + j)
            query, row = np.concatenate(queries), np.concatenate(found)
            score = exact(asked[query], vectors[row])
            many = starts[row + 1] - starts[row]
            at = np.repeat(starts[row], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            query, score, vec_id = np.repeat(query, many), np.repeat(score, many), values[at]
            order = np.lexsort((vec_id, -score, query))
            query, score, vec_id = query[order], score[order], vec_id[order]
            kept = np.arange(len(query)) - np.searchsorted(query, query) <= k
            columns = [part.column(5).take(pa.array(query[kept])), pa.array(vec_id[kept]), pa.array(score[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "vec_id", "score"])

    def thinned(found: list[pa.RecordBatch]) -> pa.Table:
        """Each query's best, every entry once: a pair's score is the same wherever it was found."""
        rows = pa.Table.from_batches(found).combine_chunks()
        query = rows["class"].combine_chunks().dictionary_encode().indices.to_numpy()
        score, vec_id = rows["score"].to_numpy(), rows["vec_id"].to_numpy()
        order = np.lexsort((vec_id, -score, query))
        query, vec_id = query[order], vec_id[order]
        new = np.flatnonzero((np.diff(query, prepend=-1) != 0) | (np.diff(vec_id, prepend=vec_id[0]) != 0))
        order, query = order[new], query[new]
        return rows.take(pa.array(order[np.arange(len(query)) - np.searchsorted(query, query) <= k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in hits(batches):
            found.append(part)
            size += len(part)
            if size > HELD:
                rows = thinned(found)
                found, size = rows.to_batches(), len(rows)
                if size > HELD // 2:
                    yield from found
                    found, size = [], 0
        if size:
            yield from thinned(found).to_batches(max_chunksize=10_000)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(4)], axis=1)
            edges = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
            for start, stop in zip([0, *edges], [*edges, len(batch)]):
                if start == stop:
                    continue
                part, here = batch.slice(start, stop - start), tuple(keys[start, :3])
                if here != key:
                    key, held, block = here, [], None
                if keys[start, 3] == 0:
                    held.append(part)
                elif held:
                    block = block or block_of(held)
                    yield from best(part, block)

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    tables: int = TABLES,
    recall: float = RECALL,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id that ``is_query`` (of ``vec_id``) picks, the ``k`` other ids
    with the largest inner products, the largest first, equal ones by id.

    Rows without an id, or with a missing, zero or not finite vector, take no part; equal rows count once; an id
    with several vectors asks for each of them together, and is never its own neighbour. Extra columns are not looked at. Nearly all
    neighbours are found (``recall``, on a sample); the scores of those found are exact. Where only few are visited, a
    query may get fewer than ``k``, as it does where there are fewer. An empty table gives an empty one.
    """
    rows = materialize(usable(vectors, id_column, vector_column), "rows")
    asking = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "class")
    classes = materialize(classes_of(rows, k), "classes")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x))
    n, longest, shortest, dimension = classes.agg(
        F.count(F.lit(1)), F.max(length), F.min(length), F.max(F.array_size("vector"))
    ).first()
    asked = classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "vector")
    asked = materialize(asked, "asked")

    def sampled(table: DataFrame, size: int) -> np.ndarray:
        """Those with the smallest digests."""
        return stacked(table.orderBy("class").limit(size).select("vector").toArrow()["vector"], dimension or 0)

    fitted = sampled(asked, FITTED)
    if not len(fitted):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    hashing = Hashing(dimension, longest, bool(shortest < 0.999 * longest), n, tables)
    visits, _ = fit_visits(hashing, classes, fitted, k + 1, recall)

    vector = f"class binary, vector {dict(classes.dtypes)['vector']}"
    entries = map_arrow(
        classes.select("class", "vector", "ids"), _entries(hashing), f"tab int, region long, cell long, {vector}, ids array<long>"
    )
    places = entries.groupBy("tab", "region").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    blocks = materialize(places.select("tab", "region", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "blocks")
    asks = map_arrow(
        asked, _visits(hashing, visits, sampled(classes, BOUNDING), k), f"tab int, region long, cells array<long>, {vector}, least double"
    )
    several = F.coalesce("blocks", F.lit(1))
    dealt = entries.join(blocks, ["tab", "region"], "left").withColumn("block", F.pmod(F.xxhash64("class"), several).cast("int"))
    asks = asks.join(blocks, ["tab", "region"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), several - 1)))
    columns = ["tab", "region", "block", "role", "cell", "class", "vector", "ids", "cells", "least"]
    none = {"ids": "array<long>", "cells": "array<long>", "least": "double"}
    dealt = dealt.withColumns({"role": F.lit(0), **{c: F.lit(None).cast(none[c]) for c in ("cells", "least")}})
    asks = asks.withColumns({"role": F.lit(1), "cell": F.lit(0).cast("long"), "ids": F.lit(None).cast(none["ids"])})
    both = dealt.select(*columns).unionAll(asks.select(*columns))
    met = both.repartition("tab", "region", "block").sortWithinPartitions("tab", "region", "block", "role", "cell", "class")
    found = map_arrow(met, _scored(dimension, k, longest), "class binary, vec_id long, score double")
    once = found.groupBy("class", "vec_id").agg(F.max("score").alias("score"))
    order = (F.desc("score"), "vec_id")
    of_class = F.row_number().over(W.partitionBy("class").orderBy(*order))
    best = materialize(once.withColumn("place", of_class).where(F.col("place") <= k + 1).drop("place"), "best")
    hits = asking.join(best, "class").where("query_id <> vec_id")
    hits = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
