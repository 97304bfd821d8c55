"""A written inverted index, and exact BM25 from it that skips what cannot reach the best rows.

Chunks are taken in windows of up to ``WINDOW`` rows. A block holds one term's postings in one window: gaps
between its rows, frequencies, and the two numbers that bound its scores, the greatest frequency and the
least length. A window has one more row that names its chunks, their lengths and their corpus order. All
are rows of one table, in folders by hash of the term, so a search reads the folders of its queries' terms.

A task scores whole windows. The bounds of a window's blocks add up to a bound for every query; windows are taken in
falling order of it until it falls below the query's running k-th score, and only blocks of windows that
are taken are decoded. Equal scores are kept until corpus order decides between them, so the result is that of a scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from evidence_engine.operators import kernels

WINDOW = 2_048
#: Windows that a task holds at once.
WINDOWS_TOGETHER = 32
#: Folders by hash of the term; -1 is the windows' own.
FOLDERS = 128
#: Folders are named to the scan up to this many terms of a pass; more terms are in nearly all of them.
NAMED_TERMS = 4 * FOLDERS

_ROWS = "term string, window long, n int, max_tf int, min_len int, gaps binary, tfs binary, ranks binary"


@dataclass(frozen=True)
class Postings:
    """``rows``: ``part`` (folder), ``term`` (missing for a window's own row), ``window``, ``n`` entries, bounds and payload."""

    rows: DataFrame

    def doc_freq(self) -> DataFrame:
        return self.rows.where("part >= 0").groupBy("term").agg(F.sum("n").alias("df"))


def _invert(batches):
    """Task: blocks of each window of ``place, doc_ord, chunk_index, tokens``."""
    task, number = TaskContext.get().partitionId() << 32, 0
    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, WINDOW):
            part = batch.slice(start, WINDOW)
            held.append(part)
            rows += part.num_rows
            while rows >= WINDOW:
                table = pa.Table.from_batches(held)
                yield from _window(table.slice(0, WINDOW), task + number)
                held, number = table.slice(WINDOW).to_batches(), number + 1
                rows -= WINDOW
    if rows:
        yield from _window(pa.Table.from_batches(held), task + number)


def _window(chunks: pa.Table, window: int):
    places = chunks["place"].to_numpy()
    order = pc.sort_indices(chunks, [("doc_ord", "ascending"), ("chunk_index", "ascending")]).to_numpy()
    ranks = np.empty(len(order), np.uint16)
    ranks[order] = np.arange(len(order))
    tokens = kernels.one_array(chunks["tokens"])
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int32)
    own = [[None], [window], [len(places)], [None], [None], [places.tobytes()], [lengths.tobytes()], [ranks.tobytes()]]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    names = ["term", "window", "n", "max_tf", "min_len", "gaps", "tfs", "ranks"]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(own, kinds)], names=names)
    encoded = kernels.one_array(pa.chunked_array([tokens.flatten()]).dictionary_encode())
    code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cells, tf = np.unique(code * WINDOW + np.repeat(np.arange(len(places)), lengths), return_counts=True)
    if not len(cells):
        return
    code, row = np.divmod(cells, WINDOW)
    first = np.flatnonzero(np.diff(code, prepend=-1))
    gaps = np.diff(row, prepend=0)
    gaps[first] = row[first]
    n = np.diff(np.append(first, len(code)))

    def payload(values: np.ndarray) -> pa.Array:
        offsets = np.append(first, len(code)).astype(np.int32) * values.itemsize
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])

    columns = [
        encoded.dictionary.take(pa.array(code[first])).cast(pa.string()),
        pa.array(np.full(len(first), window)),
        pa.array(n.astype(np.int32)),
        pa.array(np.maximum.reduceat(tf, first).astype(np.int32)),
        pa.array(np.minimum.reduceat(lengths[row], first)),
        payload(gaps.astype(np.uint16)),
        payload(tf.astype(np.uint32)),
        pa.nulls(len(first), pa.binary()),
    ]
    yield pa.RecordBatch.from_arrays(columns, names=names)


def folder_of(term):
    return F.coalesce(F.pmod(F.xxhash64(term), F.lit(FOLDERS)), F.lit(-1)).cast("int")


def write_postings(token_chunks: DataFrame, path: str) -> Postings:
    """Invert a written chunk table with ``place`` and ``tokens``: a narrow pass, then only blocks are shuffled."""
    spark = token_chunks.sparkSession
    narrow = token_chunks.select("place", "doc_ord", F.col("metadata.chunk_index").alias("chunk_index"), "tokens")
    blocks = narrow.mapInArrow(kernels.tidy(_invert), _ROWS)
    blocks = blocks.withColumn("part", F.when(F.col("term").isNull(), -1).otherwise(folder_of(F.col("term"))).cast("int"))
    # A folder goes to as many tasks as its size asks for; its number alone is the order that its writer needs.
    dealt = blocks.hint("rebalance", "part").sortWithinPartitions("part")
    dealt.write.mode("overwrite").partitionBy("part").parquet(path)
    return read_postings(spark, path)


def read_postings(spark: SparkSession, path: str) -> Postings:
    return Postings(spark.read.schema(f"{_ROWS}, part int").parquet(path))


class WindowScorer:
    """Best rows of some windows for all queries of a pass; ``triplets`` are (term, query, weight)."""

    def __init__(self, vocabulary, triplets, n_queries, avg_len, k1, b, k):
        self.number = {t: i for i, t in enumerate(vocabulary.to_pylist())}
        term, query, weight = triplets
        self.n_queries, self.k, self.k1, self.b, self.avg_len = n_queries, k, k1, b, avg_len or 1.0
        by_term = np.argsort(term, kind="stable")
        self.bounds = np.searchsorted(term[by_term], np.arange(len(self.number) + 1))
        self.query_of, self.weight_of = query[by_term], weight[by_term]
        by_query = np.argsort(query, kind="stable")
        cuts = np.searchsorted(query[by_query], np.arange(n_queries + 1))
        self.terms = [list(zip(term[by_query[a:z]].tolist(), weight[by_query[a:z]].tolist())) for a, z in zip(cuts, cuts[1:])]
        self.best = [np.zeros(0)] * n_queries
        self.floor = np.full(n_queries, -np.inf)
        self.found = [[] for _ in range(n_queries)]
        self.seen = np.zeros(4, np.int64)  # windows x queries, taken; blocks, decoded

    def saturation(self, tf, length):
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.avg_len))

    def take(self, rows: pa.Table) -> None:
        """Score the windows of a group: their own rows and all blocks of queried terms."""
        own = rows.filter(pc.is_null(rows["term"]))
        blocks = rows.filter(pc.is_valid(rows["term"]))
        local = {w: i for i, w in enumerate(own["window"].to_pylist())}
        places = [np.frombuffer(x, np.int64) for x in own["gaps"].to_pylist()]
        lengths = [np.frombuffer(x, np.int32) for x in own["tfs"].to_pylist()]
        ranks = [np.frombuffer(x, np.uint16) for x in own["ranks"].to_pylist()]
        term = np.array([self.number[t] for t in blocks["term"].to_pylist()], np.int64)
        window = np.array([local[w] for w in blocks["window"].to_pylist()], np.int64)
        bound = self.saturation(blocks["max_tf"].to_numpy().astype(float), blocks["min_len"].to_numpy())
        many = self.bounds[term + 1] - self.bounds[term]
        # Bounds of whole windows, in parts of bounded size.
        total = np.zeros(len(local) * self.n_queries)
        ends, first = np.cumsum(many), 0
        while first < len(term):
            before = ends[first] - many[first]
            stop = max(first + 1, int(np.searchsorted(ends, before + kernels.BLOCK_CELLS, side="right")))
            part = slice(first, stop)
            which = np.repeat(np.arange(first, stop), many[part])
            at = np.arange(len(which)) + np.repeat(self.bounds[term[part]] - (ends[part] - many[part] - before), many[part])
            cell = window[which] * self.n_queries + self.query_of[at]
            total += np.bincount(cell, self.weight_of[at] * bound[which], len(total))
            first = stop
        total = total.reshape(len(local), self.n_queries)
        where = {(t, w): i for i, (t, w) in enumerate(zip(term.tolist(), window.tolist()))}
        gaps, tfs, decoded = blocks["gaps"], blocks["tfs"], {}
        self.seen[0] += int((total > 0).sum())
        self.seen[2] += len(term)

        def block(i: int):
            if i not in decoded:
                row = np.cumsum(np.frombuffer(gaps[i].as_py(), np.uint16).astype(np.int64))
                tf = np.frombuffer(tfs[i].as_py(), np.uint32)
                decoded[i] = row, self.saturation(tf, lengths[window[i]][row])
            return decoded[i]

        room = 10.0 ** (1 - kernels.SCORE_DIGITS)
        for query in range(self.n_queries):
            for w in np.argsort(-total[:, query], kind="stable").tolist():
                if total[w, query] <= 0 or total[w, query] + room < self.floor[query]:
                    break
                self.seen[1] += 1
                hit, value = [], []
                for t, weight in self.terms[query]:
                    i = where.get((t, w))
                    if i is not None:
                        row, saturated = block(i)
                        hit.append(row)
                        value.append(weight * saturated)
                scores = np.round(np.bincount(np.concatenate(hit), np.concatenate(value)), kernels.SCORE_DIGITS)
                row = np.flatnonzero((scores > 0) & (scores >= self.floor[query]))
                if len(row) > self.k:
                    row = row[np.lexsort((ranks[w][row], -scores[row]))[: self.k]]
                if len(row):
                    self._add(query, places[w][row], scores[row])
        self.seen[3] += len(decoded)

    def _add(self, query: int, places: np.ndarray, scores: np.ndarray) -> None:
        self.found[query].append((places, scores))
        best = np.concatenate([self.best[query], scores])
        if len(best) >= self.k:
            best = np.partition(best, len(best) - self.k)[len(best) - self.k :]
            self.floor[query] = best.min()
        self.best[query] = best
        if len(self.found[query]) > 64:
            self.found[query] = [self._kept(query)]

    def _kept(self, query: int):
        places, scores = (np.concatenate(x) for x in zip(*self.found[query]))
        kept = scores >= self.floor[query]
        return places[kept], scores[kept]

    def results(self):
        for query, found in enumerate(self.found):
            if found:
                places, scores = self._kept(query)
                yield query, places, scores


def scored(batches, make, query_ids, report):
    """Task: rows sorted by group; candidates of all its groups together, or what it has read and skipped."""
    scorer, held, group = make(), [], None
    for batch in batches:
        groups = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
        for start, stop in zip(edges, edges[1:]):
            if start == stop:
                continue
            if held and groups[start] != group:
                scorer.take(pa.Table.from_batches(held))
                held = []
            group = groups[start]
            held.append(batch.slice(start, stop - start))
    if held:
        scorer.take(pa.Table.from_batches(held))
    if report:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in scorer.seen], names=["windows", "taken", "blocks", "decoded"])
        return
    for query, places, scores in scorer.results():
        ids = query_ids.slice(query, 1).take(pa.array(np.zeros(len(places), np.int64)))
        yield pa.RecordBatch.from_arrays([ids, pa.array(places), pa.array(scores)], names=["query_id", "place", "score"])


def wanted_rows(postings: Postings, terms: DataFrame, n_terms: int) -> DataFrame:
    """The windows' own rows and the blocks of some terms, with ``group``; ``terms`` is as small as a pass."""
    rows = postings.rows
    blocks = rows.where("part >= 0")
    if n_terms <= NAMED_TERMS:
        folders = [r[0] for r in terms.select(folder_of(F.col("term"))).distinct().collect()]
        blocks = blocks.where(F.col("part").isin(folders))
    blocks = blocks.join(F.broadcast(terms), "term", "left_semi")
    both = rows.where("part < 0").select(*blocks.columns).unionAll(blocks)
    group = F.shiftright("window", 32) * F.lit(1 << 32) + F.floor(F.col("window").bitwiseAND(F.lit((1 << 32) - 1)) / WINDOWS_TOGETHER)
    return both.select(group.cast("long").alias("group"), "term", "window", "n", "max_tf", "min_len", "gaps", "tfs", "ranks")


def best_chunks(
    postings: Postings, weights: tuple, query_ids: pa.Array, id_type: str, k: int, report: bool = False
) -> DataFrame:
    """``query_id, place, score``: each query's k best places and those that tie with the last.

    ``weights`` are those of :func:`evidence_engine.operators.retrieval.bm25_weights`. With ``report``, what each task saw instead:
    pairs of query and window, those taken, blocks read, those decoded.
    """
    _, vocabulary, _, triplets, n_queries, avg_len, k1, b = weights
    spark = postings.rows.sparkSession
    terms = spark.createDataFrame(pa.table({"term": pa.chunked_array([vocabulary.cast(pa.string())])}))
    rows = wanted_rows(postings, terms, len(vocabulary)).repartition("group").sortWithinPartitions("group")
    shared = spark.sparkContext.broadcast(((vocabulary, triplets, n_queries, avg_len, k1, b, k), query_ids))

    @kernels.tidy
    def run(batches):
        parts, ids = shared.value
        yield from scored(batches, lambda: WindowScorer(*parts), ids, report)

    if report:
        return rows.mapInArrow(run, "windows long, taken long, blocks long, decoded long")
    found = rows.mapInArrow(run, f"query_id {id_type}, place long, score double")
    level = F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score")))
    return found.withColumn("level", level).where(F.col("level") <= k).drop("level")


def with_chunks(found: DataFrame, chunks: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Candidates of the ``bm25`` ranking with columns of their chunks."""
    named = chunks.withColumn("chunk_index", F.col("metadata.chunk_index")).select("place", *payload)
    return found.join(named, "place").select(F.lit("bm25").alias("ranking"), "query_id", "score", *payload)
