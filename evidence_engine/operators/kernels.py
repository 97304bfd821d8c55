"""Scoring of Arrow batches of chunks against a bounded block of queries.

These are the task-side helpers of :mod:`evidence_engine.operators.retrieval`. A task reads its
partition batch by batch, scores every chunk against every query of the block with one
matrix product per batch, and keeps the best rows per query. The module is shipped by value,
so executors need no installed package.
"""

from __future__ import annotations

import ctypes
import hashlib
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SCORE_DIGITS = 9  # ranks must not depend on the order in which floats were added
BLOCK_CELLS = 2_000_000  # upper bound of any matrix a task holds (16 MB of doubles)
POOL_ROWS = 20_000
CELL_COST = 128  # adding to one cell costs about as much as this many cells of a matrix product
CACHED_TERMS = 300_000


def give_back() -> None:
    """Return what a worker has freed to the system: it outlives its tasks, and others run beside it."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function):
    """An iterator function for tasks that leaves no freed memory in its worker."""

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def hash_terms(terms: list[str], family: str) -> np.ndarray:
    """The unsigned integers that decide the buckets and signs of terms."""
    if family == "blake2b":
        digests = b"".join([hashlib.blake2b(t.encode(), digest_size=8).digest() for t in terms])
        return np.frombuffer(digests, ">u8").astype(np.uint64)
    if family == "md5":  # the first 15 hexadecimal digits
        digests = b"".join([hashlib.md5(t.encode()).digest()[:8] for t in terms])
        return np.frombuffer(digests, ">u8").astype(np.uint64) >> np.uint64(4)
    raise ValueError(f"unknown hash family {family!r}")


def split_tokens(texts: pa.Array) -> pa.ListArray:
    """The tokens of each text, as :func:`evidence_engine.functions.text.tokenize` gives them, from whole batches of bytes.

    Word-like characters are ASCII, ideographs are three bytes of UTF-8, and no other character's bytes look like either.
    """
    texts = texts.cast(pa.large_binary())
    raw = texts.buffers()
    rows = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2] or b"", np.uint8)[rows[0] : rows[-1]] if len(texts) else np.zeros(0, np.uint8)
    rows = rows - rows[0]
    is_word, lower = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
    is_word[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_+#.-")] = True
    lower[65:91] += 32
    inside = is_word[data]
    # A run begins behind, and ends before, another kind of byte or the border of a text.
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    borders = rows[(rows > 0) & (rows < len(data))]
    first[borders] = inside[borders]
    last[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    values = lower[data]
    signs = _ideographs(data, rows)
    if len(signs):
        # Behind a text's words and signs come pairs of signs; their bytes are laid out behind all texts.
        of = np.searchsorted(rows, signs, side="right")
        left = np.flatnonzero(of[1:] == of[:-1])
        pairs = np.concatenate([signs[left, None] + np.arange(3), signs[left + 1, None] + np.arange(3)], axis=1)
        at = len(values) + 6 * np.arange(len(left))
        values = np.concatenate([values, values[pairs.ravel()]])
        places = np.concatenate([starts, signs, rows[of[left]] - 1])
        kinds = np.repeat([0, 1], [len(starts) + len(signs), len(left)])
        order = np.lexsort((kinds, places))
        starts, ends = (np.concatenate(x)[order] for x in ((starts, signs, at), (ends, signs + 3, at + 6)))
        counted = np.searchsorted(places[order], rows)
        lengths = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        values = values[np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)]
    else:
        counted = np.searchsorted(starts, rows)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        values = values[inside]
    words = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values)])
    missing = texts.is_null() if texts.null_count else None
    return pa.ListArray.from_arrays(pa.array(counted, pa.int32()), words, mask=missing)


def _ideographs(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the characters U+4E00 to U+9FFF begin."""
    at = np.flatnonzero((data >= 0xE4) & (data <= 0xE9))
    at = at[at + 2 < rows[np.searchsorted(rows, at, side="right")]] if len(at) else at
    second, third = data[at + 1].astype(np.int32), data[at + 2].astype(np.int32)
    whole = (second >> 6 == 2) & (third >> 6 == 2)
    point = (data[at].astype(np.int32) & 15) << 12 | (second & 63) << 6 | third & 63
    return at[whole & (point >= 0x4E00) & (point <= 0x9FFF)]


def count_terms(batches):
    """Task: of each batch of texts every term with the number of texts that hold it, and without a term the numbers of texts and tokens."""
    for batch in batches:
        tokens = split_tokens(batch.column(0))
        encoded = pc.dictionary_encode(tokens.flatten())
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        held = np.unique(code * max(len(tokens), 1) + row_numbers(tokens)) // max(len(tokens), 1)
        df = np.bincount(held, minlength=len(encoded.dictionary)).astype(np.int64)
        n_tokens = np.zeros(len(df) + 1, np.int64)
        n_tokens[0] = len(code)
        terms = pa.concat_arrays([pa.nulls(1, pa.string()), encoded.dictionary.cast(pa.string())])
        columns = [terms, pa.array(np.append(len(tokens), df)), pa.array(n_tokens)]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "df", "n_tokens"])


def tokenized(batches, kept):
    """Batches of chunks with the columns to be kept and the tokens of their texts."""
    for batch in batches:
        columns = {n: c for n, c in zip(batch.schema.names, batch.columns) if n in kept}
        columns["tokens"] = split_tokens(batch.column(batch.schema.get_field_index("text")))
        yield pa.RecordBatch.from_pydict(columns)


class TermHasher:
    """Signed feature hashing of token lists; only terms that are new to the task are hashed."""

    def __init__(self, dimension: int, family: str):
        self.dimension, self.family, self.known = dimension, family, {}

    def _values(self, terms: list[str]) -> np.ndarray:
        if len(self.known) > CACHED_TERMS:
            self.known = {}
        values = list(map(self.known.get, terms))
        new = [at for at, value in enumerate(values) if value is None]
        for at, value in zip(new, hash_terms([terms[at] for at in new], self.family).tolist()):
            values[at] = self.known[terms[at]] = value
        return np.array(values, dtype=np.uint64)

    def matrix(self, tokens: pa.ListArray) -> np.ndarray:
        """Integer-valued ``len(tokens) x dimension`` matrix of signed counts."""
        encoded = pc.dictionary_encode(tokens.flatten())
        values = self._values(encoded.dictionary.to_pylist())
        bucket = (values % np.uint64(self.dimension)).astype(np.int64)
        sign = np.where(values % np.uint64(2) == 1, 1.0, -1.0)
        code = encoded.indices.to_numpy(zero_copy_only=False)
        cells = np.bincount(
            row_numbers(tokens) * self.dimension + bucket[code],
            weights=sign[code],
            minlength=len(tokens) * self.dimension,
        )
        return cells.reshape(len(tokens), self.dimension)


def sparse(matrix: np.ndarray) -> pa.StructArray:
    """Rows as the places of their entries other than zero, the entries, and the row's length."""
    row, bucket = np.nonzero(matrix)
    ends = pa.array(np.searchsorted(row, np.arange(len(matrix) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, matrix[row, bucket].astype(np.int64))]
    return pa.StructArray.from_arrays([*lists, pa.array(norms(matrix))], names=["bucket", "count", "norm"])


def row_numbers(lists: pa.ListArray) -> np.ndarray:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), lengths)


def norms(matrix: np.ndarray) -> np.ndarray:
    """Row lengths, a zero length counting as one."""
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return np.where(length == 0, 1.0, length)


class Bm25Scorer:
    """Okapi BM25; ``triplets`` hold idf x query multiplicity as (term, query, weight).

    Terms that many chunks and many queries share go through a matrix product. The others, by far
    the most, touch few (chunk, query) cells each and are added cell by cell.
    """

    positive_only = True

    def __init__(self, vocabulary, shares, triplets, n_queries, avg_len, k1, b):
        self.vocabulary, self.n_queries = vocabulary, n_queries
        self.avg_len, self.k1, self.b = avg_len or 1.0, k1, b
        term, query, weight = triplets
        queries_per_term = np.bincount(term, minlength=len(vocabulary))
        self.common = shares * queries_per_term * CELL_COST > n_queries
        self.column = np.cumsum(self.common) - 1
        common = self.common[term]
        self.weights = np.zeros((int(self.common.sum()), n_queries))
        self.weights[self.column[term[common]], query[common]] = weight[common]
        order = np.flatnonzero(~common)[np.argsort(term[~common], kind="stable")]
        self.rare_query, self.rare_weight = query[order], weight[order]
        self.rare_count = np.where(self.common, 0, queries_per_term)
        self.rare_start = np.cumsum(self.rare_count) - self.rare_count

    def width(self) -> int:
        return max(len(self.weights), self.n_queries, 1)

    def saturations(self, tokens: pa.ListArray):
        """(chunk, term, saturated frequency) of every query term in every chunk."""
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        found = pc.index_in(tokens.flatten(), value_set=self.vocabulary)
        known = found.is_valid().to_numpy(zero_copy_only=False)
        terms = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
        places = np.repeat(np.arange(len(tokens)), lengths)[known] * len(self.vocabulary) + terms
        places, tf = np.unique(places, return_counts=True)
        chunk, term = np.divmod(places, max(len(self.vocabulary), 1))
        damping = self.k1 * (1 - self.b + self.b * lengths[chunk] / self.avg_len)
        return chunk, term, tf * (self.k1 + 1) / (tf + damping)

    def __call__(self, chunks: pa.Table) -> np.ndarray:
        tokens = one_array(chunks["tokens"])
        chunk, term, value = self.saturations(tokens)
        common = self.common[term]
        matrix = np.zeros((len(tokens), len(self.weights)))
        matrix[chunk[common], self.column[term[common]]] = value[common]
        scores = self.weights.T @ matrix.T
        chunk, term, value = chunk[~common], term[~common], value[~common]
        # Each remaining (chunk, term) meets the queries that ask for the term: a run of the triplets.
        # Runs are laid out in blocks of bounded length; one run is no longer than a pass has queries.
        run = self.rare_count[term]
        ends = np.cumsum(run)
        first = 0
        while first < len(term):
            before = ends[first] - run[first]
            stop = max(first + 1, int(np.searchsorted(ends, before + BLOCK_CELLS, side="right")))
            part = slice(first, stop)
            which = np.repeat(np.arange(first, stop), run[part])
            at = np.arange(len(which)) + np.repeat(self.rare_start[term[part]] - (ends[part] - run[part] - before), run[part])
            cells = self.rare_query[at] * len(tokens) + chunk[which]
            scores += np.bincount(cells, value[which] * self.rare_weight[at], scores.size).reshape(scores.shape)
            first = stop
        return scores


class HashedCosineScorer:
    """Cosine of hashed token counts: exact integer products until the final division."""

    positive_only = False

    def __init__(self, query_tokens, dimension, family):
        self.hasher = TermHasher(dimension, family)
        self.queries = self.hasher.matrix(query_tokens)
        self.query_norms = norms(self.queries)

    def width(self) -> int:
        return max(self.queries.shape)

    def __call__(self, chunks: pa.Table) -> np.ndarray:
        matrix = self.hasher.matrix(one_array(chunks["tokens"]))
        return (self.queries @ matrix.T) / (self.query_norms[:, None] * norms(matrix)[None, :])


class WrittenCosineScorer(HashedCosineScorer):
    """The same over written vectors: no token is hashed again."""

    def __call__(self, chunks: pa.Table) -> np.ndarray:
        hashed = one_array(chunks["hashed"])
        bucket, count, length = (hashed.field(i) for i in range(3))
        matrix = np.zeros((len(hashed), self.hasher.dimension))
        matrix[row_numbers(bucket), bucket.flatten().to_numpy(zero_copy_only=False)] = count.flatten().to_numpy(zero_copy_only=False)
        return (self.queries @ matrix.T) / (self.query_norms[:, None] * length.to_numpy(zero_copy_only=False)[None, :])


class VectorCosineScorer:
    """Cosine over supplied vectors; vectors of another dimension are an error."""

    positive_only = False

    def __init__(self, query_vectors):
        self.queries = np.asarray(query_vectors, dtype=np.float64)
        self.query_norms = norms(self.queries)

    def width(self) -> int:
        return max(self.queries.shape)

    def __call__(self, chunks: pa.Table) -> np.ndarray:
        vectors = one_array(chunks["vector"])
        lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
        if (lengths != self.queries.shape[1]).any():
            raise ValueError(f"vector dimensions differ: queries have {self.queries.shape[1]}")
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        if not np.isfinite(matrix).all():
            raise ValueError("a chunk's vector has an entry that is missing or not finite")
        return (self.queries @ matrix.T) / (self.query_norms[:, None] * norms(matrix)[None, :])


def make_scorer(kind: str, *parts):
    kinds = {"bm25": Bm25Scorer, "hashed": HashedCosineScorer, "written": WrittenCosineScorer, "vectors": VectorCosineScorer}
    return kinds[kind](*parts)


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def best_rows(scores: np.ndarray, k: int, positive_only: bool, floor: np.ndarray):
    """(query, row) numbers of each query's k best rows; equal scores go to the earlier row."""
    keep = scores >= floor[:, None]
    if positive_only:
        keep &= scores > 0
    count = scores.shape[1]
    if count > k:
        kth = np.partition(scores, count - k, axis=1)[:, count - k, None]
        above, level = scores > kth, scores == kth
        room = k - above.sum(axis=1, keepdims=True)
        keep &= above | (level & (np.cumsum(level, axis=1) <= room))
    return np.nonzero(keep)


class BestPool:
    """Running best rows of one ranking within one task."""

    def __init__(self, n_queries: int, k: int):
        self.n_queries, self.k = n_queries, k
        self.tables, self.rows = [], 0
        self.floor = np.full(n_queries, -np.inf)

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.rows += len(table)
        if self.rows > max(POOL_ROWS, 2 * self.n_queries * self.k):
            self.compact()

    def compact(self) -> pa.Table | None:
        if not self.tables:
            return None
        table = pa.concat_tables(self.tables).sort_by(
            [("query_no", "ascending"), ("score", "descending"), ("doc_ord", "ascending"), ("chunk_index", "ascending")]
        )
        query = table["query_no"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query, side="left")
        score = table["score"].to_numpy()
        full = place == self.k - 1
        self.floor[query[full]] = score[full]
        table = table.filter(pa.array(place < self.k))
        self.tables, self.rows = [table], len(table)
        return table


def rank_partition(batches, scorers, query_ids, k, payload):
    """Candidates of one partition: the k best chunks per ranking and query."""
    pools = {ranking: BestPool(len(query_ids), k) for ranking in scorers}
    widest = max((scorer.width() for scorer in scorers.values()), default=1)
    slice_rows = max(1, min(BLOCK_CELLS // widest, 10_000))
    for batch in batches:
        for start in range(0, batch.num_rows, slice_rows):
            chunks = pa.Table.from_batches([batch.slice(start, slice_rows)])
            chunks = chunks.sort_by([("doc_ord", "ascending"), ("chunk_index", "ascending")])
            for ranking, scorer in scorers.items():
                pool = pools[ranking]
                scores = np.round(scorer(chunks), SCORE_DIGITS)
                query, row = best_rows(scores, k, scorer.positive_only, pool.floor)
                if len(row):
                    picked = chunks.select(payload).take(pa.array(row))
                    picked = picked.append_column("query_no", pa.array(query, pa.int64()))
                    pool.add(picked.append_column("score", pa.array(scores[query, row])))
    for ranking, pool in pools.items():
        table = pool.compact()
        if table is not None:
            ids = query_ids.take(table["query_no"].combine_chunks())
            names = pa.array([ranking] * len(table), pa.string())
            columns = [names, ids, table["score"], *(table[c] for c in payload)]
            out = pa.table(columns, names=["ranking", "query_id", "score", *payload])
            yield from out.to_batches(max_chunksize=10_000)
