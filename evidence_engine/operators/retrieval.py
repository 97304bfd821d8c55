"""Batch retrieval: a table of questions against an index, in one job.

Dense and BM25 rankings come out of a single scan of the chunk table: every task keeps its
own best rows per query (see :mod:`evidence_engine.operators.kernels`), and one window per query
merges them. Only ``tasks x queries x k`` candidate rows are shuffled, never scores of pairs, and
they carry no texts: those are joined to the final hits.
Queries are taken in passes of bounded size, one after another: a pass adds its ranks to one written
table and gives its broadcast back before the next one starts, so the plan of what follows does not grow with them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.operators import kernels, postings
from evidence_engine.operators.index import Index, weigh
from evidence_engine.sources.scratch import append, materialize, scratch_path

cloudpickle.register_pickle_by_value(kernels)
cloudpickle.register_pickle_by_value(postings)

# A pass takes about this many queries, and query tokens or vector entries, at most: a few
# megabytes to broadcast. Larger passes mean fewer scans, smaller ones less memory per task.
QUERIES_PER_PASS = 1_000
ENTRIES_PER_PASS = {"tokens": 100_000, "vector": 2_000_000}
# What a task keeps is queries x K rows.
CANDIDATES_PER_PASS = 50_000

# BM25 reads postings if they hold at most this share of the corpus' tokens; more are read faster with the chunks.
POSTINGS_SHARE = 0.25

# What each kind of scorer reads of a chunk.
SCORED_COLUMNS = {"bm25": "tokens", "hashed": "tokens", "written": "hashed", "vectors": "vector"}

# Candidates are merged in two steps; in the first, a query's are dealt into so many groups.
MERGE_GROUPS = 64

CHUNK_COLUMNS = ("chunk_id", "document_id", "source", "text")
NARROW_COLUMNS = ("chunk_id", "document_id", "source")


def check_top_k(k: int) -> None:
    if k < 1:
        raise ValueError(f"K must be at least 1, got {k}")


def candidate_count(k: int) -> int:
    """How deep each ranking is read before fusion at K."""
    return max(fv.CANDIDATE_FACTOR * k, fv.CANDIDATE_MINIMUM)


def prepare_queries(questions: DataFrame, strict: bool = False) -> DataFrame:
    """``query_id, question`` to stripped, tokenized queries; blank ones are dropped or an error."""
    stripped = tx.strip(F.col("question"))
    if strict:
        complaint = F.raise_error(F.concat(F.lit("blank question: "), F.col("query_id").cast("string")))
        stripped = F.when(tx.is_blank(F.col("question")), complaint.cast("string")).otherwise(stripped)
    searched = questions.select("query_id", "question", stripped.alias("searched"))
    return searched.where(F.col("searched") != "").withColumn("tokens", tx.tokenize(F.col("searched")))


def blank_queries(questions: DataFrame) -> DataFrame:
    """The reject table of :func:`prepare_queries`."""
    return questions.where(tx.is_blank(F.col("question"))).select(
        "query_id", "question", F.lit("blank question").alias("reason")
    )


def query_passes(queries: DataFrame, features: Sequence[str], k: int) -> Iterator[DataFrame]:
    """Split queries by hash into passes small enough to broadcast; usually there is one. Repeated ids are an error."""
    entries = [F.sum(F.array_size(feature).cast("bigint")) for feature in features]
    n, *totals = queries.agg(F.count(F.lit(1)), *entries).first()
    repeated = queries.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated:
        raise ValueError(f"query id {repeated['query_id']} occurs {repeated['n']} times")
    shares = [(total or 0) / ENTRIES_PER_PASS[feature] for feature, total in zip(features, totals)]
    passes = math.ceil(max(n / QUERIES_PER_PASS, n * k / CANDIDATES_PER_PASS, *shares))
    for number in range(passes):
        in_pass = F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number
        yield queries.where(in_pass) if passes > 1 else queries


def index_tokens(index: Index) -> float:
    n_chunks, avg_len = index.stats.select("n_chunks", "avg_len").first()
    return n_chunks * avg_len


def bm25_weights(index: Index, query_ids: pa.Array, tokens: DataFrame, k1: float, b: float) -> tuple[tuple, int]:
    """What the BM25 scorer of one pass needs, its terms joined with the document frequencies; and the number of their postings."""
    terms = tokens.select("query_id", F.inline(tx.term_counts(F.col("tokens"))))
    # A pass's terms are few; the vocabulary is larger than the compressed files that Spark sizes it by.
    weighted = weigh(F.broadcast(terms), index).toArrow().combine_chunks()
    n_chunks, avg_len = index.stats.select("n_chunks", "avg_len").first()
    df = weighted["df"].to_numpy()
    idf = np.log(1 + (n_chunks - df + 0.5) / (df + 0.5))
    encoded = kernels.one_array(weighted["term"].dictionary_encode())
    term = encoded.indices.to_numpy()
    shares = np.zeros(len(encoded.dictionary))
    shares[term] = df / max(n_chunks, 1)
    position = {query_id: number for number, query_id in enumerate(query_ids.to_pylist())}
    query = np.array([position[q] for q in weighted["query_id"].to_pylist()], dtype=np.int64)
    triplets = (term, query, idf * weighted["tf"].to_numpy())
    n_postings = int(round(shares.sum() * max(n_chunks, 1)))
    return ("bm25", encoded.dictionary, shares, triplets, len(query_ids), avg_len, k1, b), n_postings


def _rank(
    chunks: DataFrame,
    queries: DataFrame,
    features: Sequence[str],
    k: int,
    keep: Sequence[str],
    describe,
    looked_up=None,
) -> tuple[DataFrame, int]:
    """The k best rows per ranking and query, one written table, from one scan of the chunks for each pass; and the number of passes.

    ``describe(block, held, query_ids)`` says which scorers a pass needs, given its queries as a DataFrame and as an
    Arrow table, and what it looks up elsewhere; ``looked_up(that, query_ids, payload)`` gives these candidates. The scan reads
    the scorers' columns, and without scorers there is none. Without queries there is one empty table.
    """
    check_top_k(k)
    payload = list(dict.fromkeys([*keep, "doc_ord", "chunk_index"]))
    flat = chunks.withColumn("chunk_index", F.col("metadata.chunk_index"))
    schema = T.StructType(
        [T.StructField("ranking", T.StringType()), queries.schema["query_id"], T.StructField("score", T.DoubleType())]
        + [flat.select(*payload).schema[c] for c in payload]
    )
    spark, path, passes = chunks.sparkSession, scratch_path(chunks.sparkSession, "ranked"), 0
    for block in query_passes(queries, features, k):
        passes += 1
        held = block.select("query_id", *features).toArrow().combine_chunks()
        query_ids = kernels.one_array(held["query_id"])
        described, elsewhere = describe(block, held, query_ids)
        read = list(dict.fromkeys(SCORED_COLUMNS[kind] for kind, *_ in described.values()))
        from_texts = "tokens" in read and "tokens" not in chunks.columns
        columns = list(dict.fromkeys([*payload, *(c for c in read if c != "tokens" or not from_texts)]))
        shared = spark.sparkContext.broadcast((described, query_ids))

        @kernels.tidy
        def rank(batches, shared=shared, from_texts=from_texts, columns=columns):
            described, ids = shared.value
            batches = kernels.tokenized(batches, columns) if from_texts else batches
            scorers = {ranking: kernels.make_scorer(*parts) for ranking, parts in described.items()}
            yield from kernels.rank_partition(batches, scorers, ids, k, payload)

        scanned = list(dict.fromkeys([*columns, "text"])) if from_texts else columns
        candidates = [flat.select(*scanned).mapInArrow(rank, schema)] if described else []
        if elsewhere is not None:
            candidates.append(looked_up(elsewhere, query_ids, payload))
        append(_merge(reduce(DataFrame.unionByName, candidates), k), path)
        shared.destroy()
    schema = T.StructType([*schema, T.StructField("rank", T.IntegerType())])
    return spark.read.schema(schema).parquet(path) if passes else spark.createDataFrame([], schema), passes


def _merge(candidates: DataFrame, k: int) -> DataFrame:
    """Global ranks from the tasks' candidates.

    Candidates are thinned in groups of tasks first, so that no task meets all of a query's. Every
    later step groups by query: one more shuffle on ``query_id`` serves them all.
    """
    order = (F.desc("score"), "doc_ord", "chunk_index")

    def best(rows: DataFrame, *groups: str) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(
            F.col("rank") <= k
        )

    salted = candidates.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    thinned = best(salted, "ranking", "query_id", "salt").drop("rank", "salt")
    return best(thinned.repartition("query_id"), "ranking", "query_id")


def _rank_index(
    index: Index,
    queries: DataFrame,
    rankings: Sequence[str],
    k: int,
    keep: Sequence[str],
    *,
    k1: float = fv.BM25_K1,
    b: float = fv.BM25_B,
    embedding: str = "hashing",
    dimension: int = fv.HASH_DIMENSION,
    family: str = "blake2b",
    bm25_from: str = "cheaper",
) -> tuple[DataFrame, int]:
    if bm25_from not in ("cheaper", "postings", "chunks") or (bm25_from == "postings" and index.postings is None):
        raise ValueError(f"BM25 cannot be read from {bm25_from!r}")
    if embedding not in ("hashing", "vectors"):
        raise ValueError(f"unknown embedding {embedding!r}")
    own_vectors = "dense" in rankings and embedding == "vectors"
    written = "dense" in rankings and not own_vectors and index.hashed == (dimension, family)
    features = ["tokens", "vector"] if own_vectors else ["tokens"]

    def describe(block: DataFrame, held: pa.Table, query_ids: pa.Array) -> tuple[dict, tuple | None]:
        """Scorers that scan the chunks, and BM25's weights if it reads the postings."""
        scorers, weights = {}, None
        if "bm25" in rankings:
            weights, n_postings = bm25_weights(index, query_ids, block, k1, b)
            few = index.postings is not None and n_postings <= POSTINGS_SHARE * index_tokens(index)
            if bm25_from == "chunks" or (bm25_from == "cheaper" and not few):
                scorers["bm25"], weights = weights, None
        if own_vectors:
            scorers["dense"] = ("vectors", _matrix(held))
        elif "dense" in rankings:
            scorers["dense"] = ("written" if written else "hashed", kernels.one_array(held["tokens"]), dimension, family)
        return scorers, weights

    def looked_up(weights: tuple, query_ids: pa.Array, payload: Sequence[str]) -> DataFrame:
        id_type = queries.schema["query_id"].dataType.simpleString()
        found = postings.best_chunks(index.postings, weights, query_ids, id_type, k)
        return postings.with_chunks(found, index.chunks, payload)

    return _rank(index.chunks, queries, features, k, keep, describe, looked_up)


def block_use(
    index: Index, queries: DataFrame, k: int = fv.TOP_K, k1: float = fv.BM25_K1, b: float = fv.BM25_B
) -> DataFrame:
    """What BM25 reads of the postings: pairs of query and ``windows`` with a shared term, those ``taken``, ``blocks`` read, those ``decoded``."""
    tables = []
    for block in query_passes(queries, ["tokens"], k):
        query_ids = kernels.one_array(block.select("query_id").toArrow().combine_chunks()["query_id"])
        weights, _ = bm25_weights(index, query_ids, block, k1, b)
        tables.append(materialize(postings.best_chunks(index.postings, weights, query_ids, "", k, report=True), "blocks"))
    columns = ("windows", "taken", "blocks", "decoded")
    if not tables:
        return index.stats.sparkSession.createDataFrame([(0, 0, 0, 0)], ", ".join(f"{c} long" for c in columns))
    return reduce(DataFrame.unionByName, tables).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns))


def rank_chunks(
    index: Index, queries: DataFrame, rankings: Sequence[str], k: int, keep: Sequence[str] = NARROW_COLUMNS, **options
) -> DataFrame:
    """Exact top-k of the ``bm25`` and/or ``dense`` ranking for every query, from one scan for each pass of queries.

    Dense keeps zero scores (a query without tokens gets the first k chunks of the corpus);
    BM25 drops them. Ties go to corpus order. With ``embedding="vectors"``, dense compares the
    ``vector`` columns of chunks and queries, see :func:`embed`. Of a written index, dense reads the hashed
    vectors; ``bm25_from`` says whether BM25 reads ``"postings"`` or ``"chunks"``: the ``"cheaper"`` are the postings
    of a pass's terms while they are a small part of all. Other options are ``k1``, ``b``, ``dimension`` and ``family``.
    """
    return _rank_index(index, queries, rankings, k, keep, **options)[0]


def rank_vectors(chunks: DataFrame, queries: DataFrame, k: int, keep: Sequence[str] = NARROW_COLUMNS) -> DataFrame:
    """Exact cosine top-k where only vectors are at hand: both tables carry ``vector ARRAY<FLOAT|DOUBLE>``."""
    return _rank(chunks, queries, ["vector"], k, keep, lambda block, held, ids: ({"dense": ("vectors", _matrix(held))}, None))[0]


def _matrix(held: pa.Table) -> np.ndarray:
    matrix = np.array(held["vector"].to_pylist(), dtype=np.float64)
    if not np.isfinite(matrix).all():
        raise ValueError("a query's vector has an entry that is missing or not finite")
    return matrix


def embed(index: Index, queries: DataFrame, model: Callable[[Column], Column]) -> tuple[Index, DataFrame]:
    """Add a user's ``vector`` to chunks and queries: ``model`` maps text to an array column.

    The embedded chunks are written here, so a model runs once over each chunk whatever the passes.
    """
    chunks = materialize(index.chunks.withColumn("vector", model(F.col("text"))), "embedded")
    return replace(index, chunks=chunks), queries.withColumn("vector", model(F.col("searched")))


def rank_strategies(
    ranked: DataFrame,
    strategies: Sequence[str],
    ks: Sequence[int],
    *,
    rrf_k: int = fv.RRF_K,
    dense_weight: float = 1.0,
    sparse_weight: float = 1.0,
) -> DataFrame:
    """Hits of every strategy at every K from the two rankings, in one pass over the candidates.

    ``bm25`` and ``dense`` cut their own ranking at K. ``hybrid`` adds the weighted reciprocal
    ranks of both rankings, each read to a depth that depends on K; so its K = 1 is not in general
    a prefix of its K = 5. Equal scores go to the better dense, then the better sparse rank.
    """
    fusion = {"rrf_k": rrf_k, "dense_weight": dense_weight, "sparse_weight": sparse_weight}
    return _fused(ranked, strategies, ks, **fusion).drop("doc_ord")


def _fused(
    ranked: DataFrame, strategies: Sequence[str], ks: Sequence[int], *, rrf_k: int, dense_weight: float, sparse_weight: float
) -> DataFrame:
    """:func:`rank_strategies` with ``doc_ord``, which with the chunk's number names its place."""
    wanted = [
        F.struct(
            F.lit(strategy).alias("strategy"),
            F.lit(k).alias("k"),
            F.lit(candidate_count(k) if strategy == "hybrid" else k).alias("depth"),
        )
        for strategy in strategies
        for k in ks
    ]
    at_depth = F.col("rank") <= F.col("at.depth")
    of_strategy = F.col("at.strategy").isin("hybrid", F.col("ranking"))
    candidates = ranked.withColumn("at", F.explode(F.array(*wanted))).where(at_depth & of_strategy)
    details = [c for c in ranked.columns if c not in ("ranking", "query_id", "chunk_id", "score", "rank")]

    def rank_in(ranking: str) -> Column:
        return F.max(F.when(F.col("ranking") == ranking, F.col("rank")))

    def share(weight: float, rank: str) -> Column:
        return F.coalesce(F.lit(float(weight)) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))

    fused_score = share(dense_weight, "dense_rank") + share(sparse_weight, "sparse_rank")
    fused = (
        candidates.groupBy(
            # The place names a chunk even where two ids, of 64 bits, should be equal.
            F.col("at.strategy").alias("strategy"), F.col("at.k").alias("k"), "query_id", "chunk_id", "doc_ord", "chunk_index"
        )
        .agg(
            rank_in("dense").alias("dense_rank"),
            rank_in("bm25").alias("sparse_rank"),
            F.max("score").alias("own_score"),
            F.any_value(F.struct(*details)).alias("chunk"),
        )
        .withColumn("score", F.when(F.col("strategy") == "hybrid", fused_score).otherwise(F.col("own_score")))
    )
    best = W.partitionBy("strategy", "k", "query_id").orderBy(
        F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank")
    )
    columns = ["strategy", "k", "query_id", "rank", "chunk_id"]
    shown = [f"chunk.{c}" for c in details if c not in ("doc_ord", "chunk_index")]
    return (
        fused.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= F.col("k"))
        .select(*columns, *shown, F.struct("chunk_index").alias("metadata"), "score", "dense_rank", "sparse_rank", "doc_ord")
    )


def _with_text(hits: DataFrame, chunks: DataFrame, passes: int) -> DataFrame:
    """Join texts to hits. Those of one pass, which limits their number, are sent to where the texts are."""
    texts = chunks.select("chunk_id", "doc_ord", "text", F.col("metadata.chunk_index").alias("chunk_index"))
    named = [texts[c] == hits[c] for c in ("chunk_id", "doc_ord")]
    joined = texts.join(F.broadcast(hits) if passes <= 1 else hits, [*named, texts["chunk_index"] == hits["metadata.chunk_index"]])
    return joined.select(*(hits[c] for c in hits.columns), texts["text"])


def check_strategies(strategies: Sequence[str]) -> list[str]:
    """Selected strategies in order, each once; unknown names are an error."""
    unknown = sorted(set(strategies) - set(fv.STRATEGIES))
    if unknown:
        raise ValueError(f"unknown strategies: {', '.join(unknown)}")
    if not strategies:
        raise ValueError("at least one strategy is needed")
    return list(dict.fromkeys(strategies))


def search(
    index: Index,
    queries: DataFrame,
    strategies: Sequence[str] = ("hybrid",),
    ks: Sequence[int] = (fv.TOP_K,),
    keep: Sequence[str] = CHUNK_COLUMNS,
    **options,
) -> DataFrame:
    """Hits of all strategies at all K: ``strategy, k, query_id, rank, …, score, dense_rank, sparse_rank``.

    Each pass of queries scans the chunks once, for the rankings that the strategies need. If ``keep`` names texts, one
    more scan fetches those of all passes' hits. ``options`` go to :func:`rank_chunks` and
    :func:`rank_strategies`.
    """
    selected = check_strategies(strategies)
    ks = sorted(set(ks))
    for k in ks:
        check_top_k(k)
    hybrid = "hybrid" in selected
    rankings = [r for r in ("dense", "bm25") if hybrid or r in selected]
    depth = candidate_count(max(ks)) if hybrid else max(ks)
    fusion = {"rrf_k": fv.RRF_K, "dense_weight": 1.0, "sparse_weight": 1.0}
    fusion = {name: options.pop(name, default) for name, default in fusion.items()}
    narrow = tuple(c for c in dict.fromkeys(("chunk_id", *keep)) if c != "text")

    ranked, passes = _rank_index(index, queries, rankings, depth, narrow, **options)
    hits = _fused(ranked, selected, ks, **fusion)
    if "text" in keep:
        hits = _with_text(hits, index.chunks, passes)
    ordered = ["strategy", "k", "query_id", "rank", *dict.fromkeys(("chunk_id", *keep))]
    return hits.select(*ordered, "metadata", "score", "dense_rank", "sparse_rank")
