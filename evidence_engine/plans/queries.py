"""Every operator as a query over the given tables."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from evidence_engine import fixed_values as fv
from evidence_engine.functions import text as tx
from evidence_engine.functions.chunk_windows import chunk_params_problem, chunk_windows
from evidence_engine.operators import answers, chunking, evaluation, index, reports, retrieval, scoring, vectors
from evidence_engine.operators.store import ChunkStore
from evidence_engine.sources import cases as case_source, driver_tables as given, files
from evidence_engine.sources.scratch import materialize, scratch_path, spread

KS = fv.EVALUATION_KS
ABLATION_SIZES = (300, 500, 800)
NARROW = {"keep": ("source",)}  # columns that tasks need not carry along
HIT_COLUMNS = ("strategy", "k", "query_id", "rank", "chunk_id", "source", "dense_rank", "sparse_rank")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(given.documents(spark, sf_dir))


def tokens_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_tokens(chunks_of(spark, sf_dir))


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.prepare_queries(given.questions(spark, sf_dir))


def flat(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        "chunk_id",
        "document_id",
        "source",
        "text",
        "start_char",
        "end_char",
        F.col("metadata.chunk_index").alias("chunk_index"),
    )


def found(spark, sf_dir, strategies=("hybrid",), ks=(fv.TOP_K,), keep=retrieval.CHUNK_COLUMNS, **options):
    """Hits over the written index."""
    corpus = given.corpus_index(spark, sf_dir)
    return retrieval.search(corpus, prepared(spark, sf_dir), strategies, ks, keep, **options)


def shown(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS, F.round("score", 6).alias("score"))


# Sources and sinks


def scan_files(spark, sf_dir):
    """Documents written out as text files, found again, decoded; occurrences of every line."""
    path = scratch_path(spark, "files")
    spread(given.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("text").write.text(path)
    lines = files.scan_files(spark, path).select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.where("line <> ''").groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))


def filter_supported(spark, sf_dir):
    """File names made of document ids with different suffixes."""
    endings = F.array(*map(F.lit, (".txt", ".MD", ".pdf", ".png", "", ".txt.gz", ".")))
    ending = F.get(endings, (F.col("doc_id") % 7).cast("int"))
    named = given.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path")
    )
    return files.filter_supported(named)


def scan_rejects(spark, sf_dir):
    """What a scan would leave out of files named after documents, and why."""
    endings = F.array(*map(F.lit, (".txt", ".MD", ".PDF", ".png", "", ".txt.gz", ".")))
    ending = F.get(endings, (F.col("doc_id") % 7).cast("int"))
    named = given.table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), ending).alias("path")
    )
    return files.reject_files(named)


def decode_text(spark, sf_dir):
    raw = given.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return files.decode_text(raw).select("doc_id", "text", "undecodable")


def assemble_pages(spark, sf_dir):
    pages = given.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return files.assemble_pages(pages, "conv_id", "turn")


def scan_cases(spark, sf_dir):
    """Cases written as JSON lines and read back with validation."""
    path = scratch_path(spark, "cases")
    rows = given.cases(spark, sf_dir).select(
        F.concat(F.lit("item-"), F.col("case_id").cast("string")).alias("id"),
        "category",
        "question",
        F.when(F.col("should_answer"), F.array(F.lit(" somewhere.md "))).otherwise(F.array()).alias("relevant_sources"),
        "should_answer",
    )
    rows.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return case_source.load_cases(spark, path).select(
        "case_id", "category", "question", F.array_join("relevant_sources", ",").alias("sources"), "should_answer"
    )


def validate_cases(spark, sf_dir):
    """Faulty and sound JSON lines made of the benchmark items; their complaints."""
    item = F.col("item_id")
    question = F.to_json(F.struct(F.col("text").alias("question")))
    bare = F.substring(question, F.lit(2), F.length(question) - 2)
    line = (
        F.when(item % 6 == 0, F.concat(F.lit("{"), bare, F.lit(', "relevant_sources": ["a.md", " b.md "]}')))
        .when(item % 6 == 1, F.concat(F.lit("{"), bare))
        .when(item % 6 == 2, F.concat(F.lit("["), question, F.lit("]")))
        .when(item % 6 == 3, F.lit('{"id": "x", "question": "  "}'))
        .when(item % 6 == 4, F.concat(F.lit("{"), bare, F.lit(', "relevant_sources": ["a.md", 7]}')))
        .otherwise(F.concat(F.lit("{"), bare, F.lit(', "should_answer": "no", "relevant_sources": []}')))
    )
    lines = given.table(spark, sf_dir, "benchmark").select(item.alias("line_number"), line.alias("line"))
    return case_source.validate_cases(lines).select("line_number", "case_id", "category", "error")


def save_chunks(spark, sf_dir):
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.replace_documents(chunks_of(spark, sf_dir))
    return flat(store.load())


def load_chunks(spark, sf_dir):
    """A pinned version stays as it was, whatever is deleted later."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    saved = store.replace_documents(chunks_of(spark, sf_dir))
    short = store.load().groupBy("document_id").count().where("count < 4").select("document_id")
    store.delete_documents(short)
    before = flat(store.load(saved)).withColumn("state", F.lit("before"))
    return before.unionByName(flat(store.load()).withColumn("state", F.lit("after")))


def validate_chunk_params(spark, sf_dir):
    """Chunk settings made of the parts' sizes and keys, and what is wrong with them."""
    size, overlap = F.col("p_size") * 10, (F.col("p_partkey") % 500 - 50).cast("int")
    settings = given.table(spark, sf_dir, "part").select("p_partkey", size.alias("size"), overlap.alias("overlap"))
    return settings.withColumn("problem", chunk_params_problem(F.col("size"), F.col("overlap")))


def write_report(spark, sf_dir):
    path = scratch_path(spark, "report")
    reports.write_report({"results": eval_metrics(spark, sf_dir)}, path)
    schema = "strategy string, k int, evaluated_case_count bigint, " + ", ".join(f"{m} double" for m in evaluation.METRICS)
    return spark.read.schema(schema).json(f"{path}/results")


# Text preparation


def strip_text(spark, sf_dir):
    """Turns framed by Unicode blanks, stripped again."""
    frame = F.lit(fv.WHITESPACE)
    turns = given.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", tx.strip(F.concat(frame, "text", frame)).alias("text"))


def normalize_text(spark, sf_dir):
    """Turns joined by line ends and blanks of all kinds, normalized."""
    turns = given.table(spark, sf_dir, "conversations")
    messy = F.concat("role", F.lit("\r\n\r\n\r\n"), "text", F.lit(" \t\t \r"), "text", F.lit("\n \n \n"), "role")
    return turns.select("conv_id", "turn", tx.normalize(messy).alias("text"))


def document_id(spark, sf_dir):
    return given.documents(spark, sf_dir).select("document_id", "source", F.length("text").alias("n_chars"))


def chunk_id(spark, sf_dir):
    return flat(chunks_of(spark, sf_dir)).select("chunk_id", "source", "chunk_index")


def dedupe_documents(spark, sf_dir):
    """Plain sources: equal text under one source is one document, last position wins."""
    raw = given.table(spark, sf_dir, "documents").select(
        "source", "text", F.lpad(F.col("doc_id").cast("string"), 19, "0").alias("doc_ord")
    )
    return chunking.dedupe_documents(chunking.identify_documents(raw)).select("document_id", "source", "doc_ord")


def blank_query_guard(spark, sf_dir):
    """Every question, and a blank one beside each; only the former get through."""
    asked = given.questions(spark, sf_dir)
    blank = asked.select((-1 - F.col("query_id")).alias("query_id"), F.lit(" 　\n").alias("question"))
    both = asked.unionByName(blank)
    passed = retrieval.prepare_queries(both).select("query_id", "searched", F.lit("").alias("reason"))
    rejected = retrieval.blank_queries(both).select("query_id", F.lit("").alias("searched"), "reason")
    return passed.unionByName(rejected)


def chunk_documents(spark, sf_dir):
    return flat(chunks_of(spark, sf_dir))


def preferred_end(spark, sf_dir):
    """Where every window ends that is not the last of its document."""
    normalized = given.documents(spark, sf_dir).select("document_id", tx.normalize(F.col("text")).alias("text"))
    windows = normalized.select("document_id", F.length("text").alias("n"), F.inline(chunk_windows(F.col("text"))))
    inner = windows.where(F.col("start") + fv.CHUNK_SIZE < F.col("n"))
    return inner.select("document_id", F.col("start").alias("start_char"), F.col("end").alias("end_char"))


def tokenize(spark, sf_dir):
    return tokens_of(spark, sf_dir).select("chunk_id", F.posexplode("tokens").alias("position", "token"))


# Aggregations


def term_frequency(spark, sf_dir):
    return index.term_frequency(tokens_of(spark, sf_dir))


def document_frequency(spark, sf_dir):
    return index.document_frequency(tokens_of(spark, sf_dir))


def chunk_length(spark, sf_dir):
    return index.chunk_length(tokens_of(spark, sf_dir))


def corpus_stats(spark, sf_dir):
    stats = index.corpus_stats(tokens_of(spark, sf_dir))
    return stats.select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def index_corpus(spark, sf_dir):
    """The written index: document frequencies with the corpus statistics beside them."""
    written = given.corpus_index(spark, sf_dir)
    n_chunks, avg_len = written.stats.select("n_chunks").scalar(), written.stats.select("avg_len").scalar()
    return written.doc_freq.select(
        "term", "df", n_chunks.alias("n_chunks"), F.round(avg_len, 6).alias("avg_len")
    )


def list_documents(spark, sf_dir):
    return chunking.list_documents(chunks_of(spark, sf_dir))


def category_counts(spark, sf_dir):
    return reports.category_counts(given.cases(spark, sf_dir))


def dataset_summary(spark, sf_dir):
    return reports.dataset_summary(
        given.documents(spark, sf_dir),
        given.corpus_index(spark, sf_dir).chunks,
        given.cases(spark, sf_dir),
        given.relevance(spark, sf_dir),
    )


# Retrieval


def hash_embed(spark, sf_dir):
    embedded = vectors.hash_embed(given.corpus_index(spark, sf_dir).chunks)
    return embedded.withColumn("value", F.round("value", 6))


def hash_embed_md5(spark, sf_dir):
    """A second hash family, for engines that lack BLAKE2b."""
    embedded = vectors.hash_embed(given.corpus_index(spark, sf_dir).chunks, family="md5")
    return embedded.withColumn("value", F.round("value", 6))


def cosine(spark, sf_dir):
    """Every vector against the mean of its label."""
    means = given.centroids(spark, sf_dir).select(F.col("query_id").alias("label"), F.col("vector").alias("mean"))
    pairs = given.table(spark, sf_dir, "embeddings").join(means, "label")
    return pairs.select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("mean")), 6).alias("score"))


def dense_topk(spark, sf_dir):
    return shown(found(spark, sf_dir, ("dense",), **NARROW))


def dense_topk_md5(spark, sf_dir):
    return shown(found(spark, sf_dir, ("dense",), family="md5", **NARROW))


def dense_topk_odd_dimension(spark, sf_dir):
    """Seven buckets: signs cancel within a bucket and cosines may be negative."""
    return shown(found(spark, sf_dir, ("dense",), dimension=7, **NARROW))


def external_hits(spark, sf_dir):
    keep = ("chunk_id", "source")
    ranked = retrieval.rank_vectors(given.vectors(spark, sf_dir), given.centroids(spark, sf_dir), max(KS), keep)
    return retrieval.rank_strategies(ranked, ("dense",), KS)


def dense_topk_external(spark, sf_dir):
    return shown(external_hits(spark, sf_dir)).select("k", "query_id", "rank", "chunk_id", "source", "score")


def external_metrics(spark, sf_dir):
    """User vectors through the evaluator: a label's mean should find vectors of that label."""
    labels = given.centroids(spark, sf_dir).select(F.col("query_id").alias("case_id"))
    wanted = labels.select("case_id", F.concat(F.lit("label-"), F.col("case_id").cast("string")).alias("source"))
    asked = labels.withColumn("should_answer", F.lit(True))
    return evaluation.eval_metrics(
        evaluation.score_cases(asked, wanted, external_hits(spark, sf_dir), ("dense",), KS)
    )


def bm25_topk(spark, sf_dir):
    return shown(found(spark, sf_dir, ("bm25",), **NARROW))


def bm25_postings(spark, sf_dir):
    """The same ranking from the written postings, without a look at the chunks' tokens."""
    return shown(found(spark, sf_dir, ("bm25",), bm25_from="postings", **NARROW))


def hash_embed_written(spark, sf_dir):
    """The vectors that the written index holds."""
    chunks = given.corpus_index(spark, sf_dir).chunks
    entries = F.arrays_zip("hashed.bucket", "hashed.count")
    rows = chunks.select("chunk_id", F.col("hashed.norm").alias("norm"), F.explode(entries).alias("e"))
    return rows.select(
        "chunk_id", "e.bucket", F.col("e.count").cast("long").alias("count"), F.round(F.col("e.count") / F.col("norm"), 6).alias("value")
    )


def bm25_score(spark, sf_dir):
    """BM25 scores of what the dense ranking found."""
    pairs = found(spark, sf_dir, ("dense",), keep=("chunk_id",))
    scores = scoring.bm25_score(given.corpus_index(spark, sf_dir), prepared(spark, sf_dir), pairs)
    return scores.withColumn("score", F.round("score", 6))


def rrf_fuse(spark, sf_dir):
    return shown(found(spark, sf_dir, ("hybrid",), **NARROW))


def rrf_fuse_weighted(spark, sf_dir):
    return shown(found(spark, sf_dir, ("hybrid",), rrf_k=10, dense_weight=0.25, sparse_weight=2.0, **NARROW))


def strategy_search(spark, sf_dir):
    return shown(found(spark, sf_dir, fv.STRATEGIES, KS, **NARROW))


def hybrid_search(spark, sf_dir):
    """The default search, with what is shown of a hit."""
    hits = found(spark, sf_dir)
    return hits.select("query_id", "rank", *retrieval.CHUNK_COLUMNS, F.round("score", 6).alias("score"))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text):
    """A stand-in for a user's embedding model: how often each letter occurs, counted in one pass over a batch's bytes."""
    letters = LETTERS

    @F.arrow_udf("array<double>")
    def count(texts: pa.Array) -> pa.Array:
        number = np.full(256, len(letters))
        for spelled in (letters, letters.upper()):
            number[list(spelled.encode())] = np.arange(len(letters))
        counts = []
        for found in texts.cast(pa.large_binary()).to_pylist():
            counts.append(np.bincount(number[np.frombuffer(found or b"", np.uint8)], minlength=len(letters) + 1)[:-1])
        values = np.concatenate(counts).astype(np.float64) if counts else np.zeros(0)
        ends = np.arange(0, len(values) + 1, len(letters), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return count(text)


def hybrid_external(spark, sf_dir):
    """Hybrid search with a user's embedding in place of hashing."""
    corpus, asked = retrieval.embed(given.corpus_index(spark, sf_dir), prepared(spark, sf_dir), letter_counts)
    return shown(retrieval.search(corpus, asked, embedding="vectors", **NARROW))


def citation_projection(spark, sf_dir):
    return answers.citation_projection(found(spark, sf_dir)).select("*", "metadata.chunk_index").drop("metadata")


# Store


def ingest_documents(spark, sf_dir):
    store = ChunkStore(spark, scratch_path(spark, "store"))
    return store.ingest(given.raw_documents(spark, sf_dir).select("source", "text"))


def replace_document(spark, sf_dir):
    """Ingest everything, then the English documents again: the same chunks, those at the end."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.ingest(given.raw_documents(spark, sf_dir).select("source", "text"))
    store.ingest(given.raw_documents(spark, sf_dir, "lang = 'en'").select("source", "text"))
    return store.load().select("chunk_id", "source", F.substring("doc_ord", 1, 19).cast("bigint").alias("ingested_by"))


def delete_document(spark, sf_dir):
    """Ingest everything, delete the English documents, list the rest."""
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.ingest(given.raw_documents(spark, sf_dir).select("source", "text"))
    english = given.raw_documents(spark, sf_dir, "lang = 'en'").select("source", "text")
    store.delete_documents(chunking.identify_documents(english).select("document_id"))
    return store.list_documents()


def ingest_stream(spark, sf_dir):
    """The documents as a stream of uploads into a store."""
    from evidence_engine.streaming.ingest import ingest_stream as start

    incoming = given.stream(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 19, "0"))
    target = scratch_path(spark, "store")
    uploads = incoming.select(path.alias("source"), "text")
    query = start(uploads, target, scratch_path(spark, "stream"))
    query.awaitTermination()
    return ChunkStore(spark, target).list_documents()


def search_after_changes(spark, sf_dir):
    """Ingest everything, the English documents again, delete the German ones; then search.

    The store's statistics are sums over these changes, and English documents now come last.
    """
    store = ChunkStore(spark, scratch_path(spark, "store"))
    store.ingest(given.raw_documents(spark, sf_dir).select("source", "text"))
    store.ingest(given.raw_documents(spark, sf_dir, "lang = 'en'").select("source", "text"))
    german = given.raw_documents(spark, sf_dir, "lang = 'de'").select("source", "text")
    store.delete_documents(chunking.identify_documents(german).select("document_id"))
    return shown(retrieval.search(store.index(), prepared(spark, sf_dir), **NARROW))


# Answers


def extractive_answer(spark, sf_dir):
    return answers.extractive_answer(given.questions(spark, sf_dir), found(spark, sf_dir)).select("query_id", "answer")


def build_context(spark, sf_dir):
    return answers.build_context(found(spark, sf_dir)).select("query_id", "context")


def prompt_table(spark, sf_dir):
    return answers.prompt_table(given.questions(spark, sf_dir), found(spark, sf_dir)).drop("strategy", "k")


def answer_queries(spark, sf_dir):
    """Answers with one row per citation."""
    answered = answers.answer_queries(given.questions(spark, sf_dir), found(spark, sf_dir))
    cited = answered.select("query_id", "question", "answer", F.posexplode_outer("citations").alias("n", "c"))
    columns = ("query_id", "question", "answer", (F.col("n") + 1).alias("citation_no"))
    return cited.select(*columns, "c.*", "c.metadata.chunk_index").drop("metadata")


# Evaluation


def evaluated_hits(spark, sf_dir, corpus=None):
    """Only cases that can be answered are searched for."""
    asked = given.cases(spark, sf_dir).where("should_answer")
    prepared_cases = retrieval.prepare_queries(asked.select(F.col("case_id").alias("query_id"), "question"))
    corpus = corpus or given.corpus_index(spark, sf_dir)
    return retrieval.search(corpus, prepared_cases, fv.STRATEGIES, KS, ("source",))


def case_scores(spark, sf_dir):
    return evaluation.score_cases(
        given.cases(spark, sf_dir),
        given.relevance(spark, sf_dir).select("case_id", "source"),
        evaluated_hits(spark, sf_dir),
        fv.STRATEGIES,
        KS,
    )


def _case_metric(column):
    def query(spark, sf_dir):
        return case_scores(spark, sf_dir).select("strategy", "k", "case_id", F.round(column, 6).alias(column))

    return query


def duplicate_case_ids(spark, sf_dir):
    """Cases named after their category: repeated names."""
    return case_source.duplicate_case_ids(given.cases(spark, sf_dir).select(F.col("category").alias("case_id")))


def missing_sources(spark, sf_dir):
    """Relevant sources against a corpus without its English documents."""
    corpus = given.raw_documents(spark, sf_dir, "lang <> 'en'")
    return evaluation.missing_sources(given.relevance(spark, sf_dir), corpus)


def split_answerable(spark, sf_dir):
    return evaluation.case_counts(given.cases(spark, sf_dir), given.relevance(spark, sf_dir))


def eval_details(spark, sf_dir):
    # The hits are used for the scores and for the list of sources: search once.
    hits = materialize(evaluated_hits(spark, sf_dir), "hits")
    wanted = given.relevance(spark, sf_dir).select("case_id", "source")
    expected = wanted.groupBy("case_id").agg(F.array_sort(F.collect_set("source")).alias("relevant_sources"))
    cases = given.cases(spark, sf_dir).join(expected, "case_id", "left")
    scores = evaluation.score_cases(cases, wanted, hits, fv.STRATEGIES, KS)
    details = evaluation.eval_details(scores, cases, hits)
    return details.withColumns({c: F.array_join(c, ",") for c in ("retrieved", "expected")})


def eval_metrics(spark, sf_dir):
    return evaluation.eval_metrics(case_scores(spark, sf_dir))


def compare_strategies(spark, sf_dir):
    """Metrics of every strategy at every K, in order."""
    return eval_metrics(spark, sf_dir).orderBy("strategy", "k")


def dataset_warnings(spark, sf_dir):
    return reports.dataset_warnings(dataset_summary(spark, sf_dir))


def indistinguishable_warning(spark, sf_dir):
    """For every pair of strategies, also of one with itself: whether the metrics tell them apart."""
    metrics = materialize(eval_metrics(spark, sf_dir), "metrics")
    tables = []
    for number, left in enumerate(fv.STRATEGIES):
        for right in fv.STRATEGIES[number:]:
            one = metrics.where(F.col("strategy") == left)
            other = metrics.where(F.col("strategy") == right).withColumn("strategy", F.lit("other"))
            outcome = reports.indistinguishable(one.unionByName(other))
            tables.append(outcome.select(F.lit(f"{left}-{right}").alias("pair"), "applies"))
    return reduce(DataFrame.unionByName, tables)


def report_tables(spark, sf_dir):
    """All report tables as rows of ``section, item, k, metric, value, label``."""
    metrics = materialize(eval_metrics(spark, sf_dir), "metrics")
    summary = materialize(dataset_summary(spark, sf_dir), "summary")
    configuration = reports.configuration_table(
        spark,
        embedding="hashing",
        chunk_size=fv.CHUNK_SIZE,
        chunk_overlap=fv.CHUNK_OVERLAP,
        ks=KS,
        documents="documents",
        questions="benchmark",
    )
    no_value, no_label = F.lit(None).cast("double"), F.lit(None).cast("string")
    results = metrics.unpivot(
        ["strategy", "k"], [*evaluation.METRICS], "metric", "value"
    ).select(F.lit("results").alias("section"), F.col("strategy").alias("item"), "k", "metric", "value", no_label.alias("label"))
    counts = summary.unpivot([], summary.columns, "item", "value")
    categories = category_counts(spark, sf_dir).select(F.concat(F.lit("category "), "category").alias("item"), F.col("case_count").alias("value"))
    dataset = counts.unionByName(categories).select(
        F.lit("dataset").alias("section"),
        "item",
        F.lit(None).cast("int").alias("k"),
        F.lit("count").alias("metric"),
        F.col("value").cast("double").alias("value"),
        no_label.alias("label"),
    )

    def labels(table, section, item, label):
        return table.select(
            F.lit(section).alias("section"),
            item.alias("item"),
            F.lit(None).cast("int").alias("k"),
            no_label.alias("metric"),
            no_value.alias("value"),
            label.alias("label"),
        )

    warned = reports.all_warnings(summary, metrics)
    return (
        results.unionByName(dataset)
        .unionByName(labels(configuration, "configuration", F.col("setting"), F.col("value")))
        .unionByName(labels(warned, "warnings", F.col("warning_no").cast("string"), F.col("warning")))
    )


def chunk_ablation(spark, sf_dir):
    """The same evaluation under several chunk sizes, each searched once and so not written."""
    cases, wanted = given.cases(spark, sf_dir), given.relevance(spark, sf_dir).select("case_id", "source")
    tables = []
    for size in ABLATION_SIZES:
        corpus = given.scanned_corpus(spark, sf_dir, size)
        hits = evaluated_hits(spark, sf_dir, corpus)
        metrics = evaluation.eval_metrics(evaluation.score_cases(cases, wanted, hits, fv.STRATEGIES, KS))
        tables.append(metrics.withColumn("chunk_size", F.lit(size)))
    return reduce(DataFrame.unionByName, tables)


QUERIES = {
    q.__name__: q
    for q in (
        scan_files,
        scan_rejects,
        filter_supported,
        decode_text,
        assemble_pages,
        scan_cases,
        validate_cases,
        save_chunks,
        load_chunks,
        validate_chunk_params,
        write_report,
        strip_text,
        normalize_text,
        document_id,
        chunk_id,
        dedupe_documents,
        blank_query_guard,
        chunk_documents,
        preferred_end,
        tokenize,
        term_frequency,
        document_frequency,
        chunk_length,
        corpus_stats,
        index_corpus,
        list_documents,
        category_counts,
        dataset_summary,
        hash_embed,
        hash_embed_md5,
        hash_embed_written,
        cosine,
        dense_topk,
        dense_topk_md5,
        dense_topk_odd_dimension,
        dense_topk_external,
        external_metrics,
        bm25_topk,
        bm25_postings,
        bm25_score,
        rrf_fuse,
        rrf_fuse_weighted,
        strategy_search,
        hybrid_search,
        hybrid_external,
        citation_projection,
        ingest_documents,
        replace_document,
        delete_document,
        ingest_stream,
        search_after_changes,
        extractive_answer,
        build_context,
        prompt_table,
        answer_queries,
        duplicate_case_ids,
        missing_sources,
        split_answerable,
        eval_details,
        eval_metrics,
        compare_strategies,
        dataset_warnings,
        indistinguishable_warning,
        report_tables,
        chunk_ablation,
    )
}
QUERIES.update(
    hit_at_k=_case_metric("hit"),
    recall_at_k=_case_metric("recall"),
    reciprocal_rank=_case_metric("reciprocal_rank"),
    ndcg_at_k=_case_metric("ndcg"),
)
