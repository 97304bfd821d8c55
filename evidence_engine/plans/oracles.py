"""The same results in plain SQL, for checking. Written independently of the Spark plans: chunks
come from a recursive query, rankings from scoring every query-chunk pair."""

from __future__ import annotations

from evidence_engine import fixed_values as fv
from evidence_engine.plans.blake2b_sql import blake2b_ctes

KS = fv.EVALUATION_KS
WS = "'" + fv.WHITESPACE + "'"
NL = "chr(10)"
LATIN = "[a-zA-Z0-9_+#.-]+"
IDEOGRAPH = r"[\x{4e00}-\x{9fff}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def norm(text: str) -> str:
    lines = f"replace(replace({text}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    squeezed = f"regexp_replace({lines}, '[ \\t]+', ' ', 'g')"
    return f"trim(regexp_replace({squeezed}, '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


def tokens(text: str) -> str:
    base = f"list_transform(regexp_extract_all({text}, '{LATIN}|{IDEOGRAPH}'), lambda t: lower(t))"
    signs = f"regexp_extract_all({text}, '{IDEOGRAPH}')"
    pairs = f"list_transform(range(1, len({signs})), lambda i: {signs}[i] || {signs}[i + 1])"
    return f"list_concat({base}, {pairs})"


def round_exact(x: str, decimals: int) -> str:
    """Half to even on the binary value, by an error-free product."""
    s = f"{10**decimals}::DOUBLE"
    high = f"({x} * 134217729.0::DOUBLE - ({x} * 134217729.0::DOUBLE - {x}))"
    p = f"({x} * {s})"
    err = f"(({high} * {s} - {p}) + ({x} - {high}) * {s})"
    away = f"(({p} - floor({p}) - 0.5::DOUBLE) + {err})"
    up = f"CASE WHEN {away} > 0 OR ({away} = 0 AND floor({p}) % 2 <> 0) THEN 1 ELSE 0 END"
    return f"((floor({p}) + {up}) / {s})"


DOCS = f"""
raw AS (SELECT doc_id, lang, source || '/' || lpad(doc_id::VARCHAR, 19, '0') AS source, text FROM documents),
docs AS (
  SELECT doc_id, lang, source, trim(text, {WS}) AS text, replace(source, '/', chr(0)) AS doc_ord,
         left(sha1(source || chr(0) || trim(text, {WS})), 16) AS document_id
  FROM raw WHERE trim(text, {WS}) <> '')"""


def chunks(size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP, tag: str = "", docs: str = "docs") -> str:
    off = int(size * fv.BREAK_SEARCH_FROM)
    return f"""
norm{tag} AS (SELECT document_id, source, doc_ord, {norm('text')} AS t FROM {docs}),
spans{tag}(document_id, t, n, s, e) AS (
  SELECT document_id, t, length(t), 0, 0 FROM norm{tag} WHERE t <> ''
  UNION ALL
  SELECT document_id, t, n, s2,
         CASE WHEN s2 + {size} >= n THEN n
              WHEN brk > 0 THEN s2 + {off} + brk ELSE s2 + {size} END
  FROM (SELECT *, length(regexp_extract(substring(t, s2 + {off} + 1, {size - off}), '(?s)^.*[\\n。！？；]')) AS brk
        FROM (SELECT document_id, t, n, CASE WHEN e = 0 THEN 0 ELSE greatest(e - {overlap}, s + 1) END AS s2
              FROM spans{tag} WHERE e < n))),
chunks{tag} AS (
  SELECT left(sha1(document_id || ':' || chunk_index || ':' || s || ':' || e), 16) AS chunk_id,
         document_id, source, text, s::INTEGER AS start_char, e::INTEGER AS end_char,
         chunk_index::INTEGER AS chunk_index, doc_ord
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY s) - 1 AS chunk_index
        FROM (SELECT document_id, s, e, trim(substring(t, s + 1, e - s), {WS}) AS text FROM spans{tag} WHERE e > 0)
        WHERE text <> '') JOIN (SELECT document_id, source, doc_ord FROM norm{tag}) USING (document_id)),
toks{tag} AS (SELECT *, {tokens('text')} AS tokens FROM chunks{tag})"""


def index(tag: str = "") -> str:
    return f"""
postings{tag} AS (
  SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS term FROM toks{tag}) GROUP BY ALL),
doc_freq{tag} AS (SELECT term, count(*) AS df FROM postings{tag} GROUP BY term),
stats{tag} AS (SELECT count(*) AS n_chunks, avg(len(tokens)) AS avg_len FROM toks{tag})"""


QUESTIONS = f"""
asked AS (SELECT item_id AS query_id, text AS question, trim(text, {WS}) AS searched FROM benchmark),
queries AS (SELECT *, {tokens('searched')} AS tokens FROM asked WHERE searched <> ''),
query_terms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM queries) GROUP BY ALL)"""


def bm25(tag: str = "") -> str:
    k1, b = fv.BM25_K1, fv.BM25_B
    return f"""
bm25_scores{tag} AS (
  SELECT query_id, chunk_id, round(sum(
      qtf * ln(1 + (n_chunks - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * {k1 + 1}::DOUBLE
      / (tf + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * len(tokens) / avg_len))), 9) AS score
  FROM query_terms JOIN postings{tag} USING (term) JOIN doc_freq{tag} USING (term)
       JOIN (SELECT chunk_id, tokens FROM toks{tag}) USING (chunk_id), stats{tag}
  GROUP BY ALL),
bm25_ranked{tag} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
         ORDER BY score DESC, doc_ord, chunk_index) AS rank
  FROM bm25_scores{tag} JOIN chunks{tag} USING (chunk_id) WHERE score > 0)"""


def hashed(dimension: int, hashes: str, tag: str = "") -> str:
    return f"""
placed{tag} AS (
  SELECT term, (h % {dimension})::INTEGER AS bucket, CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END AS sign FROM ({hashes})),
chunk_vectors{tag} AS (
  SELECT * FROM (SELECT chunk_id, bucket, sum(tf * sign)::BIGINT AS n
                 FROM postings{tag} JOIN placed{tag} USING (term) GROUP BY ALL) WHERE n <> 0),
query_vectors{tag} AS (
  SELECT * FROM (SELECT query_id, bucket, sum(qtf * sign)::BIGINT AS n
                 FROM query_terms JOIN placed{tag} USING (term) GROUP BY ALL) WHERE n <> 0),
{cosines(tag)}"""


def cosines(tag: str = "") -> str:
    """Every chunk against every query, from counts per dimension."""
    return f"""
chunk_norms{tag} AS (SELECT chunk_id, sqrt(sum(n * n)::DOUBLE) AS length FROM chunk_vectors{tag} GROUP BY ALL),
query_norms{tag} AS (SELECT query_id, sqrt(sum(n * n)::DOUBLE) AS length FROM query_vectors{tag} GROUP BY ALL),
dots{tag} AS (
  SELECT query_id, chunk_id, sum(q.n * c.n)::DOUBLE AS dot
  FROM query_vectors{tag} q JOIN chunk_vectors{tag} c USING (bucket) GROUP BY ALL),
dense_scores{tag} AS (
  SELECT query_id, chunk_id, doc_ord, chunk_index, round(coalesce(dot, 0) / (coalesce(qn.length, 1) * coalesce(cn.length, 1)), 9) AS score
  FROM queries CROSS JOIN (SELECT chunk_id, doc_ord, chunk_index FROM chunks{tag})
       LEFT JOIN dots{tag} USING (query_id, chunk_id)
       LEFT JOIN query_norms{tag} qn USING (query_id) LEFT JOIN chunk_norms{tag} cn USING (chunk_id)),
dense_ranked{tag} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id
         ORDER BY score DESC, doc_ord, chunk_index) AS rank FROM dense_scores{tag})"""


def all_terms(*tags: str) -> str:
    return " UNION ".join([f"SELECT term FROM doc_freq{tag}" for tag in tags] + ["SELECT term FROM query_terms"])


MD5 = f"SELECT term, ('0x' || substr(md5(term), 1, 15))::BIGINT AS h FROM ({all_terms('')})"
BLAKE2B = "SELECT term, h FROM blake2b"


def hits(strategies=fv.STRATEGIES, ks=KS, tag: str = "", rrf_k=fv.RRF_K, dense_weight=1.0, sparse_weight=1.0) -> str:
    ks_rows = ", ".join(f"({k}, {max(fv.CANDIDATE_FACTOR * k, fv.CANDIDATE_MINIMUM)})" for k in ks)
    parts = []
    for strategy, own, other in (("dense", "rank", "NULL"), ("bm25", "NULL", "rank")):
        if strategy in strategies:
            parts.append(
                f"SELECT '{strategy}' AS strategy, k, query_id, rank, chunk_id, score, {own} AS dense_rank, "
                f"{other} AS sparse_rank FROM {strategy}_ranked{tag}, cutoffs{tag} WHERE rank <= k"
            )
    if "hybrid" in strategies:
        parts.append(f"""SELECT * FROM (
      SELECT 'hybrid' AS strategy, k, query_id, row_number() OVER (PARTITION BY k, query_id
               ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) AS rank,
             chunk_id, score, dense_rank, sparse_rank
      FROM (SELECT k, query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank,
                   coalesce({dense_weight}::DOUBLE / ({rrf_k} + d.rank), 0)
                   + coalesce({sparse_weight}::DOUBLE / ({rrf_k} + s.rank), 0) AS score
            FROM (SELECT * FROM dense_ranked{tag}, cutoffs{tag} WHERE rank <= depth) d
            FULL JOIN (SELECT * FROM bm25_ranked{tag}, cutoffs{tag} WHERE rank <= depth) s
            USING (k, query_id, chunk_id))) WHERE rank <= k""")
    union = "\n  UNION ALL\n  ".join(parts)
    return f"""
cutoffs{tag}(k, depth) AS (VALUES {ks_rows}),
hits{tag} AS (
  SELECT strategy, k::INTEGER AS k, query_id, rank::INTEGER AS rank, chunk_id, document_id, source, text,
         chunk_index, score, dense_rank::INTEGER AS dense_rank, sparse_rank::INTEGER AS sparse_rank
  FROM ({union}) JOIN (SELECT chunk_id, document_id, source, text, chunk_index FROM chunks{tag}) USING (chunk_id))"""


def ranking(strategies, ks, dimension=fv.HASH_DIMENSION, hashes=BLAKE2B, tag="", **fusion) -> str:
    """From an index and hashed terms to hits."""
    parts = []
    if set(strategies) != {"dense"}:
        parts.append(bm25(tag))
    if set(strategies) != {"bm25"}:
        parts.append(hashed(dimension, hashes, tag))
    return ",".join([*parts, hits(strategies, ks, tag, **fusion)])


def retrieval(strategies=fv.STRATEGIES, ks=KS, hashes=BLAKE2B, **options) -> str:
    """All steps from documents to hits."""
    parts = [chunks(), index()]
    if hashes == BLAKE2B and set(strategies) != {"bm25"}:
        parts.append(blake2b_ctes(all_terms("")))
    return ",".join([*parts, ranking(strategies, ks, hashes=hashes, **options)])


def query(*ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {','.join(c.strip() for c in ctes)}\n{select}"


SQUEEZED = "' ' || trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g')) || ' '"
CASES = f"""
relevance AS (
  SELECT item_id AS case_id, source, lang, replace(source, '/', chr(0)) AS doc_ord
  FROM (SELECT item_id, {SQUEEZED.format('text')} AS sought FROM benchmark)
  JOIN (SELECT *, {SQUEEZED.format('text')} AS padded FROM raw) ON contains(padded, sought)),
cases AS (
  SELECT item_id AS case_id, coalesce(lang, 'out_of_scope') AS category, text AS question,
         coalesce(n_relevant, 0) AS n_relevant, lang IS NOT NULL AS should_answer
  FROM benchmark LEFT JOIN (
    SELECT case_id AS item_id, arg_min(lang, doc_ord) AS lang, count(*) AS n_relevant FROM relevance GROUP BY ALL)
  USING (item_id))"""


def scores(tag: str = "") -> str:
    return f"""
expected{tag} AS (
  SELECT strategy, k::INTEGER AS k, case_id, n_relevant FROM cases,
         (VALUES {', '.join(f"('{s}')" for s in fv.STRATEGIES)}) s(strategy), (VALUES {', '.join(f'({k})' for k in KS)}) c(k)
  WHERE n_relevant > 0),
firsts{tag} AS (
  SELECT strategy, k, query_id AS case_id, source, min(rank) AS first_rank
  FROM hits{tag} JOIN relevance ON query_id = case_id AND hits{tag}.source = relevance.source GROUP BY ALL),
found{tag} AS (
  SELECT strategy, k, case_id, count(*) AS n_found, min(first_rank) AS best, sum(1 / log2(first_rank + 1)) AS dcg
  FROM (SELECT strategy, k, case_id, f.source, first_rank FROM (
          SELECT strategy, k, query_id AS case_id, h.source, min(rank) AS first_rank
          FROM hits{tag} h JOIN relevance r ON h.query_id = r.case_id AND h.source = r.source GROUP BY ALL) f)
  GROUP BY ALL),
scores{tag} AS (
  SELECT strategy, k, case_id, n_relevant,
         CASE WHEN n_found > 0 THEN 1 ELSE 0 END::DOUBLE AS hit,
         coalesce(n_found / n_relevant, 0)::DOUBLE AS recall,
         coalesce(1 / best, 0)::DOUBLE AS reciprocal_rank,
         coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n_relevant, k) + 1) r(i)), 0)::DOUBLE AS ndcg
  FROM expected{tag} LEFT JOIN found{tag} USING (strategy, k, case_id)),
metrics{tag} AS (
  SELECT strategy, k, evaluated_case_count, {round_exact('a', 4)} AS hit_rate, {round_exact('b', 4)} AS recall,
         {round_exact('c', 4)} AS mrr, {round_exact('d', 4)} AS ndcg
  FROM (SELECT strategy, k, count(*) AS evaluated_case_count, avg(hit) AS a, avg(recall) AS b,
               avg(reciprocal_rank) AS c, avg(ndcg) AS d FROM scores{tag} GROUP BY ALL))"""


HIT_COLUMNS = "strategy, k, query_id, rank, chunk_id, source, dense_rank, sparse_rank, round(score, 6) AS score"
CHUNK_COLUMNS = "chunk_id, document_id, source, text, start_char, end_char, chunk_index"

SUMMARY = """
summary AS (
  SELECT (SELECT count(*) FROM docs) AS document_count, (SELECT count(*) FROM chunks) AS chunk_count,
         count(*) AS case_count, count(*) FILTER (n_relevant > 0) AS answerable_case_count,
         count(*) FILTER (n_relevant = 0) AS unanswerable_case_count FROM cases)"""

SIZE_WARNINGS = "(VALUES " + ", ".join(
    f"({n}, '{column}', {least}, {lit(text)})" for n, (column, least, text) in enumerate(fv.SIZE_WARNINGS, 1)
) + ") w(warning_no, item, least, warning)"
COUNTS = "(UNPIVOT (SELECT document_count, chunk_count, case_count FROM summary) ON COLUMNS(*) INTO NAME item VALUE n)"

CITATION = f"""
cited AS (
  SELECT query_id, rank, chunk_id, document_id, source, text, chunk_index, {round_exact('score', 6)} AS score,
         dense_rank, sparse_rank
  FROM hits)"""
ANSWERS = f"""
answers AS (
  SELECT query_id, question, coalesce(answer, {lit(fv.ANSWER_FALLBACK)}) AS answer
  FROM asked LEFT JOIN (
    SELECT query_id, {lit(fv.ANSWER_LEAD)} || {NL} || {NL} || string_agg(
             left(trim(replace(text, {NL}, ' '), {WS}), {fv.EXCERPT_LENGTH}) || ' [' || rank || ']',
             {NL} || {NL} ORDER BY rank) AS answer
    FROM hits WHERE rank <= {fv.EXCERPT_HITS} GROUP BY query_id) USING (query_id) WHERE searched <> '')"""
CONTEXTS = f"""
contexts AS (
  SELECT query_id, string_agg('[' || rank || '] {fv.CONTEXT_SOURCE_LABEL}' || source || {NL} || text,
                              {NL} || {NL} ORDER BY rank) AS context FROM hits GROUP BY query_id)"""

FIVE = retrieval(("hybrid",), (fv.TOP_K,))
ALL = retrieval()


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(key: str, table: str, text: str) -> str:
    counted = f"length({text}) - length(replace(translate({text}, upper('{LETTERS}'), '{LETTERS}'), substr('{LETTERS}', i, 1), ''))"
    return f"""SELECT * FROM (SELECT {key}, i AS bucket, {counted} AS n
        FROM {table}, range(1, {len(LETTERS) + 1}) r(i)) WHERE n <> 0"""


EXTERNAL = ",".join([
    chunks(),
    index(),
    bm25(),
    f"chunk_vectors AS ({letters('chunk_id', 'chunks', 'text')})",
    f"query_vectors AS ({letters('query_id', 'queries', 'searched')})",
    cosines(),
    hits(("hybrid",), (fv.TOP_K,)),
])


def _search(strategies, ks=(fv.TOP_K,), **options) -> str:
    return query(DOCS, QUESTIONS, retrieval(strategies, ks, **options), select=f"SELECT {HIT_COLUMNS} FROM hits")


def _evaluated(select: str, *more: str) -> str:
    return query(DOCS, QUESTIONS, ALL, CASES, scores(), *more, select=select)


CENTROIDS = """
entries AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT label, i, round(avg(x), 6) AS x FROM entries GROUP BY ALL),
mean_norms AS (SELECT label, coalesce(nullif(sqrt(sum(x * x)), 0), 1) AS length FROM means GROUP BY ALL),
vector_norms AS (SELECT vec_id, coalesce(nullif(sqrt(sum(x * x)), 0), 1) AS length FROM entries GROUP BY ALL),
dots AS (
  SELECT m.label AS query_id, e.vec_id, e.label, sum(m.x * e.x) AS dot FROM means m JOIN entries e USING (i) GROUP BY ALL),
cosines AS (
  SELECT query_id, vec_id, dots.label, dot / (m.length * v.length) AS score
  FROM dots JOIN mean_norms m ON m.label = query_id JOIN vector_norms v USING (vec_id)),
vector_hits AS (
  SELECT k::INTEGER AS k, query_id, rank, chunk_id, source, score FROM (
    SELECT query_id, lpad(vec_id::VARCHAR, 19, '0') AS chunk_id, 'label-' || label AS source, round(score, 9) AS score,
           row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id)::INTEGER AS rank
    FROM cosines), (VALUES (1), (3), (5)) c(k) WHERE rank <= k)"""

_MESSY = "role || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || text || ' ' || chr(9) || chr(9) || ' ' || chr(13) || text || chr(10) || ' ' || chr(10) || ' ' || chr(10) || role"
_TABLE_TOKENS = (DOCS, chunks())
_INDEXED = (DOCS, chunks(), index())

SIZES = (300, 500, 800)


def _embedded(*steps: str) -> str:
    return query(*_INDEXED, QUESTIONS, *steps, select="""
        SELECT chunk_id, bucket, n AS count, round(n / length, 6) AS value
        FROM chunk_vectors JOIN chunk_norms USING (chunk_id)""")


ABLATION = query(
    DOCS,
    QUESTIONS,
    CASES,
    *(part for n in SIZES for part in (chunks(n, fv.CHUNK_OVERLAP, f"_{n}"), index(f"_{n}"))),
    blake2b_ctes(all_terms(*(f"_{n}" for n in SIZES))),
    *(part for n in SIZES for part in (ranking(fv.STRATEGIES, KS, tag=f"_{n}"), scores(f"_{n}"))),
    select=" UNION ALL ".join(f"SELECT *, {n}::INTEGER AS chunk_size FROM metrics_{n}" for n in SIZES),
)

# English documents ingested again, German ones deleted.
CHANGED = (
    DOCS.replace("docs AS (", "all_docs AS (")
    + """,
docs AS (
  SELECT * REPLACE (CASE WHEN lang = 'en' THEN '2' ELSE '1' END || chr(0) || doc_ord AS doc_ord)
  FROM all_docs WHERE lang <> 'de')"""
)

ORACLES = {
    "scan_files": f"""SELECT line, count(*) AS occurrences
        FROM (SELECT unnest(string_split(text, {NL})) AS line FROM documents) WHERE line <> '' GROUP BY line""",
    "filter_supported": """SELECT path FROM (
        SELECT source || '/' || doc_id || ['.txt', '.MD', '.pdf', '.png', '', '.txt.gz', '.'][doc_id % 7 + 1] AS path
        FROM documents) WHERE regexp_matches(path, '(?i)[^/]\\.(txt|md|pdf)$')""",
    "scan_rejects": """SELECT path, CASE WHEN path LIKE '%.PDF' THEN 'PDF files are not parsed: give their pages as a table'
        ELSE 'unsupported file type' END AS reason FROM (
        SELECT source || '/' || doc_id || ['.txt', '.MD', '.PDF', '.png', '', '.txt.gz', '.'][doc_id % 7 + 1] AS path
        FROM documents) WHERE NOT regexp_matches(path, '\\.(txt|MD)$')""",
    "decode_text": "SELECT doc_id, text, false AS undecodable FROM documents",
    "assemble_pages": f"""SELECT conv_id, string_agg(coalesce(text, ''), {NL} || {NL} ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id""",
    "scan_cases": query(DOCS, CASES, select="""SELECT 'item-' || case_id AS case_id, category,
        trim(question, """ + WS + """) AS question, CASE WHEN should_answer THEN 'somewhere.md' ELSE '' END AS sources,
        should_answer FROM cases"""),
    "validate_cases": """SELECT item_id AS line_number,
        CASE WHEN item_id % 6 = 3 THEN 'x' ELSE 'case-' || CASE WHEN item_id > 9999 THEN item_id::VARCHAR
             ELSE lpad(item_id::VARCHAR, 4, '0') END END AS case_id, 'unspecified' AS category,
        'line ' || item_id || ': ' || CASE item_id % 6 WHEN 1 THEN 'not valid JSON' WHEN 2 THEN 'not a JSON object'
             WHEN 3 THEN 'question is missing' WHEN 4 THEN 'relevant_sources must be a list of non-blank strings'
             WHEN 5 THEN 'should_answer must be a boolean' END AS error FROM benchmark""",
    "save_chunks": query(DOCS, chunks(), select=f"SELECT {CHUNK_COLUMNS} FROM chunks"),
    "load_chunks": query(DOCS, chunks(), select=f"""SELECT {CHUNK_COLUMNS}, 'before' AS state FROM chunks
        UNION ALL SELECT {CHUNK_COLUMNS}, 'after' FROM chunks
        WHERE document_id IN (SELECT document_id FROM chunks GROUP BY ALL HAVING count(*) >= 4)"""),
    "validate_chunk_params": """SELECT p_partkey, size, overlap::INTEGER AS overlap,
        CASE WHEN size < 100 THEN 'chunk size must be at least 100'
             WHEN overlap < 0 OR overlap >= size THEN 'overlap must be at least 0 and below the chunk size' END AS problem
        FROM (SELECT p_partkey, p_size * 10 AS size, p_partkey % 500 - 50 AS overlap FROM part)""",
    "write_report": _evaluated("SELECT * FROM metrics"),
    "strip_text": f"SELECT conv_id, turn, trim(text, {WS}) AS text FROM conversations",
    "normalize_text": f"SELECT conv_id, turn, {norm(f'({_MESSY})')} AS text FROM conversations",
    "document_id": query(DOCS, select="SELECT document_id, source, length(text)::INTEGER AS n_chars FROM docs"),
    "chunk_id": query(DOCS, chunks(), select="SELECT chunk_id, source, chunk_index FROM chunks"),
    "dedupe_documents": f"""SELECT left(sha1(source || chr(0) || trim(text, {WS})), 16) AS document_id, source,
        max(lpad(doc_id::VARCHAR, 19, '0')) AS doc_ord FROM documents WHERE trim(text, {WS}) <> ''
        GROUP BY source, trim(text, {WS})""",
    "blank_query_guard": f"""SELECT item_id AS query_id, trim(text, {WS}) AS searched, '' AS reason FROM benchmark
        UNION ALL SELECT -1 - item_id, '', 'blank question' FROM benchmark""",
    "chunk_documents": query(DOCS, chunks(), select=f"SELECT {CHUNK_COLUMNS} FROM chunks"),
    "preferred_end": query(DOCS, chunks(), select=f"""SELECT document_id, s::INTEGER AS start_char, e::INTEGER AS end_char
        FROM spans WHERE e > 0 AND s + {fv.CHUNK_SIZE} < n AND trim(substring(t, s + 1, e - s), {WS}) <> ''"""),
    "tokenize": query(*_TABLE_TOKENS, select="""SELECT chunk_id, (generate_subscripts(tokens, 1) - 1)::INTEGER AS position,
        unnest(tokens) AS token FROM toks"""),
    "term_frequency": query(*_INDEXED, select="SELECT chunk_id, term, tf FROM postings"),
    "document_frequency": query(*_INDEXED, select="SELECT term, df FROM doc_freq"),
    "chunk_length": query(*_TABLE_TOKENS, select="SELECT chunk_id, len(tokens)::BIGINT AS n_tokens FROM toks"),
    "corpus_stats": query(*_INDEXED, select="SELECT n_chunks, round(avg_len, 6) AS avg_len FROM stats"),
    "index_corpus": query(*_INDEXED, select="SELECT term, df, n_chunks, round(avg_len, 6) AS avg_len FROM doc_freq, stats"),
    "list_documents": query(DOCS, chunks(), select="""SELECT document_id, source, count(*) AS chunk_count
        FROM chunks GROUP BY ALL ORDER BY source"""),
    "category_counts": query(DOCS, CASES, select="SELECT category, count(*) AS case_count FROM cases GROUP BY ALL"),
    "dataset_summary": query(DOCS, chunks(), CASES, SUMMARY, select="SELECT * FROM summary"),
    "hash_embed": _embedded(blake2b_ctes(all_terms("")), hashed(fv.HASH_DIMENSION, BLAKE2B)),
    "hash_embed_written": _embedded(blake2b_ctes(all_terms("")), hashed(fv.HASH_DIMENSION, BLAKE2B)),
    "hash_embed_md5": _embedded(hashed(fv.HASH_DIMENSION, MD5)),
    "cosine": query(CENTROIDS, select="SELECT vec_id, label, round(score, 6) AS score FROM cosines WHERE query_id = label"),
    "dense_topk": _search(("dense",)),
    "dense_topk_md5": _search(("dense",), hashes=MD5),
    "dense_topk_odd_dimension": _search(("dense",), dimension=7),
    "dense_topk_external": query(CENTROIDS, select="""SELECT k, query_id, rank, chunk_id, source,
        round(score, 6) AS score FROM vector_hits"""),
    "external_metrics": query(CENTROIDS, select=f"""
        SELECT 'dense' AS strategy, k, count(*) AS evaluated_case_count, {round_exact('avg(hit)', 4)} AS hit_rate,
               {round_exact('avg(hit)', 4)} AS recall, {round_exact('avg(rr)', 4)} AS mrr,
               {round_exact('avg(gain)', 4)} AS ndcg
        FROM (SELECT k, query_id, coalesce(max((source = 'label-' || query_id)::INTEGER), 0)::DOUBLE AS hit,
                     coalesce(1 / min(rank) FILTER (source = 'label-' || query_id), 0) AS rr,
                     coalesce(1 / log2(1 + min(rank) FILTER (source = 'label-' || query_id)), 0) AS gain
              FROM vector_hits GROUP BY ALL) GROUP BY ALL"""),
    "bm25_topk": _search(("bm25",)),
    "bm25_postings": _search(("bm25",)),
    "bm25_score": query(DOCS, QUESTIONS, retrieval(("dense",), (fv.TOP_K,)), bm25(), select="""
        SELECT query_id, chunk_id, round(coalesce(b.score, 0), 6) AS score
        FROM (SELECT query_id, chunk_id FROM hits) LEFT JOIN bm25_scores b USING (query_id, chunk_id)"""),
    "rrf_fuse": _search(("hybrid",)),
    "rrf_fuse_weighted": _search(("hybrid",), rrf_k=10, dense_weight=0.25, sparse_weight=2.0),
    "strategy_search": _search(fv.STRATEGIES, KS),
    "hybrid_search": query(DOCS, QUESTIONS, FIVE, select="""SELECT query_id, rank, chunk_id, document_id, source, text,
        round(score, 6) AS score FROM hits"""),
    "hybrid_external": query(DOCS, QUESTIONS, EXTERNAL, select=f"SELECT {HIT_COLUMNS} FROM hits"),
    "search_after_changes": query(CHANGED, QUESTIONS, FIVE, select=f"SELECT {HIT_COLUMNS} FROM hits"),
    "citation_projection": query(DOCS, QUESTIONS, FIVE, CITATION, select="SELECT * FROM cited"),
    "ingest_documents": query(DOCS, chunks(), select="""SELECT document_id, source, count(*) AS chunk_count
        FROM chunks GROUP BY ALL"""),
    "replace_document": query(DOCS, chunks(), select="""SELECT chunk_id, source,
        CASE WHEN lang = 'en' THEN 2 ELSE 1 END::BIGINT AS ingested_by FROM chunks
        JOIN (SELECT document_id, lang FROM docs) USING (document_id)"""),
    "delete_document": query(DOCS, chunks(), select="""SELECT document_id, source, count(*) AS chunk_count FROM chunks
        WHERE document_id NOT IN (SELECT document_id FROM docs WHERE lang = 'en') GROUP BY ALL"""),
    "ingest_stream": query(DOCS, chunks(), select="""SELECT document_id, source, count(*) AS chunk_count
        FROM chunks GROUP BY ALL"""),
    "extractive_answer": query(DOCS, QUESTIONS, FIVE, ANSWERS, select="SELECT query_id, answer FROM answers"),
    "build_context": query(DOCS, QUESTIONS, FIVE, CONTEXTS, select="SELECT * FROM contexts"),
    "prompt_table": query(DOCS, QUESTIONS, FIVE, CONTEXTS, select=f"""SELECT query_id, {lit(fv.SYSTEM_PROMPT)} AS system_prompt,
        '{fv.PROMPT_EVIDENCE_LABEL}' || {NL} || context || {NL} || {NL} || '{fv.PROMPT_QUESTION_LABEL}' || question AS user_prompt
        FROM contexts JOIN asked USING (query_id)"""),
    "answer_queries": query(DOCS, QUESTIONS, FIVE, CITATION, ANSWERS, select="""SELECT query_id, question, answer,
        rank AS citation_no, * EXCLUDE (query_id, question, answer, rank)
        FROM answers LEFT JOIN cited USING (query_id)"""),
    "duplicate_case_ids": query(DOCS, CASES, select="""SELECT category AS case_id, count(*) AS occurrences
        FROM cases GROUP BY category HAVING count(*) > 1"""),
    "missing_sources": query(DOCS, CASES, select="""SELECT DISTINCT source FROM relevance
        WHERE source NOT IN (SELECT source FROM raw WHERE lang <> 'en')"""),
    "split_answerable": query(DOCS, CASES, select="""SELECT count(*) AS case_count,
        count(*) FILTER (n_relevant > 0) AS evaluated_case_count,
        count(*) FILTER (n_relevant = 0) AS skipped_unanswerable_case_count FROM cases"""),
    "hit_at_k": _evaluated("SELECT strategy, k, case_id, round(hit, 6) AS hit FROM scores"),
    "recall_at_k": _evaluated("SELECT strategy, k, case_id, round(recall, 6) AS recall FROM scores"),
    "reciprocal_rank": _evaluated("SELECT strategy, k, case_id, round(reciprocal_rank, 6) AS reciprocal_rank FROM scores"),
    "ndcg_at_k": _evaluated("SELECT strategy, k, case_id, round(ndcg, 6) AS ndcg FROM scores"),
    "eval_details": _evaluated(f"""SELECT strategy, k, case_id, category, question, coalesce(retrieved, '') AS retrieved, expected,
        hit > 0 AS hit, {round_exact('recall', 4)} AS recall, {round_exact('reciprocal_rank', 4)} AS reciprocal_rank,
        {round_exact('ndcg', 4)} AS ndcg
        FROM scores JOIN (SELECT case_id, category, question FROM cases) USING (case_id)
        JOIN (SELECT case_id, string_agg(DISTINCT source, ',' ORDER BY source) AS expected
              FROM relevance GROUP BY case_id) USING (case_id)
        LEFT JOIN (SELECT strategy, k, query_id AS case_id, string_agg(source, ',' ORDER BY rank) AS retrieved
                   FROM hits GROUP BY ALL) USING (strategy, k, case_id)"""),
    "eval_metrics": _evaluated("SELECT * FROM metrics"),
    "compare_strategies": _evaluated("SELECT * FROM metrics ORDER BY strategy, k"),
    "dataset_warnings": query(DOCS, chunks(), CASES, SUMMARY, select=f"""SELECT warning_no::INTEGER AS warning_no, warning
        FROM {SIZE_WARNINGS} JOIN {COUNTS} USING (item) WHERE n < least"""),
    "indistinguishable_warning": _evaluated("""SELECT l.strategy || '-' || r.strategy AS pair, bool_and(
          l.hit_rate = r.hit_rate AND l.recall = r.recall AND l.mrr = r.mrr AND l.ndcg = r.ndcg) AS applies
        FROM metrics l JOIN metrics r ON l.k = r.k AND l.strategy <= r.strategy GROUP BY ALL"""),
    "report_tables": _evaluated(
        f"""
        SELECT 'results' AS section, strategy AS item, k, metric, value, NULL::VARCHAR AS label
        FROM (UNPIVOT (SELECT strategy, k, hit_rate, recall, mrr, ndcg FROM metrics)
              ON hit_rate, recall, mrr, ndcg INTO NAME metric VALUE value)
        UNION ALL SELECT 'dataset', item, NULL, 'count', n::DOUBLE, NULL FROM (
          UNPIVOT (SELECT * FROM summary) ON COLUMNS(*) INTO NAME item VALUE n)
        UNION ALL SELECT 'dataset', 'category ' || category, NULL, 'count', count(*)::DOUBLE, NULL FROM cases GROUP BY category
        UNION ALL SELECT 'configuration', item, NULL, NULL, NULL, label FROM (VALUES
          ('schema_version', '1.0'), ('embedding', 'hashing'), ('chunk_size', '500'), ('chunk_overlap', '80'),
          ('top_ks', '1,3,5'), ('documents', 'documents'), ('questions', 'benchmark')) c(item, label)
        UNION ALL SELECT 'warnings', warning_no::VARCHAR, NULL, NULL, NULL, warning FROM {SIZE_WARNINGS}
          JOIN {COUNTS} USING (item) WHERE n < least
        UNION ALL SELECT 'warnings', '4', NULL, NULL, NULL, {lit(fv.INDISTINGUISHABLE_WARNING)}
          FROM (SELECT k, count(DISTINCT (hit_rate, recall, mrr, ndcg)) AS outcomes FROM metrics GROUP BY k)
          HAVING max(outcomes) = 1""",
        SUMMARY,
    ),
    "chunk_ablation": ABLATION,
}
