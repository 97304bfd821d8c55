"""Document quality by importance: how much likelier a text is under trusted texts than under the raw corpus.

Both sides are multinomials over hashed n-grams (single tokens and pairs; a token is a run of word
characters or a run of punctuation, A-Z lower-cased). The raw side is counted over all documents. The
trusted side is counted over all labelled documents of good quality. A text's score is the mean
log-likelihood ratio of its n-grams. The threshold is the one that tells good from bad labels best among
all labelled documents, and every document is compared with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from evidence_engine.llm.common import Scratch, keyed, map_arrow, texts
from evidence_engine.llm.words import CHUNK, mixed, runs, word_hashes

BUCKET_BITS = 16
#: So many labels are sent to the documents; more are joined with them.
SENT_LABELS = 500_000
#: Ranges of scores in which the threshold is sought side by side.
RANGES = 200
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
#: Fixed: characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

_KIND = np.ones(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "_"]] = 2
_BYTE = np.random.default_rng(80_021).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _grouped(values: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that are hashed together."""
    first, size = 0, 0
    for i, text in enumerate(values):
        size += len(text)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(values):
        yield first, len(values)


def token_hashes(values: list[bytes]) -> list[np.ndarray]:
    """For each text the hashes of its tokens."""
    joined = np.frombuffer(b" ".join(values) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in values])
    kind = _KIND[joined]
    edges = np.append(0, np.flatnonzero(np.diff(kind)) + 1)
    first = edges[kind[edges] > 0]
    if not len(first):
        return [np.zeros(0, np.uint64) for _ in values]
    # The hash of a token sums its bytes' values, each weighted by its place.
    place = np.arange(len(joined)) - np.repeat(edges, np.diff(edges, append=len(joined)))
    weights = _BYTE[joined] * ((place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1))
    weights[kind == 0] = 0
    hashes = mixed(np.add.reduceat(weights, first))
    return np.split(hashes, np.searchsorted(first, ends[:-1]))


def grams(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of a text's tokens and pairs of tokens."""
    pairs = runs(tokens, 2) if len(tokens) > 1 else tokens[:0]
    return (np.concatenate([tokens, pairs]) >> np.uint64(64 - bits)).astype(np.int32)


def _counts(bits: int):
    """Task: n-grams per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            values = [t.lower() for t in texts(batch.column(0))]
            for a, b in _grouped(values):
                for tokens in token_hashes(values[a:b]):
                    np.add.at(total, grams(tokens, bits), 1)
        bucket = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(total[bucket])], names=["bucket", "n"])

    return run


def _multinomial(rows: DataFrame, bits: int) -> np.ndarray:
    """Log probabilities of all buckets, each with half a count more; ``rows`` are texts."""
    counts = map_arrow(rows, _counts(bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    full = np.full(1 << bits, 0.5)
    full[counts["bucket"].to_numpy(np.int64)] += counts["n"].to_numpy(np.float64)
    return np.log(full / full.sum())


def _scored(ratio: np.ndarray, bits: int):
    """Task: mean log-likelihood ratio; 0 for a text without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = scores_of(texts(batch.column(1)), ratio, bits)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def scores_of(values: list[bytes], ratio: np.ndarray, bits: int) -> list[float]:
    values, out = [t.lower() for t in values], []
    for a, b in _grouped(values):
        for tokens in token_hashes(values[a:b]):
            out.append(float(ratio[grams(tokens, bits)].mean()) if len(tokens) else 0.0)
    return out


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """The threshold with the best mean of the shares of good texts at or above it and bad ones below it.

    Of equally good ones the lowest. It lies half-way between two scores; without bad or good ones nothing is rejected.
    """
    if good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    lost = np.append(0, np.cumsum(good)) / good.sum()
    caught = np.append(0, np.cumsum(~good)) / (~good).sum()
    cut = np.append(True, np.append(scores[1:] != scores[:-1], True))
    value = np.where(cut, caught - lost, -2)
    at = int(np.argmax(value))
    if at == 0:
        return -np.inf
    return float((scores[at - 1] + scores[at]) / 2) if at < len(scores) else np.inf


def threshold_of(scored: DataFrame) -> float:
    """:func:`best_threshold` of a written table ``score, n_good, n_bad`` with one row for each score, of any length.

    Scores are dealt into ranges; the driver sees one sum for each range, and running sums go on from these.
    """
    n_good, n_bad = scored.agg(F.sum("n_good"), F.sum("n_bad")).first()
    if not n_good or not n_bad:
        return -np.inf
    cuts = sorted(set(scored.approxQuantile("score", [i / RANGES for i in range(1, RANGES)], 1 / (4 * RANGES))))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda cut: cut < F.col("score")))
    dealt = scored.withColumn("part", part)
    before, rows = [0, 0], []
    sums = dealt.groupBy("part").agg(F.sum("n_good").alias("good"), F.sum("n_bad").alias("bad"))
    for row in sums.orderBy("part").collect():  # RANGES at most
        rows.append((row["part"], *before))
        before = [before[0] + row["good"], before[1] + row["bad"]]
    earlier = scored.sparkSession.createDataFrame(rows, "part int, good_before long, bad_before long")
    so_far = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)
    good = F.sum("n_good").over(so_far) + F.col("good_before")
    bad = F.sum("n_bad").over(so_far) + F.col("bad_before")
    value = bad / F.lit(n_bad) - good / F.lit(n_good)
    valued = dealt.join(F.broadcast(earlier), "part").select("score", value.alias("value"))
    best = valued.agg(F.max(F.struct("value", (-F.col("score")).alias("back"))).alias("best")).first()["best"]
    if best["value"] <= 0:
        return -np.inf
    below = -best["back"]
    above = scored.where(F.col("score") > below).agg(F.min("score")).first()[0]
    return np.inf if above is None else (below + above) / 2


def fit(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS) -> tuple[np.ndarray, float]:
    """Log-likelihood ratio of every bucket, and the threshold, from all documents and all labels."""
    scratch = Scratch(docs.sparkSession)
    raw = _multinomial(docs.select("text"), bits)
    judged = scratch.write(
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.min("quality") > 0).alias("good")),
        "quality-labels",
    )
    few = judged.count() <= SENT_LABELS
    good = judged.where("good").select("doc_id")
    trusted = _multinomial(docs.join(F.broadcast(good) if few else good, "doc_id").select("text"), bits)
    ratio = trusted - raw
    # Scores, not texts, meet the labels: nothing but the trusted texts is ever shuffled, and these only for many labels.
    scores = map_arrow(docs.select("doc_id", "text"), _scored(ratio, bits), "doc_id long, score double")
    labelled = scores.join(F.broadcast(judged) if few else judged, "doc_id")
    by_score = labelled.groupBy("score").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"))
    threshold = threshold_of(scratch.write(by_score, "quality-scores"))
    scratch.clear()
    return ratio, threshold


def _repeated_words(words: np.ndarray) -> int:
    """Words in windows of eight words that occur twice or more in the text."""
    if len(words) <= WINDOW:
        return 0
    _, which, n = np.unique(runs(words, WINDOW), return_inverse=True, return_counts=True)
    first = np.flatnonzero(n[which] > 1)
    if not len(first):
        return 0
    change = np.zeros(len(words) + 1, np.int32)
    change[first] += 1
    np.subtract.at(change, first + WINDOW, 1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def _duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines) - len(set(lines))


def _rated(ratio: np.ndarray, bits: int, threshold: float):
    """Task: the measures and the verdict on every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(2))
            n_words, chars, symbols, lines, repeated = [], [], [], [], []
            for a, b in _grouped(values):
                for text, words in zip(values[a:b], word_hashes(values[a:b])):
                    data = np.frombuffer(text, np.uint8)
                    n_words.append(len(words))
                    chars.append(int(((_KIND[data] > 0) & (data & 0xC0 != 0x80)).sum()))
                    symbols.append(int(_IS_SYMBOL[data].sum()))
                    lines.append(_duplicate_lines(text))
                    repeated.append(_repeated_words(words))
            scores = np.array(scores_of(values, ratio, bits), np.float64)
            words, again = np.array(n_words, np.int64), np.array(repeated, np.int64)
            failed = (words < MIN_WORDS) | (100 * again > MAX_REPEATED_PERCENT * words)
            arrays = [
                batch.column(0),
                batch.column(1),
                *(pa.array(x, pa.int64()) for x in (n_words, chars, symbols, lines, repeated)),
                pa.array(scores),
                pa.array(failed),
                pa.array(~failed & (scores >= threshold)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=RATED.replace(" long", "").replace(" double", "").replace(" boolean", "").split(", "))

    return run


RATED = (
    "doc_id long, h long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "score double, base_failed boolean, kept boolean"
)


def rate(docs: DataFrame, labels: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Measures, score and verdict for every document; ``labels`` has ``doc_id, quality`` (1 good, 0 bad).

    A missing or empty text has no words and fails; rows that repeat are rated alike; a document without
    id is rated, but no label reaches it; of several labels of a document the worst counts; other
    columns are ignored. Without both good and bad labels no text is rejected by its score. An empty
    table gives an empty table.
    """
    docs = keyed(docs)
    ratio, threshold = fit(docs, labels, bits)
    return map_arrow(docs, _rated(ratio, bits, threshold), RATED)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``rate`` keeps, with all their columns, whatever these are called.

    Texts are dropped where they are rated: nothing is joined or shuffled. Missing, empty and repeated rows and
    empty tables are treated as there.
    """
    ratio, threshold = fit(keyed(docs), labels, BUCKET_BITS)
    rated, place = _rated(ratio, BUCKET_BITS, threshold), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(place), "")
            (rates,) = rated(iter([pa.RecordBatch.from_arrays([text] * 3, names=["doc_id", "h", "text"])]))
            yield batch.filter(rates.column("kept"))

    return map_arrow(docs, run, docs.schema)
