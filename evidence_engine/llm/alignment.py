"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Both token sequences are arrays of byte offsets at which tokens end. An offset in both arrays cuts a group.
The arrays are compared along a diagonal: at the current shift between the two indexes, stretches of doubling
length are held against each other, so that one-to-one stretches are jumped; where they part, a window
of both arrays gives the offsets they share there, and the shift becomes that of the last one.

Tokens are produced once: a document's linked id pairs are written as numbers, counted over all documents
by key, and looked up again where they were written. The most frequent pairs, a fixed number of them, go to
all tasks; links of other pairs are joined with their counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_engine.llm.common import map_arrow, materialize, texts

#: Ends that a window holds at first, where two sequences part; it doubles until they share one.
WINDOW = 256
#: The first stretch compared along a diagonal.
STRETCH = 8
#: Pairs whose counts every task gets (3.5 MB).
COMMON = 1 << 18
#: Distinct pairs that a task holds before it passes their counts on.
HELD = 1 << 20
#: Fixed: what a byte-level vocabulary's merges stay inside of.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts are tokenized in groups of about this many bytes.
GROUP = 1 << 20


def shared_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes into two ascending arrays, whose last values are equal, of all values they share."""
    i = j = 0
    left, right = [], []
    while i < len(a) and j < len(b):
        step = STRETCH
        while True:  # along the diagonal
            n = min(step, len(a) - i, len(b) - j)
            differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
            run = int(differ[0]) if len(differ) else n
            if run:
                left.append(np.arange(i, i + run))
                right.append(np.arange(j, j + run))
                i, j = i + run, j + run
            if run < step:
                break
            step *= 2
        width = WINDOW
        while i < len(a) and j < len(b):
            x, y = a[i : i + width], b[j : j + width]
            at = np.searchsorted(y, x)
            found = np.flatnonzero((at < len(y)) & (y[np.minimum(at, len(y) - 1)] == x))
            if len(found):
                left.append(i + found)
                right.append(j + at[found])
                i, j = i + int(found[-1]) + 1, j + int(at[found[-1]]) + 1
                break
            width *= 2
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def linked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of all pairs of tokens that overlap: one for each stretch between neighbouring ends of either."""
    ends = np.sort(np.concatenate([a, b]), kind="stable")  # two ascending runs, merged
    ends = ends[np.flatnonzero(np.diff(ends, prepend=-1))]
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def byte_values() -> dict[str, int]:
    """Fixed: the characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(itself)]
    return {chr(b): b for b in itself} | {chr(256 + n): b for n, b in enumerate(others)}


class ByteTokenizer:
    """Ids and lengths of the tokens of a byte-level vocabulary in JSON; strings of special tokens are plain text."""

    def __init__(self, written: str):
        import tiktoken
        from tokenizers import Tokenizer

        model = json.loads(written)
        value = byte_values()
        special = {t["id"] for t in model.get("added_tokens", ())}
        tokens = {bytes(value[c] for c in t): i for t, i in model["model"]["vocab"].items() if i not in special}
        self.bytes = [b""] * (max(tokens.values()) + 1)
        for token, i in tokens.items():
            self.bytes[i] = token
        self.lengths = np.array([len(t) for t in self.bytes])
        # Ids of this vocabulary rise with the order of its merges, so they serve as ranks. The ranks' encoder is three times as fast.
        self.fast = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=tokens, special_tokens={})
        self.plain = Tokenizer.from_str(written)
        self.plain.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.fast.encode_ordinary(t) for t in texts]

    def encode_plainly(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch(texts, add_special_tokens=False)]


class PieceTokenizer:
    """Ids and lengths of pieces; the model puts a space before the text."""

    def __init__(self, written: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=written)
        pieces = [self.model.IdToPiece(i) for i in range(self.model.GetPieceSize())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.IsByte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]
        self.lengths = np.array([len(t) for t in self.bytes])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


#: One for each content that a Python worker has used; a worker serves many tasks.
_LOADED: dict[tuple[type, str | bytes], object] = {}


def loaded(kind: type, written: str | bytes):
    if (kind, written) not in _LOADED:
        _LOADED[kind, written] = kind(written)
    return _LOADED[kind, written]


def grouped_text(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2``: ids by group; ``last`` are the groups' last indexes."""
    group_a = np.searchsorted(last_a, np.arange(len(a)))
    group_b = np.searchsorted(last_b, np.arange(len(b)))
    before_b = np.concatenate([[0], last_b + 1])[group_a]
    place_a = np.arange(len(a)) + before_b
    place_b = np.arange(len(b)) + (last_a + 1)[group_b]
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[last_a], mark_b[last_b] = 1, 2
    coded = np.empty(len(a) + len(b), np.int64)
    coded[place_a], coded[place_b] = a * 3 + mark_a, b * 3 + mark_b
    return b"".join([WRITTEN[code] for code in coded.tolist()])[:-1]


class _Written(dict):
    """Ids as written, with the sign behind them: made when they first occur."""

    def __missing__(self, code: int) -> bytes:
        text = self[code] = b"%d%s" % (code // 3, b",|;"[code % 3 : code % 3 + 1])
        return text


WRITTEN = _Written()


def align(a: list[int], b: list[int], left: ByteTokenizer, right: PieceTokenizer, data: bytes):
    """Arrays of both ids and their ends, or None if either does not spell ``data``."""
    if b"".join([left.bytes[i] for i in a]) != data or b"".join([right.bytes[i] for i in b]) != data:
        return None
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return a, b, np.cumsum(left.lengths[a]), np.cumsum(right.lengths[b])


def _groups(values: list[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for value in values:
        group.append(value)
        size += len(value)
        if size >= GROUP:
            yield group
            group, size = [], 0
    if group:
        yield group


def _aligned(files):
    """Task: ``key, doc_id, text`` to one row a document with its numbers and its links as id pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = map(loaded, (ByteTokenizer, PieceTokenizer), files.value)
        width = len(right.bytes)
        kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.int32())]
        names = ["key", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
        for batch in batches:
            at = 0
            for group in _groups([t or b"" for t in texts(batch.column(2))]):
                keys, ids = (batch.column(c).slice(at, len(group)).to_pylist() for c in (0, 1))
                at += len(group)
                plain = [t.decode(errors="replace") for t in group]
                rows = []
                for key, doc, text, a, b in zip(keys, ids, group, left.encode([" " + t for t in plain]), right.encode(plain)):
                    found = align(a, b, left, right, b" " + text) if text else None
                    if found is None:
                        rows.append((key, doc, 0, 0, 0, 0, "", None))
                        continue
                    a, b, ends_a, ends_b = found
                    last_a, last_b = shared_ends(ends_a, ends_b)
                    at_a, at_b = linked(ends_a, ends_b)
                    digest = hashlib.sha256(grouped_text(a, b, last_a, last_b)).hexdigest()
                    pairs = (a[at_a] * width + b[at_b]).astype(np.int32)
                    rows.append((key, doc, len(a), len(b), len(last_a), len(pairs), digest, pairs))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: how often it has each id pair, in parts of bounded size."""

    def merged(held):
        pairs, place = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
        return pairs, np.bincount(place, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

    def out(pairs, n):
        return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int32()), pa.array(n)], names=["pair", "n"])

    held, size = [], 0
    for batch in batches:
        links = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        if not len(links):
            continue
        held.append(np.unique(links, return_counts=True))
        size += len(held[-1][0])
        if size > HELD:
            held = [merged(held)]
            size = len(held[0][0])
            if size > HELD // 2:
                yield out(*held[0])
                held, size = [], 0
    if held:
        yield out(*merged(held))


def _looked_up(shared):
    """Task: sums over the links of common pairs, and the links of others as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = shared.value
        for batch in batches:
            links = batch.column(1)
            lengths = np.diff(links.offsets.to_numpy()) if len(links) else np.zeros(0, np.int64)
            flat = links.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(links)), lengths)
            at = np.minimum(np.searchsorted(pairs, flat), max(len(pairs) - 1, 0))
            known = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
            n_best = np.bincount(row[known], best[at[known]], len(links)).astype(np.int64)
            # Sums of integers: added as integers.
            total = np.zeros(len(links), np.int64)
            np.add.at(total, row[known], counts[at[known]])
            rest = np.concatenate([[0], np.cumsum(np.bincount(row[~known], minlength=len(links)))]).astype(np.int32)
            others = pa.ListArray.from_arrays(pa.array(rest), pa.array(flat[~known], pa.int32()))
            columns = [batch.column(0), pa.array(n_best), pa.array(total), others]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_best", "count_sum", "others"])

    return run


def _threshold(ranked: DataFrame, most: int) -> float:
    """A count that at most so many pairs reach: counts fall into 8 classes for each power of two."""
    step = F.floor(F.log2("n") * 8)
    taken, threshold = 0, float("inf")
    for row in ranked.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        taken += row["k"]
        if taken > most:
            return threshold
        threshold = row["n"]
    return 0


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Two tables: one row for each row of ``docs``, and ``pair, n, best`` for each linked id pair.

    The first has ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: numbers of tokens of
    both kinds, of groups and of links, how many links are to the partner that is most frequent for their B id in
    all documents (ties count), the sum of the links' frequencies, and a digest of the grouped ids. ``pair`` is
    ``A id * number of B's pieces + B id``.

    Missing and empty texts, and texts that a tokenizer changes, have no tokens: zeros and an empty digest. Ids may
    be missing or repeat; every row is counted. Other columns are not looked at. An empty table gives empty ones.
    """
    spark = docs.sparkSession
    with open(byte_path, encoding="utf-8") as json_file, open(piece_path, "rb") as model_file:
        files = spark.sparkContext.broadcast((json_file.read(), model_file.read()))
    # Keys of rows are given before the table is written, and read from it ever after.
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbers = "key long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    rows = materialize(map_arrow(keyed, _aligned(files), f"{numbers}, links array<int>"), "links")
    counts = map_arrow(rows.select("links").where("links is not null"), _counts, "pair int, n long")
    counts = counts.groupBy("pair").agg(F.sum("n").alias("n"))
    width = len(loaded(PieceTokenizer, files.value[1]).bytes)
    counts = materialize(counts.withColumn("b", F.col("pair") % width), "counts")
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    ranked = counts.join(most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    ranked = materialize(ranked, "ranked")
    top = ranked.where(F.col("n") >= _threshold(ranked, common)).toArrow().combine_chunks().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    summed = map_arrow(
        rows.select("key", "links").where("links is not null"),
        _looked_up(shared),
        "key long, n_best long, count_sum long, others array<int>",
    )
    summed = materialize(summed, "looked-up")
    shared.destroy()
    others = summed.select("key", F.explode("others").alias("pair")).join(ranked, "pair")
    rest = others.groupBy("key").agg(F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more"))
    zero = F.lit(0).cast("long")

    def plus(known: str, other: str):
        return (F.coalesce(known, zero) + F.coalesce(other, zero)).alias(known)

    found = rows.drop("links").join(summed.drop("others"), "key", "left").join(rest, "key", "left")
    return (
        found.select(
            *("doc_id", "n_a", "n_b", "n_groups", "n_links"), plus("n_best", "more_best"), plus("count_sum", "more"), "groups_sha256"
        ),
        ranked,
    )
