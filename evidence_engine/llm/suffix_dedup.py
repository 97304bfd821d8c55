"""Removal of long byte strings that occur more than once, by bucket-pointer refinement.

A bucket is a set of suffixes with a common prefix, and its identifier names that prefix. Refinement
sorts a bucket on the identifiers found at later offsets of its suffixes and reuses the new,
longer-prefix identifiers in the next step. Here an identifier is a hash of the prefix that it names,
so the pointer at a later offset of the same text is read without a look-up, and only the sorting
and counting of buckets is distributed:

1. Initial buckets: one suffix stands for a run of neighbouring windows. It starts at the smallest
   q-gram identifier of the window, which depends on the window's bytes alone, so equal windows
   are always in one bucket, whatever surrounds them. Buckets with one suffix are dropped.
2. Refinement: a bucket is split by the identifier of all bytes that its suffix's windows cover.
   Suffixes that stay together repeat with all their windows.
3. Refinement of what was split, in blocks of neighbouring windows: by the bytes that a block's windows
   share (if those are alone, none of them repeats) and by all bytes that they cover (if those
   repeat, all do), then window by window. Window identifiers come from identifiers at later
   offsets, combined in steps up to 200 bytes, each reusing the one before. One member of each
   sub-bucket, with its count, stands for all in it, so copies are never expanded into pairs.

No bucket is ever gathered: buckets are counted with partial sums, and looked up by joins that Spark
may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine.llm.common import Scratch, keyed, map_arrow, materialize, texts, with_info

LENGTH = 200
GRAM = 64
#: Offsets of a block of windows.
STEP = 16
BLOCK = 1 << 18

_RANDOM = np.random.default_rng(20_011)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = _RANDOM.integers(1, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: ``run`` packs the first window start, how many starts follow (8 bits) and the suffix's offset in the first (8 bits).
ANCHORS = "k long, f long, doc_id long, h long, run long, n int"
#: ``n`` of a row that holds starts repeated within its own document: from ``run`` to ``f``.
LOCAL = -1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x *= _MIX
    return x ^ (x >> np.uint64(32))


def _widened(ids: np.ndarray, width: int, times: int, factor: int) -> np.ndarray:
    """Identifiers of ``times`` neighbouring pieces from those of one piece of ``width`` bytes."""
    n = len(ids) - width * (times - 1)
    out = ids[:n].copy()
    for t in range(1, times):
        out *= _FACTORS[factor]
        out += ids[t * width : t * width + n]
    return out


def gram_ids(data: np.ndarray) -> np.ndarray:
    """Identifier of the q-gram at each offset."""
    ids, width = _BYTES[data], 1
    for step in range(GRAM.bit_length() - 1):
        ids = _widened(ids, width, 2, step)
        width *= 2
    return _mixed(ids)


def window_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Identifier of the window at each offset, by identifiers at later offsets: 8, 40, 200 bytes."""
    ids, width, step = _BYTES[data], 1, 6
    while width < length:
        times = next((t for t in (2, 3, 5, 7) if (length // width) % t == 0 and length % (width * t) == 0), 0)
        times = times or length // width
        ids = _mixed(_widened(ids, width, times, step))
        width *= times
        step = 6 + (step - 5) % 10
    return ids


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of windows with one smallest q-gram: first and last start, offset and identifier of the q-gram.

    Of equal q-grams the first counts. Very long texts are taken in blocks; a block's edge may split a run.
    """
    found = []
    span = length - GRAM + 1
    for at in range(0, len(data) - length + 1, BLOCK):
        piece = data[at : at + BLOCK + length - 1]
        ids = gram_ids(piece)
        least = ids & ~np.uint64((1 << 19) - 1) | np.arange(len(ids), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        where = (least & np.uint64((1 << 19) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        last = np.append(first[1:], len(where)) - 1
        found.append((first + at, last + at, where[first] + at, ids[where[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join runs of starts, sorted by their first, that follow on each other."""
    if not len(first):
        return first, last
    new = np.append(True, first[1:] > np.maximum.accumulate(last)[:-1] + 1)
    at = np.flatnonzero(new)
    return first[at], np.maximum.reduceat(last, at)


def _suffixes(length: int):
    """Task: a document's suffixes, those with equal windows once, and the starts that repeat in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            columns: list[list] = [[], [], [], [], [], []]
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                if len(text) < length:
                    continue
                first, last, place, k = anchors(np.frombuffer(text, np.uint8), length)
                f = np.fromiter(
                    (digest(text[s : e + length]) for s, e in zip(first.tolist(), last.tolist())), np.uint64, len(first)
                ).view(np.int64)
                packed = first << 16 | (last - first) << 8 | (place - first)
                _, at, which, n = np.unique(k ^ f, return_index=True, return_inverse=True, return_counts=True)
                n = np.minimum(n, 2)
                local = n[which] > 1
                s, e = _merged(first[local], last[local])
                rows = len(at) + len(s)
                columns[0].append(np.concatenate([k[at], _mixed(s.astype(np.uint64) + np.uint64(h % 2**63)).view(np.int64)]))
                columns[1].append(np.concatenate([f[at], e]))
                columns[2] += [doc] * rows
                columns[3].append(np.full(rows, h))
                columns[4].append(np.concatenate([packed[at], s]))
                columns[5].append(np.concatenate([n, np.full(len(s), LOCAL)]).astype(np.int32))
            if columns[2]:
                arrays = [pa.array(np.concatenate(c)) if i != 2 else pa.array(c, pa.int64()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=["k", "f", "doc_id", "h", "run", "n"])

    return run


def _bucket_sizes(length: int):
    """Task: initial buckets and how many suffixes of a batch are in each."""
    suffixes = _suffixes(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in suffixes(batches):
            n = batch.column(5).to_numpy()
            k, which = np.unique(batch.column(0).to_numpy()[n > 0], return_inverse=True)
            sizes = np.bincount(which, weights=n[n > 0], minlength=len(k)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sizes)], names=["k", "n"])

    return run


def _blocks(length: int):
    """Task: windows of the suffixes that stand for split buckets, in blocks of neighbouring offsets.

    ``inner`` names the bytes that all windows of a block share, ``outer`` all that those present cover.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, rows = [], []
            for doc, h, text, members in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), batch.column(3)
            ):
                ids = window_ids(np.frombuffer(text, np.uint8), length).view(np.int64)
                for k, packed, n in zip(*(members.values.field(i).to_pylist() for i in range(3))):
                    first, after, back = packed >> 16, packed >> 8 & 255, packed & 255
                    place, least = first + back, back - after
                    for low in range(least - least % STEP, back + 1, STEP):
                        high = low + STEP - 1
                        inner = digest(text[place - low : place - high + length], seed=low)
                        low_in, high_in = max(low, least), min(high, back)
                        start, stop = place - high_in, place - low_in
                        outer = digest(text[start : stop + length], seed=low_in)
                        keys.append((k, inner, outer, h, start, n))
                        rows.append((doc, ids[start : stop + 1]))
            if keys:
                table = np.array([(k, i - 2**63, o - 2**63, h, s, n) for k, i, o, h, s, n in keys], np.int64).T.copy()
                ends = np.cumsum([0] + [len(r[1]) for r in rows]).astype(np.int32)
                windows = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([r[1] for r in rows])))
                yield pa.RecordBatch.from_arrays(
                    [*map(pa.array, table[:5]), pa.array(table[5].astype(np.int32)), pa.array([r[0] for r in rows], pa.int64()), windows],
                    names=["k", "inner", "outer", "h", "first", "n", "doc_id", "windows"],
                )

    return run


BLOCKS = "k long, inner long, outer long, h long, first long, n int, doc_id long, windows array<long>"


def _one(*columns: str) -> list[Column]:
    """The columns of one row of a group, the same row for all."""
    order = F.xxhash64(*columns)
    return [F.min_by(c, order).alias(c) for c in columns]


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, h, starts``: runs of starts of strings of ``length`` bytes that also start elsewhere; written."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select("doc_id", "h", "text").where(F.octet_length("text") >= length)
    sizes = map_arrow(rows, _bucket_sizes(length), "k long, n long")
    shared = sizes.groupBy("k").agg(F.sum("n").alias("size")).where("size > 1")
    suffixes = map_arrow(rows, _suffixes(length), ANCHORS)
    buckets = scratch.write(
        suffixes.join(shared, "k", "left").where(f"size is not null or n = {LOCAL}").drop("size"), "suffix-buckets"
    )
    members = buckets.where(f"n <> {LOCAL}")
    refined = scratch.write(
        members.groupBy("k", "f").agg(F.sum("n").alias("size"), *_one("doc_id", "h", "run")), "suffix-refined"
    )
    split = refined.groupBy("k").agg(F.count("*").alias("parts")).where("parts > 1").select("k")
    together = members.join(refined.where("size > 1").select("k", "f"), ["k", "f"])
    start = F.shiftright("run", 16)
    whole = together.select("doc_id", "h", start.alias("first"), (start + F.shiftright("run", 8).bitwiseAND(255)).alias("last"))

    stand_ins = (
        refined.join(split, "k")
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("k", "run", F.least("size", F.lit(2)).cast("int").alias("n"))).alias("members"))
    )
    blocks = scratch.write(
        map_arrow(
            with_info(rows, stand_ins, "inner").select("doc_id", "h", "text", "members"), _blocks(length), BLOCKS
        ),
        "suffix-blocks",
    )
    outers = blocks.groupBy("k", "inner", "outer").agg(
        F.sum("n").alias("size"), F.max("n").alias("n"), *_one("doc_id", "h", "first")
    )
    outers = scratch.write(outers, "suffix-outer")
    same = blocks.where("n = 1").join(outers.where("size > 1").select("k", "inner", "outer"), ["k", "inner", "outer"])
    same = same.select("doc_id", "h", "first", (F.col("first") + F.size("windows") - 1).alias("last"))
    mixed = outers.groupBy("k", "inner").agg(F.count("*").alias("parts")).where("parts > 1").select("k", "inner")
    shown = outers.join(mixed, ["k", "inner"]).select(
        "k", "inner", "outer", "doc_id", "h", "first", F.least("size", F.lit(2)).alias("times")
    )
    windows = scratch.write(
        blocks.join(shown, ["k", "inner", "outer", "h", "first"])
        .where(blocks["doc_id"].eqNullSafe(shown["doc_id"]))
        .select("k", blocks["doc_id"], "h", "first", "times", F.posexplode("windows").alias("at", "w")),
        "suffix-windows",
    )
    again = windows.groupBy("k", "w").agg(F.sum("times").alias("size")).where("size > 1").select("k", "w")
    at = F.col("first") + F.col("at")
    single = windows.where("times = 1").join(again, ["k", "w"]).select("doc_id", "h", at.alias("first"), at.alias("last"))
    local = buckets.where(f"n = {LOCAL}").select("doc_id", "h", F.col("run").alias("first"), F.col("f").alias("last"))
    runs = whole.unionByName(same).unionByName(single).unionByName(local)
    starts = runs.groupBy("doc_id", "h").agg(F.collect_set(F.struct("first", "last")).alias("starts"))
    starts = materialize(starts, "suffix-starts")
    scratch.clear()
    return starts


def _removed(length: int):
    """Task: spans to remove and the bytes that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            kept, spans = [], []
            for text, starts in zip(texts(batch.column(1)), batch.column(2)):
                if not starts.is_valid:
                    kept.append(text)
                    spans.append([])
                    continue
                change = np.zeros(len(text) + 1, np.int32)
                np.add.at(change, starts.values.field(0).to_numpy(), 1)
                np.add.at(change, starts.values.field(1).to_numpy() + length, -1)
                covered = np.cumsum(change[:-1]) > 0
                edges = np.flatnonzero(np.diff(covered.astype(np.int8), prepend=0, append=0)).tolist()
                spans.append([{"start": a, "stop": b} for a, b in zip(edges[::2], edges[1::2])])
                kept.append(np.frombuffer(text, np.uint8)[~covered].tobytes())
            sizes = pa.array([len(t) for t in texts(batch.column(1))], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes, pa.array(kept, pa.binary()), pa.array(spans, kind)],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_bytes, kept, spans``: each text without the bytes of strings of ``length`` that repeat.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in the
    same or another document; strings are judged on the input. ``spans`` are the maximal removed
    runs, ``stop`` exclusive; ``kept`` joins the remaining bytes. One row comes back for each row.
    A missing text is empty; short and empty texts stay as they are; rows that repeat, with equal or
    missing ids too, are copies of each other; other columns are ignored; an empty table gives an
    empty table.
    """
    docs = keyed(docs)
    return map_arrow(
        with_info(docs, repeated_starts(docs, length)).select("doc_id", "text", "starts"),
        _removed(length),
        "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, stop: long>>",
    )
