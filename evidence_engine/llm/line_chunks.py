"""Removal of repeated blocks of lines, cut where the content says so.

A text is cut after a line if a rolling hash over it and the line before meets a condition, so the same
lines are cut alike wherever they stand, and an insertion moves no cut but those next to it. A line as long
as a passage, often a paragraph of its own, is a chunk whatever stands around it. Chunks of several lines, or of
such a line, that occur more than once are found by hash; each occurrence but the first, by document
id and place, is compared with the first byte by byte and goes if they are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from evidence_engine.llm.common import Scratch, map_arrow, named_rows, texts

#: One cut in so many lines, on average, beyond the shortest chunk.
EVERY = 2
SHORTEST = 2
LONGEST = 16
#: Lines whose hash decides on a cut.
ROLLING = 2
#: Words of a line that is cut off on both sides.
PASSAGE = 40

FIRST = "k1 long, k2 long, chunk binary"


def is_passage(line: bytes) -> bool:
    return len(line) >= 2 * PASSAGE - 1 and len(line.split(None, PASSAGE - 1)) == PASSAGE


def chunks(text: bytes) -> Iterator[tuple[int, int, bytes]]:
    """First line, number of lines and bytes of each chunk."""
    lines = text.split(b"\n")
    digest = xxhash.xxh3_64_intdigest
    long = [i for i, line in enumerate(lines) if is_passage(line)]
    cut_behind = {*long, *(i - 1 for i in long)}
    hashes = [digest(line) for line in lines]
    rolled, first = 0, 0
    for i, value in enumerate(hashes):
        # Shifting by half the word each line leaves two lines in the hash.
        rolled = ((rolled << 64 // ROLLING) ^ (value & ((1 << 64 // ROLLING) - 1))) & (2**64 - 1)
        size = i + 1 - first
        if i + 1 == len(lines) or size == LONGEST or i in cut_behind or size >= SHORTEST and (rolled * 0x9E3779B97F4A7C15 >> 40 & 0xFFFF) % EVERY == 0:
            yield first, size, b"\n".join(lines[first : i + 1])
            first = i + 1


def compared(chunk: bytes) -> bool:
    """Whether two lines at least have words, or one is as long as a passage."""
    lines = [line for line in chunk.split(b"\n") if line and not line.isspace()]
    return len(lines) > 1 or len(lines) == 1 and is_passage(lines[0])


def _chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
            for first, _, chunk in chunks(text):
                if compared(chunk):
                    key = xxhash.xxh3_128_digest(chunk)
                    rows.append((int.from_bytes(key[:8], "big", signed=True), int.from_bytes(key[8:], "big", signed=True), doc, h, first))
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["k1", "k2", "doc_id", "h", "line"])


def _first_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: the bytes of the chunks that begin at the wanted lines."""
    for batch in batches:
        rows = []
        for text, wanted in zip(texts(batch.column(0)), batch.column(1)):
            keys = {w["line"]: (w["k1"], w["k2"]) for w in wanted.as_py()}
            rows += [(*keys[first], chunk) for first, _, chunk in chunks(text) if first in keys]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["k1", "k2", "chunk"]
        )


#: Columns that an operator adds.
ADDED = ("__lines", "__removed", "__chunks")


def _rebuilt(names: list[str], added: tuple[str, ...]):
    """Task: every text without the chunks that equal their first occurrence; other columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            given = batch.column(0).flatten()
            new, n_lines, removed, places = [], [], [], []
            for text, firsts in zip(texts(given[at]), batch.column(1)):
                n_lines.append(text.count(b"\n") + 1 if text else 0)
                same = {f["line"]: f["chunk"] for f in firsts.as_py()} if firsts.is_valid else {}
                kept, gone = [], []
                for first, size, chunk in chunks(text) if same else ():
                    if same.get(first) == chunk:
                        gone.append({"line": first, "lines": size})
                    else:
                        kept.append(chunk)
                new.append(b"\n".join(kept).decode() if same else (None if text is None else text.decode()))
                removed.append(sum(g["lines"] for g in gone))
                places.append(gone)
            columns = [column if i != at else pa.array(new, pa.string()) for i, column in enumerate(given)]
            kind = pa.list_(pa.struct([("line", pa.int64()), ("lines", pa.int64())]))
            columns += [pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64()), pa.array(places, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return run


def remove_repeated_chunks(docs: DataFrame, added: tuple[str, str, str] = ADDED) -> DataFrame:
    """The documents, with all their columns, without the chunks of lines that stand earlier already.

    New columns, whose names can be given: ``__lines`` of the input, ``__removed`` lines, ``__chunks`` (first line and number of
    lines of each removed chunk). Of equal chunks the one in the document with the smallest id, and there
    the first, stays. Only chunks with two lines or more that have words, or a line of ``PASSAGE`` words, are compared. Rows with one id
    and one text are one document: they lose the same chunks. A missing text has no lines and stays
    missing, an empty one stays empty; a missing id counts as the smallest; an empty table gives an
    empty table.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    plain = docs.select(key.alias("k"), "text").where("text is not null").select("k.doc_id", "k.h", "text")
    found = scratch.write(map_arrow(plain, _chunk_keys, "k1 long, k2 long, doc_id long, h long, line long"), "line-chunks")
    repeated = scratch.write(
        found.groupBy("k1", "k2")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "line")).alias("first"))
        .where("n > 1"),
        "line-repeated",
    )
    wanted = repeated.groupBy("first.doc_id", "first.h").agg(F.collect_list(F.struct("first.line", "k1", "k2")).alias("wanted"))
    # Two rows of one document give the same chunk twice.
    same = plain["doc_id"].eqNullSafe(wanted["doc_id"]) & (plain["h"] == wanted["h"])
    firsts = scratch.write(
        map_arrow(plain.join(wanted.hint("merge"), same).select("text", "wanted"), _first_chunks, FIRST).dropDuplicates(["k1", "k2"]),
        "line-firsts",
    )
    later = (
        found.join(repeated.select("k1", "k2", "first"), ["k1", "k2"])
        .where("not (first.doc_id <=> doc_id and first.h = h and first.line = line)")
        .select("k1", "k2", "doc_id", "h", "line")
        .join(firsts, ["k1", "k2"])
        .groupBy("doc_id", "h")
        .agg(F.collect_list(F.struct("line", "chunk")).alias("firsts"))
        .select(F.col("doc_id").alias("of_id"), F.col("h").alias("of_h"), "firsts")
    )
    later = scratch.write(later, "line-later")
    # Texts are sorted and merged at every size: what the plan costs then grows as its input does.
    rows = named_rows(docs)
    same = rows["id"].eqNullSafe(later["of_id"]) & (rows["h"] == later["of_h"])
    joined = rows.join(later.hint("merge"), same, "left").select("row", "firsts")
    kinds = ", ".join("`" + f.name.replace("`", "``") + "` " + f.dataType.simpleString() for f in docs.schema)
    return map_arrow(
        joined,
        _rebuilt(docs.columns, added),
        f"{kinds}, `{added[0]}` long, `{added[1]}` long, `{added[2]}` array<struct<line: long, lines: long>>",
    )


def keep_first_chunks(docs: DataFrame) -> DataFrame:
    """The documents with what is left of their texts; those of which nothing is left are gone.

    All columns stay, whatever they are called; ``n_chars`` is set anew where there is such a column. Empty and
    missing texts stay; repeated rows and an empty table are treated as in ``remove_repeated_chunks``.
    """
    unlike = "_" * (1 + max(map(len, docs.columns)))
    added = tuple(unlike + name for name in ADDED)
    removed = F.col(f"`{added[1]}`")
    out = remove_repeated_chunks(docs, added).where((removed == 0) | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        length = F.when(removed > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return out.drop(*added)
