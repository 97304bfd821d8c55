"""Overlapping character windows of one text as a column expression."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

from evidence_engine import fixed_values as fv

# Windows of so many texts are turned into Arrow arrays together.
_TOGETHER = 200

_WINDOWS = "array<struct<start:int,end:int,text:string>>"


TOO_SMALL = f"chunk size must be at least {fv.MIN_CHUNK_SIZE}"
BAD_OVERLAP = "overlap must be at least 0 and below the chunk size"


def check_chunk_params(size: int, overlap: int) -> None:
    if size < fv.MIN_CHUNK_SIZE:
        raise ValueError(f"{TOO_SMALL}, got {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"{BAD_OVERLAP}, got {overlap} and {size}")


def chunk_params_problem(size: Column, overlap: Column) -> Column:
    """The same check for a table of settings: the complaint, NULL if there is none."""
    return F.when(size < fv.MIN_CHUNK_SIZE, TOO_SMALL).when(
        ~((overlap >= 0) & (overlap < size)), BAD_OVERLAP
    )


def _cut(size: int, overlap: int):
    """Task: the windows of each text of a batch. Everything it needs is in here, so workers need no package."""
    search_from, together = int(size * fv.BREAK_SEARCH_FROM), _TOGETHER
    marks, blanks = fv.BREAK_MARKS, fv.WHITESPACE

    def windows(text: str) -> Iterator[tuple[int, int, str]]:
        start, length = 0, len(text)
        while start < length:
            end = min(start + size, length)
            if end < length:
                # Behind the last cut point in the window's tail, else the hard end.
                last = max(text.rfind(mark, start + search_from, end) for mark in marks)
                end = last + 1 if last >= 0 else end
            stripped = text[start:end].strip(blanks)
            if stripped:
                yield start, end, stripped
            start = max(end - overlap, start + 1) if end < length else length

    def arrays(texts: pa.Array) -> pa.Array:
        rows, ends = [], [0]
        for text in texts.cast(pa.large_binary()).to_pylist():
            rows += windows((text or b"").decode("utf-8", "replace"))
            ends.append(len(rows))
        starts, stops, found = zip(*rows) if rows else ((), (), ())
        columns = [pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(found, pa.string())]
        items = pa.StructArray.from_arrays(columns, names=["start", "end", "text"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [arrays(texts.slice(at, together)) for at in range(0, len(texts), together)]
            yield pa.concat_arrays(parts or [arrays(texts)])
        pa.default_memory_pool().release_unused()  # the worker outlives its tasks

    return cut


def chunk_windows(normalized: Column, size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> Column:
    """``ARRAY<STRUCT<start, end, text>>`` of the non-blank windows of a normalized text.

    Offsets count code points of the normalized text before the window is stripped. A window
    starts where its predecessor ends less ``overlap``, so a text is cut from its beginning to its end, in linear time.
    """
    check_chunk_params(size, overlap)
    return F.arrow_udf(_cut(size, overlap), _WINDOWS)(normalized)
