"""Packing of tokenized documents into sequences by best-fit decreasing.

Best fit looks at lengths alone, so the whole corpus is planned from a histogram of its piece lengths,
which has one row for each length up to the capacity whatever the corpus. Open bins with equal
remaining capacity are kept as intervals of sequence numbers, under a segment tree over the
remaining capacities that gives the tightest one in logarithmic time. Pieces of one length are
interchangeable: a piece finds its place by its rank among the pieces of its length, and ranks
come from counts per task and length, so no task ever holds more than its own pieces.
"""

from __future__ import annotations

import itertools
import json
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evidence_engine.llm.common import Scratch, map_arrow, materialize, texts

CAPACITY = 4096
END_ID = 1
PUNCTUATION = string.punctuation.encode()
#: Words, and stems, whose ids a Python worker remembers: a few ten thousand words are most of any text, and a worker stays.
REMEMBERED = 200_000


class WordIds:
    """Token ids of texts as little-endian bytes; the ids of a word do not depend on its neighbours.

    The tokenizer lower-cases, and a letter and the punctuation behind it are never one token. So a new
    word is put together from its lower-cased stem and its trailing punctuation, and only new stems
    and marks are encoded, many at a time.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        model = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.marks = [t["content"].lower().encode() for t in model.get("added_tokens", ())]
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        suffix = model["model"].get("end_of_word_suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, stems: list[bytes]) -> None:
        """Encode stems. Those of letters alone are one pre-token each, and end with an end-of-word token."""
        letters = []
        for stem in stems:
            text = stem.decode()
            if text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha():
                letters.append((stem, text))
            else:
                self.stems[stem] = self._ids(text).tobytes()
        for at in range(0, len(letters), 200):
            group = letters[at : at + 200]
            ids = self._ids(" ".join(text for _, text in group))
            ends = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(ends) == len(group):
                data = ids.tobytes()
                parts = [data[a:b] for a, b in zip([0, *ends], ends)]
            else:  # a tokenizer without such tokens
                parts = [self._ids(text).tobytes() for _, text in group]
            self.stems.update((stem, part) for (stem, _), part in zip(group, parts))

    def _know(self, stems: Iterator[bytes]) -> None:
        """Have the ids of stems, those of the last generation too."""
        older = self.older
        missing = [s for s in dict.fromkeys(stems) if s not in self.stems]
        self.stems.update((s, older[s]) for s in missing if s in older)
        self._learn([s for s in missing if s not in older])

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        split = [text.split() for text in texts]
        if len(self.words) > REMEMBERED:
            self.words = {}
        if len(self.stems) > REMEMBERED:
            self.stems, self.older = {}, self.stems
        unknown = itertools.filterfalse(self.words.__contains__, itertools.chain.from_iterable(split))
        new = list(dict.fromkeys(unknown))
        all_new = b" ".join(new).lower()
        marks = [mark for mark in self.marks if mark in all_new]
        if marks:
            for word in [w for w in new if any(mark in w.lower() for mark in marks)]:
                self.words[word] = self._ids(word.decode()).tobytes()
            new = [w for w in new if w not in self.words]
            all_new = b" ".join(new).lower()
        # A word without trailing punctuation is its own stem, and so is one whose rest does not end with a letter.
        lower = all_new.split()
        stems = [w.rstrip(PUNCTUATION) for w in lower]
        stems = [stem if stem[-1:].isalpha() else w for stem, w in zip(stems, lower)]
        ended = [(word, stem, w[len(stem) :]) for word, stem, w in zip(new, stems, lower) if len(stem) < len(w)]
        self._know(itertools.chain(stems, (end for _, _, end in ended)))
        known = self.stems
        self.words.update(zip(new, map(known.__getitem__, stems)))
        self.words.update((word, known[stem] + known[end]) for word, stem, end in ended)
        return [b"".join(map(self.words.__getitem__, words)) for words in split]


#: One for each tokenizer that a Python worker has used; a worker serves many tasks.
_WORD_IDS: dict[str, WordIds] = {}


def word_ids(tokenizer_json: str) -> WordIds:
    if tokenizer_json not in _WORD_IDS:
        _WORD_IDS[tokenizer_json] = WordIds(tokenizer_json)
    return _WORD_IDS[tokenizer_json]


def _pieces(tokenizer_json: str, capacity: int, end_id: int):
    """Task: the pieces of each document, with their ranks among the task's pieces of their length."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = word_ids(tokenizer_json)
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "rank", "part"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            rows = []
            values = [text or b"" for text in texts(batch.column(1))]
            groups = (ids.encode_all(values[at : at + 500]) for at in range(0, len(values), 500))
            for doc, text_ids in zip(batch.column(0).to_pylist(), itertools.chain.from_iterable(groups)):
                data = memoryview(text_ids + end)
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part_ids = data[at : at + 4 * capacity]
                    length = len(part_ids) // 4
                    rows.append((doc, piece, at // 4, length, zlib.crc32(part_ids), seen[length], part))
                    seen[length] += 1
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


class TightestFirst:
    """Segment tree over remaining capacities: intervals of bins, found by the least capacity that is enough."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, remaining: int) -> None:
        at = remaining + self.size
        self.open[at] = bool(self.bins[remaining])
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def push(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.bins[remaining].append((first, count))
            self._mark(remaining)

    def pop(self, needed: int) -> tuple[int, int, int] | None:
        at = needed + self.size
        while not self.open[at]:  # up, to the next subtree on the right
            while at % 2:
                at //= 2
                if at <= 1:
                    return None
            at += 1
        while at < self.size:  # down, to its least capacity
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        remaining = at - self.size
        first, count = self.bins[remaining].pop()
        self._mark(remaining)
        return remaining, first, count


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing of a histogram of lengths.

    Rows ``length, first rank, first bin, offset, pieces per bin``: the pieces of that length from that
    rank on go to consecutive bins, several side by side in each.
    """
    tree, bins, rows = TightestFirst(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            remaining, first, count = tree.pop(length) or (capacity, bins, left)
            each = remaining // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0  # fewer than fill a bin
            if full:
                rows.append((length, rank, first, capacity - remaining, each))
                tree.push(remaining - each * length, first, full)
            if rest:
                rows.append((length, rank + full * each, first + full, capacity - remaining, rest))
                tree.push(remaining - rest * length, first + full, 1)
            used = full + bool(rest)
            if first == bins:
                bins += used
            else:
                tree.push(remaining, first + used, count - used)
            rank += full * each + rest
            left -= full * each + rest
    return np.array(rows, np.int64).reshape(-1, 5)


def _placed(table: np.ndarray):
    """Task: a piece's bin and offset from its length and rank; ``table`` is sorted."""
    keys = table[:, 0] << 44 | table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = table[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence = row[:, 2] + within // row[:, 4]
            offset = row[:, 3] + within % row[:, 4] * length
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every document.

    A document is its token ids and ``end_id``; only those longer than ``capacity`` are cut. Each
    sequence is filled from 0 without gaps. A missing or empty text is one piece with ``end_id``
    alone; rows that repeat, and missing ids, are packed like any other row; other columns are
    ignored; an empty table gives an empty table. ``tokenizer_file`` is read by the driver.
    """
    with open(tokenizer_file, encoding="utf-8") as file:
        tokenizer_json = file.read()
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(
        map_arrow(
            docs.select(F.col("doc_id").cast("long"), "text"),
            _pieces(tokenizer_json, capacity, end_id),
            "doc_id long, piece int, start long, length long, ids_crc32 long, rank long, part int",
        ),
        "pack-pieces",
    )
    counts = scratch.write(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = plan(histogram, capacity)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank")
    )
    packed = materialize(
        map_arrow(
            ranked,
            _placed(table),
            "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
        ),
        "packed",
    )
    scratch.clear()
    return packed
