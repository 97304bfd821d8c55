"""Secrets in texts: fixed patterns, and strings that look random.

Whether a string looks random is a likelihood ratio of two character Markov models of first order.
Both are trained on all documents, labelled by the patterns: what they find counts as random, all
other identifier characters as ordinary; the random model is mixed with a uniform one. The models are sums of transition counts, one small table
whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from evidence_engine.llm.common import map_arrow, texts

#: Fixed: the patterns and the least length of what they must find (of the value, or of the whole).
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "markov")
#: Fixed: one of these must be there, in either case, for the first pattern.
KEYWORDS = (b"passw", b"secret", b"token", b"api")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_="
SYMBOLS = len(ALPHABET)
LEAST_RANDOM = 20
#: Nats per character that a string must be likelier as a random one.
MARGIN = 0.5
#: Weight of a uniform model beside the trained one of random strings: keys may use letters that no sample has.
UNIFORM = 0.5
#: Added to every transition's count.
SMOOTHING = 1.0

_CODE = np.full(256, 255, np.uint8)
_CODE[list(ALPHABET.encode())] = np.arange(SYMBOLS)
_IS_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_CANDIDATE = re.compile(rf"[{re.escape(ALPHABET)}]{{{LEAST_RANDOM},}}")


def base_spans(text: str) -> list[tuple[int, str, int, int, int]]:
    """``start, kind, end, value start, value end`` of what the patterns find, by start and kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= LEAST["assign"]:
            found.append((m.start(), "assign", m.end(), m.start(2), m.end(2)))
    for kind, pattern in (("access", ACCESS), ("hex", HEX)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= LEAST[kind]:
                found.append((m.start(), kind, m.end(), m.start(), m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def _longest(mask: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def may_match(text: bytes, data: np.ndarray) -> bool:
    """Cheap test; false only if no pattern finds anything."""
    lower = text.lower()
    return b"AKIA" in text or any(k in lower for k in KEYWORDS) or _longest(_IS_HEX[data]) >= LEAST["hex"]


def transitions(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring identifier characters."""
    code = _CODE[data].astype(np.int32)
    both = (code[1:] < 255) & (code[:-1] < 255)
    return np.bincount((code[:-1] * SYMBOLS + code[1:])[both], minlength=SYMBOLS**2)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: transitions in what the patterns find, and in all else."""
    random, everything = np.zeros(SYMBOLS**2, np.int64), np.zeros(SYMBOLS**2, np.int64)
    for batch in batches:
        for text in texts(batch.column(0)):
            if text is None:
                continue
            data = np.frombuffer(text, np.uint8)
            for at in range(0, len(data), 1 << 20):
                everything += transitions(data[at : at + (1 << 20) + 1])
            if may_match(text, data):
                value, end = text.decode(), 0
                for _, _, _, first, stop in sorted(base_spans(value), key=lambda s: s[3:]):
                    if stop > end:  # spans of two kinds may share characters
                        random += transitions(np.frombuffer(value[max(first, end) : stop].encode(), np.uint8))
                        end = stop
    ordinary = np.maximum(everything - random, 0)
    at = np.arange(SYMBOLS**2)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(random), pa.array(ordinary)], names=["at", "random", "ordinary"])


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of every transition."""
    counts = map_arrow(docs.select("text"), _training, "at long, random long, ordinary long")
    counts = counts.groupBy("at").agg(F.sum("random").alias("random"), F.sum("ordinary").alias("ordinary")).toPandas()
    model = {}
    for kind in ("random", "ordinary"):
        table = np.full(SYMBOLS**2, SMOOTHING)
        table[counts["at"].to_numpy(np.int64)] += counts[kind].to_numpy(np.float64)
        table = table.reshape(SYMBOLS, SYMBOLS)
        table /= table.sum(axis=1, keepdims=True)
        model[kind] = np.log(table if kind == "ordinary" else (1 - UNIFORM) * table + UNIFORM / SYMBOLS)
    return model["random"] - model["ordinary"]


def likeness(value: str, ratio: np.ndarray) -> float:
    """Mean log-likelihood ratio of the transitions of an identifier."""
    code = _CODE[np.frombuffer(value.encode(), np.uint8)]
    return float(ratio[code[:-1], code[1:]].mean())


def _found(ratio: np.ndarray):
    """Task: spans in each text."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                text = text or b""
                data = np.frombuffer(text, np.uint8)
                spans: list[tuple] = []
                base = may_match(text, data)
                if base or _longest(_CODE[data] < 255) >= LEAST_RANDOM:
                    value = text.decode()
                    spans = [(s, k, e) for s, k, e, _, _ in base_spans(value)] if base else []
                    taken = [(s, e) for s, _, e in spans]
                    for m in _CANDIDATE.finditer(value):
                        if all(e <= m.start() or m.end() <= s for s, e in taken) and likeness(m[0], ratio) >= MARGIN:
                            spans.append((m.start(), "markov", m.end()))
                    spans.sort(key=lambda s: (s[0], KINDS.index(s[1])))
                rows.append([{"kind": k, "start": s, "stop": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: kind, start and stop (code points, exclusive) of the secrets in each text, in order.

    What the patterns find stays, whatever the models say; the models add identifiers of 20 characters
    and more that touch none of these and look random. A missing text is empty; an empty text has no spans;
    one row comes back for each row, repeated or without id too; other columns are ignored; an empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(docs, _found(train(docs)), "doc_id long, spans array<struct<kind: string, start: long, stop: long>>")
