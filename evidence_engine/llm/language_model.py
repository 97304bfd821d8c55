"""A log-bilinear language model, trained with noise-contrastive estimation.

The score of a word after two others is ``(u[first] + v[second]) . r[word] + b[word]``, over the most
frequent training words, the end of a text, and one class for all other words, whose members share it
by their smoothed counts. Training runs on every task's own texts, against noise words drawn from the
word frequencies; after each pass the tasks' parameters are averaged, weighted by their tokens.

Because the score is a sum of two parts, the normaliser of every context is one entry of a product of
two matrices, so all of them are computed at once, and a text's probability takes three look-ups
for each token.

Counts cover all training texts. The most frequent words, at most ``COMMON`` of them, go to the tasks as
a table; other words are joined to their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine.llm.common import Scratch, map_arrow, texts

CLASSES = 1024
SIZE = 16
NOISE = 64
BATCH = 2048
ROUNDS = 2
RATE = 0.05
#: Words whose counts every task holds.
COMMON = 1 << 17
#: Distinct words that a task counts before it passes them on.
HELD = 300_000

END, OTHER = 0, 1


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a missing id counts as an empty string, and trains."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: words and how often they occur; a null word for the texts' ends."""

    def rows(counts: Counter, ends: int) -> pa.RecordBatch:
        words, n = list(counts), list(counts.values())
        return pa.RecordBatch.from_arrays(
            [pa.array([None, *words], pa.binary()), pa.array([ends, *n], pa.int64())], names=["word", "c"]
        )

    counts: Counter = Counter()
    for batch in batches:
        for text in texts(batch.column(0)):
            counts.update(text.lower().split())
            if len(counts) > HELD:
                yield rows(counts, 0)
                counts = Counter()
        yield rows(Counter(), batch.num_rows)
    yield rows(counts, 0)


class Model:
    """Parameters ``u, v, r`` (a row for each class), ``b``, and the words of the classes from 2 on."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        random = np.random.default_rng(70_001)
        n = len(words) + 2
        self.ids = {word: i + 2 for i, word in enumerate(words)}
        self.noise = counts / counts.sum()
        self.u, self.v, self.r = (random.normal(0, 0.1, (n, SIZE)).astype(np.float32) for _ in range(3))
        self.b = np.log(self.noise).astype(np.float32)

    def stream(self, text: bytes) -> np.ndarray:
        """Classes of a text, after two ends as its first context and up to its own end."""
        get = self.ids.get
        return np.array([END, END, *(get(w, OTHER) for w in text.lower().split()), END], np.int32)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by first and by second context word, and the log normaliser of each pair of them."""
        first, second = self.u @ self.r.T, self.v @ self.r.T + self.b
        top_first, top_second = first.max(axis=1, keepdims=True), second.max(axis=1, keepdims=True)
        product = np.exp(first - top_first).astype(np.float64) @ np.exp(second - top_second).astype(np.float64).T
        return first, second, (np.log(product) + top_first + top_second.T).astype(np.float32)


def _add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    for column in range(rows.shape[1]):
        target[:, column] += np.bincount(at, weights=rows[:, column], minlength=len(target))


class Trainer:
    """Noise-contrastive estimation with AdaGrad, in batches that share their noise words."""

    def __init__(self, model: Model, seed: int):
        self.model, self.random = model, np.random.default_rng(seed)
        self.sums = {name: np.ones(getattr(model, name).shape, np.float32) for name in "uvrb"}
        self.edges = np.cumsum(model.noise)

    def step(self, first: np.ndarray, second: np.ndarray, word: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), len(self.edges) - 1)
        log_noise = np.log(NOISE * m.noise)
        context = m.u[first] + m.v[second]
        true = np.einsum("ij,ij->i", context, m.r[word]) + m.b[word] - log_noise[word]
        false = context @ m.r[noise].T + (m.b[noise] - log_noise[noise]).astype(np.float32)
        g_true = (-1 / (1 + np.exp(np.minimum(true, 30)))).astype(np.float32)
        g_false = (1 / (1 + np.exp(-np.maximum(false, -30)))).astype(np.float32)
        g_context = g_true[:, None] * m.r[word] + g_false @ m.r[noise]
        grads = {name: np.zeros_like(getattr(m, name)) for name in "uvrb"}
        _add_rows(grads["u"], first, g_context)
        _add_rows(grads["v"], second, g_context)
        _add_rows(grads["r"], word, g_true[:, None] * context)
        np.add.at(grads["r"], noise, g_false.T @ context)
        grads["b"] += np.bincount(word, weights=g_true, minlength=len(m.b)).astype(np.float32)
        np.add.at(grads["b"], noise, g_false.sum(axis=0))
        for name, grad in grads.items():
            self.sums[name] += grad * grad
            getattr(m, name).__isub__(RATE * grad / np.sqrt(self.sums[name]))


def _trained(model: Model, seed: int):
    """Task: parameters after one pass over the task's texts, as rows; ``weight`` is its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        own = copy.deepcopy(model)
        trainer = Trainer(own, seed + TaskContext.get().partitionId())
        waiting: list[np.ndarray] = []
        size = total = 0

        def learn() -> None:
            nonlocal total
            first, second, word = (np.concatenate([s[i : len(s) - 2 + i] for s in waiting]) for i in range(3))
            for at in range(0, len(word), BATCH):
                trainer.step(first[at : at + BATCH], second[at : at + BATCH], word[at : at + BATCH])
            total += len(word)

        for batch in batches:
            for text in texts(batch.column(0)):
                waiting.append(own.stream(text))
                size += len(waiting[-1]) - 2
                if size >= 32 * BATCH:
                    learn()
                    waiting, size = [], 0
        if waiting:
            learn()
        if total:
            flat = np.concatenate([getattr(own, name).ravel() for name in "uvrb"])
            pieces = np.split(flat, range(4096, len(flat), 4096))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(len(pieces), dtype=np.int32)),
                    pa.array([(p.astype(np.float64) * total).tolist() for p in pieces], pa.list_(pa.float64())),
                    pa.array([float(total)] * len(pieces)),
                ],
                names=["piece", "sums", "weight"],
            )

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: parameter rows added up, before they are shuffled and after."""
    sums: dict[int, np.ndarray] = {}
    weights: Counter = Counter()
    for batch in batches:
        for piece, values, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            values = values.values.to_numpy()
            sums[piece] = sums[piece] + values if piece in sums else values.copy()
            weights[piece] += weight
    if sums:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64())), pa.array([float(weights[p]) for p in sums])],
            names=["piece", "sums", "weight"],
        )


PARAMETERS = "piece int, sums array<double>, weight double"


def train(rows: DataFrame, model: Model, rounds: int = ROUNDS) -> Model:
    """``rows`` are texts; every round is one pass over all of them."""
    for number in range(rounds):
        trained = map_arrow(rows, _trained(model, 1000 * number), PARAMETERS)
        # Each parameter piece is summed in one of a few tasks; what the driver gets is one model.
        summed = map_arrow(trained.repartition(16, "piece"), _summed, PARAMETERS).collect()
        if not summed:
            return model
        flat = np.concatenate([np.array(r["sums"]) / r["weight"] for r in sorted(summed, key=lambda r: r["piece"])])
        at = 0
        for name in "uvrb":
            shape = getattr(model, name).shape
            size = int(np.prod(shape))
            setattr(model, name, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
    return model


def _scored(model: Model, tables: tuple, common: dict[bytes, int], total: float, log_rest: float):
    """Task: each text's scores as far as common words go, and its other words.

    ``total`` is the denominator of the smoothed counts; words outside the classes share ``log_rest``.
    """
    first_table, second_table, norms = tables
    log10 = float(np.log(10))
    ends = float(np.log10((common[b""] + 0.5) / total))
    logs = {word: float(np.log10((c + 0.5) / total)) for word, c in common.items() if word}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        kind = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in texts(batch.column(1)):
                words = text.lower().split()
                s = model.stream(text)
                a, b, w = s[:-2], s[1:-1], s[2:]
                log_p = (first_table[a, w] + second_table[b, w] - norms[a, b]).sum(dtype=np.float64)
                known = list(map(logs.get, words))
                rare = Counter(x for x, y in zip(words, known) if y is None)
                base = sum(y for y in known if y is not None)
                inside = sum(y for y, c in zip(known, w.tolist()) if y is not None and c == OTHER)
                others = int((w[:-1] == OTHER).sum())
                n_rare = rare.total()
                for column, value in zip(
                    out,
                    (
                        number,
                        len(words) + 1,
                        len(words) - n_rare + (common[b""] > 0),
                        base + ends,
                        float(log_p) / log10 + inside - others * log_rest,
                        [{"word": x, "n": n} for x, n in rare.items()],
                    ),
                ):
                    column.append(value)
                number += 1
            arrays = [batch.column(0), batch.column(2)]
            arrays += [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind))]
            yield pa.RecordBatch.from_arrays(
                arrays, names=["doc_id", "held_out", "row", "n_tokens", "n_common", "base", "model", "rare"]
            )

    return run


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every document.

    Tokens are lower-cased (A-Z) words and one end. The base is a unigram model with half a count added;
    ``score`` is the log-bilinear model's, normalised over all words: both are log10 probabilities. A
    missing or empty text is its end alone; rows that repeat are scored alike, one row for each; a
    missing id belongs to the training texts; other columns are ignored; an empty table gives an empty
    table. Without training texts nothing is known, and both scores are those of an unseen word.
    """
    scratch = Scratch(docs.sparkSession)
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held_out(doc_id).alias("held_out"))
    training = rows.where("not held_out").select("text")
    counts = scratch.write(
        map_arrow(training, _counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"),
        "lm-counts",
    )
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total = n + 0.5 * (distinct + 1)
    top = counts.where("word is not null").orderBy(F.desc("c"), "word").limit(COMMON).collect()
    common = {bytes(r["word"]): r["c"] for r in top}
    end_count = (counts.where("word is null").first() or {"c": 0})["c"]

    words = list(common)[: CLASSES - 2]
    in_classes = np.array([end_count, *(common[w] for w in words)], np.float64) + 0.5
    rest = max(total - in_classes.sum(), 0.5)
    model = Model(words, np.concatenate([in_classes[:1], [rest], in_classes[1:]]))
    model = train(training, model)
    log_rest = float(np.log10(rest / total))
    common[b""] = end_count
    scored = scratch.write(
        map_arrow(
            rows.select("doc_id", "text", "held_out"),
            _scored(model, model.tables(), common, total, log_rest),
            "doc_id long, held_out boolean, row long, n_tokens long, n_common long, base double, model double, "
            "rare array<struct<word: binary, n: long>>",
        ),
        "lm-scored",
    )
    rare = (
        scored.select("row", F.inline("rare"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("n") * F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(total))).alias("rare_base"),
            F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"),
        )
    )
    rare_base = F.coalesce("rare_base", F.lit(0.0))
    out = scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_common") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + rare_base).alias("base_score"),
        (F.col("model") + rare_base).alias("score"),
    )
    return out
