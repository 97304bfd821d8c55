"""Near duplicates by an LSH forest.

Each tree orders all texts by a label: MinHash values in an order of the tree's own. Texts that follow
each other in a tree share the longest prefixes there, however deep that is, so a crowded region is
told apart at a greater depth than a sparse one; neighbours become candidates from a least depth on.
The orders are range-partitioned sorts with the text's id as the last key: a region of any size is
spread over tasks. Candidates grow with texts x trees, never with pairs of a region.

At the least depth of 4, a pair of similarity 0.85 meets in a tree with probability 0.52, and in none
of 48 trees with 1e-15. Where others crowd between the two, rounds follow over the crowded regions only:
in a forest of new orders every text meets the nearest text before it that is of another component
(where either has links), and the nearest of the strongest hubs, texts with several links, before it that share its least
prefix. The original of many copies that are unlike each other soon has more links than any copy, so it is not
hidden by copies that have a few, and one round links the rest to it whatever their number. Rounds go on where
neighbours of the first forest lie in different components, and end with one that adds no link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from evidence_engine.llm.common import Scratch, keyed, map_arrow, materialize, named_rows, rows_without, texts
from evidence_engine.llm.components import components
from evidence_engine.llm.words import hashed, shingles

VALUES = 128
TREES = 48
DEPTH = 16
LEAST_DEPTH = 4
#: So many ids are sent to the texts; more are joined with them.
SENT_IDS = 250_000
#: Links from which on a hub is of the next level; level 1 is any hub.
LEVELS = (8, 32, 128)
#: Share of equal signature bytes below which a pair of the wanted similarity is over four deviations away.
MARGIN = 0.15

_RANDOM = np.random.default_rng(30_011)
_A, _B = (_RANDOM.integers(1, 2**31, (VALUES, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_ORDERS = np.stack([_RANDOM.permutation(VALUES)[:DEPTH] for _ in range(TREES)])


def signature(shingle_set: np.ndarray) -> np.ndarray:
    """One byte of each MinHash value; taken in slices, so that long texts need little memory."""
    low, high = shingle_set.astype(np.uint32), (shingle_set >> np.uint64(32)).astype(np.uint32)
    least = np.full(VALUES, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 4096):
        values = _A * low[at : at + 4096]
        values += _B * high[at : at + 4096]
        np.minimum(least, values.min(axis=1), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8)


def _signatures(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, first, second, signatures = [], [], [], []
            for found in hashed([t.lower() for t in texts(batch.column(2))]):
                found = shingles(found, words)
                digest = xxhash.xxh3_128_digest(found.tobytes())
                sizes.append(len(found))
                first.append(int.from_bytes(digest[:8], "big", signed=True))
                second.append(int.from_bytes(digest[8:], "big", signed=True))
                signatures.append(signature(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (sizes, first, second)), pa.array(signatures, pa.binary())],
                names=["doc_id", "h", "n_shingles", "c1", "c2", "signature"],
            )

    return run


def orders_of(number: int) -> np.ndarray:
    """The trees' orders of MinHash values in a round."""
    random = np.random.default_rng(30_011 + number)
    return np.stack([random.permutation(VALUES)[:DEPTH] for _ in range(TREES)])


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: a text's label in every tree, as two numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(ids), VALUES)
        for at in range(0, len(ids), 500):
            labels = np.ascontiguousarray(values[at : at + 500, _ORDERS]).view(">i8").astype(np.int64)
            n = len(labels)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array(labels[..., 0].ravel()), pa.array(labels[..., 1].ravel()), pa.array(np.repeat(ids[at : at + 500], TREES))],
                names=["tree", "a", "b", "id"],
            )


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: neighbours in a sorted part of the orders, and the part's first and last row (``edge`` 0 and 1)."""
    part, last = TaskContext.get().partitionId(), None

    def rows(tree, a, x, y, edge):
        n = len(x)
        edges = [pa.array([edge] * n, pa.int32()), pa.array([part] * n, pa.int32())]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.asarray(tree, np.int32)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(x, np.int64)), pa.array(np.asarray(y, np.int64)), *edges],
            names=["tree", "a", "x", "y", "edge", "part"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        tree, a, ids = (batch.column(i).to_numpy() for i in (0, 1, 3))
        if last is None:
            yield rows(tree[:1], a[:1], ids[:1], ids[:1], 0)
        else:
            tree, a, ids = (np.concatenate([l, v]) for l, v in zip(last, (tree, a, ids)))
        meet = (tree[1:] == tree[:-1]) & ((a[1:] ^ a[:-1]).view(np.uint64) >> np.uint64(64 - 8 * LEAST_DEPTH) == 0)
        x, y = ids[:-1][meet], ids[1:][meet]
        yield rows(tree[1:][meet], a[1:][meet], np.minimum(x, y), np.maximum(x, y), None)
        last = tree[-1:], a[-1:], ids[-1:]
    if last is not None:
        yield rows(last[0], last[1], last[2], last[2], 1)


def candidates(signatures: DataFrame) -> DataFrame:
    """``x, y``: different ids that are neighbours in some tree; signatures ``id, signature``."""
    scratch = Scratch(signatures.sparkSession)
    order = ["tree", "a", "b", "id"]
    sorted_rows = (
        map_arrow(signatures.select("id", "signature"), _labels, "tree int, a long, b long, id long")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
    )
    found = scratch.write(
        map_arrow(sorted_rows, _neighbours, "tree int, a long, x long, y long, edge int, part int"), "forest-neighbours"
    )
    ends = found.where("edge is not null")  # two rows for each part
    before = Window.orderBy("part", "edge")
    across = ends.select("*", *(F.lag(c).over(before).alias(f"last_{c}") for c in ("tree", "a", "x"))).where(
        F.expr(f"edge = 0 and tree = last_tree and shiftrightunsigned(a ^ last_a, {64 - 8 * LEAST_DEPTH}) = 0")
    )
    pairs = found.where("edge is null").select("x", "y").union(
        across.select(F.least("x", "last_x").alias("x"), F.greatest("x", "last_x").alias("y"))
    )
    pairs = materialize(pairs.where("x <> y").distinct(), "forest-pairs")
    scratch.clear()
    return pairs


def _crowded_labels(number: int):
    """Task: labels of a round, with the text's component, whether it has links, and its level as a hub (0: none)."""
    orders = orders_of(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, VALUES)
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3, 4)]
            for at in range(0, len(values), 500):
                labels = np.ascontiguousarray(values[at : at + 500, orders]).view(">i8").astype(np.int64)
                repeated = (pa.array(np.repeat(c[at : at + 500], TREES)) for c in columns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(labels))), pa.array(labels[..., 0].ravel()), pa.array(labels[..., 1].ravel()), *repeated],
                    names=["tree", "a", "b", "id", "component", "linked", "level"],
                )

    return run


def last_other(component: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each row the last earlier wanted row of another component; -1 without one."""
    n = len(component)
    at = np.flatnonzero(wanted)
    if not len(at):
        return np.full(n, -1)
    own = component[at]
    # The wanted row before the run of wanted rows of one component.
    start = np.maximum.accumulate(np.where(np.concatenate([[True], own[1:] != own[:-1]]), np.arange(len(at)), 0))
    before = np.where(start > 0, at[start - 1], -1)
    last = np.cumsum(wanted) - wanted - 1
    same = component[at[last]] == component
    return np.where(last < 0, -1, np.where(same, before[last], at[last]))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task: each text in a sorted part with the last text of another component (``kind`` 0), and the last of the strongest
    hubs (``kind`` is its least level) that share its least prefix.

    Rows with a missing ``y`` may have their partner in an earlier part, as the part begins within their
    prefix; rows with ``edge`` are what the next parts need: the last two wanted rows of different components.
    """
    part, carried, opening = TaskContext.get().partitionId(), None, None
    kinds = range(len(LEVELS) + 2)
    beyond = np.uint64(64 - 8 * LEAST_DEPTH)

    def rows(kind, edge, tree, a, x, of_x, linked, y):
        n = len(x)
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * n, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array(np.full(n, edge, np.int32)), pa.array(tree), pa.array(a), pa.array(x), pa.array(of_x), pa.array(linked), y],
            names=["part", "kind", "edge", "tree", "a", "x", "of_x", "linked", "y"],
        )

    def ends(now, wanted):
        """Positions of the last wanted row and the last one of another component, oldest first."""
        at = np.flatnonzero(wanted)
        if not len(at):
            return []
        others = at[now[3][at] != now[3][at[-1]]]
        return [*others[-1:], at[-1]]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4, 5, 6)]
        old = 0 if carried is None else len(carried[0])
        now = new if carried is None else [np.concatenate(p) for p in zip(carried, new)]
        tree, a, ids, component, linked, level = now
        if opening is None:
            opening = tree[0], a[0]
        first = (tree == opening[0]) & ((a ^ opening[1]).view(np.uint64) >> beyond == 0)
        keep, met = set(), np.zeros(len(ids), bool)
        for kind in reversed(kinds):
            wanted = level >= kind
            y = last_other(component, wanted)
            fits = y >= 0
            near = fits & (tree == tree[y]) & ((a ^ a[y]).view(np.uint64) >> beyond == 0)
            if kind == 0:
                near &= linked | linked[y]
            else:
                near &= ~met
                met |= near
            take = near | (~fits & first)
            take[:old] = False
            partner = pa.array(ids[y][take], pa.int64(), mask=~near[take])
            yield rows(kind, 0, tree[take], a[take], ids[take], component[take], linked[take], partner)
            keep.update(ends(now, wanted))
        keep = sorted(keep)
        carried = [c[keep] for c in now]
    if carried is not None:
        for kind in kinds:
            for edge, at in enumerate(reversed(ends(carried, carried[5] >= kind))):
                one = slice(at, at + 1)
                yield rows(kind, edge + 1, carried[0][one], carried[1][one], carried[2][one], carried[3][one], carried[4][one], pa.nulls(1, pa.int64()))


MET = "part int, kind int, edge int, tree int, a long, x long, of_x long, linked boolean, y long"


def crowded_candidates(texts_of: DataFrame, number: int) -> DataFrame:
    """``x, y``: ids of different components that meet in a round's forest; texts ``id, signature, component, linked, level``."""
    spark, scratch = texts_of.sparkSession, Scratch(texts_of.sparkSession)
    order = ["tree", "a", "b", "id"]
    labels = map_arrow(
        texts_of.select("id", "signature", "component", "linked", "level"),
        _crowded_labels(number),
        "tree int, a long, b long, id long, component long, linked boolean, level int",
    )
    met = scratch.write(map_arrow(labels.repartitionByRange(*order).sortWithinPartitions(*order), _met, MET), "forest-met")
    # Two rows for each part and kind at most; what a part lacks is the last that an earlier part has.
    kept: dict[int, list] = {kind: [] for kind in range(len(LEVELS) + 2)}
    handed = []
    edges = met.where("edge > 0").orderBy("part", F.desc("edge")).collect()
    for part, of_part in groupby(edges, itemgetter("part")):
        handed += [(part, kind, *r) for kind, last in kept.items() for r in last]
        for r in of_part:
            others = [o for o in kept[r["kind"]] if o[3] != r["of_x"]][-1:]
            kept[r["kind"]] = [*others, (r["tree"], r["a"], r["x"], r["of_x"], r["linked"])]
    before = spark.createDataFrame(handed, "part int, kind int, last_tree int, last_a long, last long, of_last long, last_linked boolean")
    across = met.where("edge = 0 and y is null").join(F.broadcast(before), ["part", "kind"]).where(
        F.expr(f"tree = last_tree and of_x <> of_last and (kind > 0 or linked or last_linked) and shiftrightunsigned(a ^ last_a, {64 - 8 * LEAST_DEPTH}) = 0")
    )
    pairs = met.where("edge = 0 and y is not null").select("x", "y").union(across.select("x", F.col("last").alias("y")))
    pairs = materialize(pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "forest-crowded")
    scratch.clear()
    return pairs


def _agreeing(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, VALUES) for i in (2, 3))
                alike = (left == right).mean(axis=1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(alike)], names=["x", "y", "alike"])
                yield out.filter(pa.array(alike >= share))

    return run


def _linked(words: int, percent: int):
    """Task: pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            left, right = (hashed([t.lower() for t in texts(batch.column(i))]) for i in (2, 3))
            for x, y in zip(left, right):
                x, y = shingles(x, words), shingles(y, words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"])
            yield out.filter(pa.array(good, pa.bool_()))

    return run


def joined_by(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links, from the labels before them."""
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links.select("u", "v")))


def hub_levels(links: DataFrame) -> DataFrame:
    """``id, level`` of every text with links: 0 for a leaf of a text with several links, else by its own number."""
    both = links.select("u", "v").where("u <> v")
    both = both.union(both.select("v", "u")).distinct()
    degree = both.groupBy("u").agg(F.count("*").alias("n"))
    of_partner = both.join(degree.select(F.col("u").alias("v"), "n"), "v").groupBy("u").agg(F.max("n").alias("most"))
    level = F.when(F.col("n") > 1, 1 + sum((F.col("n") >= least).cast("int") for least in LEVELS))
    return degree.join(of_partner, "u").select(
        F.col("u").alias("id"), level.otherwise(F.when(F.col("most") == 1, 1).otherwise(0)).alias("level")
    )


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, h, n_shingles, component_id, kept``: documents linked by the Jaccard similarity of shingle sets.

    A document's set holds its distinct runs of ``words`` lower-cased (A-Z) words, or all its words as
    one if there are fewer. Documents are linked if ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest ``doc_id`` that links reach, and ``kept`` marks it. A missing or
    empty text has an empty set and is linked with nothing. Rows with one id are one node: they share
    their component, and all links of their texts. A missing id is linked with nothing; its
    ``component_id`` is missing, and it is kept. One row comes back for each row; an empty table
    gives an empty table.
    """
    docs = keyed(docs)
    scratch = Scratch(docs.sparkSession)
    signed = scratch.write(
        map_arrow(docs, _signatures(words), "doc_id long, h long, n_shingles long, c1 long, c2 long, signature binary"),
        "forest-signatures",
    )
    nodes = signed.where("n_shingles > 0 and doc_id is not null")
    # Texts with equal sets are one class, named by its smallest id.
    classes = nodes.groupBy("c1", "c2").agg(F.min("doc_id").alias("class"))
    members = scratch.write(nodes.join(classes, ["c1", "c2"]).select("doc_id", "h", "class", "signature"), "forest-members")
    shown = members.where("doc_id = class").select(F.col("doc_id").alias("id"), "h", "signature").dropDuplicates(["id", "h"])
    pairs = candidates(shown)

    def alike(pairs: DataFrame) -> DataFrame:
        left = shown.select(F.col("id").alias("x"), F.col("signature").alias("left"))
        right = shown.select(F.col("id").alias("y"), F.col("signature").alias("right"))
        joined = pairs.join(left, "x").join(right, "y").select("x", "y", "left", "right")
        return scratch.write(map_arrow(joined, _agreeing(percent / 100 - MARGIN), "x long, y long, alike double"), "forest-likely")

    repeated = not nodes.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def sent(ids: DataFrame) -> DataFrame:
        """Written ids: up to ``SENT_IDS`` are sent to the texts, so that no text is shuffled to be found."""
        ids = scratch.write(ids, "forest-wanted")
        return F.broadcast(ids) if ids.count() <= SENT_IDS else ids

    def texts_of(ids: DataFrame) -> DataFrame:
        """``id, text`` of shown texts, from the documents."""
        named = sent(shown.select("id", F.col("h").alias("shown")).join(ids, "id"))
        found = docs.join(named, (F.col("doc_id") == F.col("id")) & (F.col("h") == F.col("shown"))).select("id", "text")
        return scratch.write(found.distinct() if repeated else found, "forest-texts")

    def in_pairs(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()

    def most_alike(likely: DataFrame) -> DataFrame:
        both = likely.select("x", "y", "alike").union(likely.select("y", "x", "alike"))
        best = both.groupBy("x").agg(F.max_by("y", F.struct("alike", "y")).alias("y"))
        return best.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()

    def verified(chosen: DataFrame, pool: DataFrame) -> DataFrame:
        first = pool.select(F.col("id").alias("x"), F.col("text").alias("left"))
        second = pool.select(F.col("id").alias("y"), F.col("text").alias("right"))
        joined = chosen.select("x", "y").join(first, "x").join(second, "y").select("x", "y", "left", "right")
        return map_arrow(joined, _linked(words, percent), "u long, v long")

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs that lie between two components, with these."""
        of = [found.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}")) for c in ("x", "y")]
        named = pairs.join(of[0], "x", "left").join(of[1], "y", "left")
        return named.select(*pairs.columns, F.coalesce("of_x", "x").alias("of_x"), F.coalesce("of_y", "y").alias("of_y")).where("of_x <> of_y")

    likely = alike(pairs)
    pool = texts_of(in_pairs(likely))
    # The most alike neighbour of every text first; then what still lies between two components.
    # Written, as it is used twice: what is left out below must be what was verified here.
    best = scratch.write(most_alike(likely), "forest-best")
    same_id = members.where("doc_id <> class").select(F.col("doc_id").alias("u"), F.col("class").alias("v"))
    named = same_id.join(nodes.groupBy("doc_id").agg(F.count_distinct("h").alias("texts")).where("texts > 1").select(F.col("doc_id").alias("u")), "u", "left_semi")
    links = scratch.write(verified(best, pool), "forest-links")
    found = components(links)
    open_pairs = apart(likely, found).select("x", "y").join(best, ["x", "y"], "left_anti")
    more = scratch.write(verified(open_pairs, pool), "forest-more-links").union(named)
    links = links.union(more)
    found = joined_by(found, more)

    # Regions where neighbours lie in different components: all texts of these go on, in new orders, until a round adds no link.
    between = scratch.write(apart(pairs, found), "forest-between")
    tried, number, active = likely.select("x", "y"), 1, shown
    while not between.isEmpty():
        crowded = between.select(F.col("of_x").alias("component")).union(between.select("of_y")).distinct()
        # Components are only joined, so the texts that go on are among those of the last round.
        active = (
            active.select("id", "signature")
            .join(found.withColumnRenamed("node", "id"), "id", "left")
            .withColumn("component", F.coalesce("component", "id"))
            .join(crowded, "component", "left_semi")
            .join(hub_levels(links), "id", "left")
            .select("id", "signature", "component", F.col("level").isNotNull().alias("linked"), F.coalesce("level", F.lit(0)).alias("level"))
        )
        active = scratch.write(active, "forest-active")
        if number == 1:  # what goes on has been read before, but for texts that are linked by an id alone
            unread = active.select("id").join(pool.select("id"), "id", "left_anti")
            if not unread.isEmpty():
                pool = pool.union(texts_of(unread))
        # Signatures first: only pairs that are likely can have been tried, and the others need not be sought there.
        fresh = scratch.write(alike(crowded_candidates(active, number)).join(tried, ["x", "y"], "left_anti"), "forest-fresh")
        texts_now = scratch.write(pool.join(sent(in_pairs(fresh)), "id"), "forest-texts")
        # The most alike partner first, as above: a text meets many texts of one component.
        first = scratch.write(most_alike(fresh), "forest-best")
        added = scratch.write(verified(first, texts_now), "forest-added-links")
        now = joined_by(found, added)
        # A few of the first may be among the rest, not linked again: one for each text at most.
        rest = apart(fresh, now).select("x", "y")
        more = scratch.write(verified(rest, texts_now), "forest-more-links")
        if not more.isEmpty():
            now = joined_by(now, more)
            added = added.union(more)
        if added.isEmpty():
            break
        links, tried, number, found = links.union(added), tried.union(fresh.select("x", "y")), number + 1, now
        between = scratch.write(apart(between.select("x", "y"), found), "forest-between")
    of_class = members.select("doc_id", "h", "class").distinct().join(found.withColumnRenamed("node", "class"), "class", "left")
    reached = of_class.groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("reached"))
    out = signed.join(reached, "doc_id", "left").select(
        "doc_id",
        "h",
        "n_shingles",
        F.coalesce("reached", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("reached", "doc_id"), F.lit(True)).alias("kept"),
    )
    out = materialize(out, "forest-components")
    scratch.clear()
    return out


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns, whatever these are called.

    Of rows with one id and one text one stays. Documents without id, without text or with an empty one stay;
    an empty table gives an empty one. The names of what goes, not of what stays, are joined to the texts.
    """
    found = near_duplicates(docs, words, percent)
    left = rows_without(docs, found.where("not kept"))
    again = found.where("kept").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return left
    return named_rows(left).dropDuplicates(["id", "h"]).select("row.*")
