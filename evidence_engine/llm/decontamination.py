"""Benchmark passages in documents by spaced seeds.

A fixed mask looks at some of the tokens of a span and ignores the others, so one seed survives a
substitution under an ignored position, and of several masks one usually does. Seeds of all positions
of documents and benchmark items are joined by hash; each hit proposes an alignment, which is verified
token by token. All of it is DataFrame operations: tokens are hashed once, the spans are zipped
slices, and both run in generated code.

The benchmark's seeds go to the documents in blocks of at most ``BLOCK_ROWS`` rows, each broadcast, so
documents are only shuffled for those with hits.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine.llm.common import Scratch, keyed, materialize, rows_without, with_info

#: Tokens that an item has at least, and the masks (the tokens that each looks at) for items of so many tokens
#: up to the next family. Each family leaves no pattern of substitutions within the tolerance unhit.
FAMILIES = (
    (1, ((0,),)),
    (2, ((0, 1),)),
    (3, ((0, 1, 2),)),
    (4, ((0, 1, 2, 3),)),
    (5, ((0, 1, 3), (0, 2, 3))),
    (8, ((0, 1, 2, 4, 5), (0, 3, 4, 5, 7))),
    (10, ((0, 1, 3, 5, 6), (0, 2, 3, 6, 7), (0, 1, 2, 3, 4))),
    (13, ((0, 1, 3, 4, 5, 6), (0, 1, 2, 3, 11, 12))),
)
MASKS = tuple(mask for _, masks in FAMILIES for mask in masks)
SPAN = 1 + max(map(max, MASKS))
#: Items of fewer tokens are phrases of which a document is not cleaned.
SHORTEST = 5
#: An overlap counts if this many aligned tokens (all of a shorter item) ...
WINDOW = 13
#: ... agree in at least this share.
PERCENT = 80
#: Seeds that are broadcast at once.
BLOCK_ROWS = 1_000_000
#: Tokens of a document that are zipped at once.
PIECE = 4_000


def tokens(text: Column) -> Column:
    """Hashes of the runs of letters and digits, lower-cased."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def family_of(size: Column) -> Column:
    """Number of the family of masks for items of ``size`` tokens; -1 for none."""
    return sum((F.when(size >= least, 1).otherwise(0) for least, _ in FAMILIES), F.lit(-1))


def seeds(rows: DataFrame, *keys: str, families: Iterable[int] = range(len(FAMILIES))) -> DataFrame:
    """``keys, at, seed`` for every mask of the ``families`` at every position of ``tokens`` where it fits."""
    masks = [mask for family in families for mask in FAMILIES[family][1]]
    pieces = rows.select(
        *keys,
        "tokens",
        F.explode(F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(PIECE))).alias("first"),
    ).select(*keys, "first", F.slice("tokens", F.col("first") + 1, F.lit(PIECE + SPAN - 1)).alias("tokens"))
    used = sorted({o for mask in masks for o in mask})
    count = F.least(F.size("tokens"), F.lit(PIECE))
    zipped = F.arrays_zip(
        F.sequence(F.lit(0), count - 1), *(F.slice("tokens", F.lit(o + 1), count) for o in used)
    )
    names = ["i", *(f"t{o}" for o in used)]
    spans = pieces.where(F.size("tokens") > 0).select(*keys, "first", F.inline(zipped).alias(*names))
    kinds = [
        F.when(F.col(f"t{mask[-1]}").isNotNull(), F.xxhash64(F.lit(MASKS.index(mask)), *(F.col(f"t{o}") for o in mask)))
        for mask in masks
    ]
    return (
        spans.select(*keys, (F.col("first") + F.col("i")).alias("at"), F.explode(F.array(*kinds)).alias("seed"))
        .where("seed is not null")
    )


def _best_window(equal: Column, size: Column) -> Column:
    """Most ones in any ``size`` neighbouring entries, of which there are at most ``WINDOW``."""
    ends = F.sequence(F.lit(1), F.size(equal) - size + 1)
    return F.array_max(F.transform(ends, lambda i: F.aggregate(F.slice(equal, i, size), F.lit(0), lambda acc, x: acc + x)))


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, h, item_id, doc_token, n_equal, n_tokens``: each document's best alignment with each item it overlaps.

    Tokens are runs of letters and digits, lower-cased. An alignment counts if in some ``WINDOW``
    neighbouring aligned tokens (in all of an item with fewer) at least 80 percent are equal, and the masks
    hit every such alignment; ``n_equal`` of ``n_tokens`` aligned tokens are equal in all, and the item's first
    token lies at ``doc_token`` (negative if the document begins later). Of equally good alignments the
    first is given. Items of fewer than five tokens must be equal. Missing or empty
    texts overlap nothing; repeated documents are reported once; repeated or missing item ids are one
    item each with its text; other columns are ignored; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    docs = keyed(docs)
    items = scratch.write(
        benchmark.select("item_id", tokens(F.col("text")).alias("tokens")).distinct(), "benchmark-items"
    ).withColumns({"item": F.xxhash64("item_id", "tokens"), "n_item": F.size("tokens")})
    held = items.select(family_of(F.col("n_item")).alias("family")).where("family >= 0").distinct()
    families = sorted(row["family"] for row in held.collect())  # eight at most
    own = [
        seeds(items.where(family_of(F.col("n_item")) == family), "item", "n_item", families=[family]) for family in families
    ]
    columns = "seed", "item", "n_item", F.col("at").alias("item_at")
    own = reduce(DataFrame.union, own, seeds(items.where("false"), "item", "n_item"))
    sought = scratch.write(own.select(*columns).distinct(), "benchmark-seeds")
    found = None
    blocks = -(-sought.count() // BLOCK_ROWS)
    rows = docs.select("doc_id", "h", tokens(F.col("text")).alias("tokens"))
    for block in range(blocks):
        part = sought.where(F.pmod(F.xxhash64("seed"), F.lit(blocks)) == block) if blocks > 1 else sought
        hits = (
            seeds(rows, "doc_id", "h", families=families)
            .join(F.broadcast(part), "seed")
            .select("doc_id", "h", "item", "n_item", (F.col("at") - F.col("item_at")).alias("shift"))
            .distinct()
        )
        hits = scratch.write(hits, "benchmark-hits")
        found = hits if found is None else found.union(hits)
    if found is None:
        nothing = F.lit(0).cast("long").alias("item"), F.lit(0).alias("n_item"), F.lit(0).alias("shift")
        found = docs.select("doc_id", "h", *nothing).where("false")
    by_document = found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("item", "n_item", "shift")).alias("hits"))
    first = F.greatest(F.col("shift"), F.lit(0))
    skipped = F.greatest(-F.col("shift"), F.lit(0))
    # Of a document's tokens a hit takes along those that it aligns, no more than the item has.
    aligned = (
        with_info(docs, by_document, "inner")
        .select("doc_id", "h", tokens(F.col("text")).alias("text_tokens"), F.explode("hits").alias("hit"))
        .select("doc_id", "h", "hit.item", "hit.n_item", "hit.shift", "text_tokens")
        .withColumn("n_tokens", F.least(F.col("n_item") - skipped, F.size("text_tokens") - first))
        .withColumn("window", F.least(F.lit(WINDOW), F.col("n_item")))
        .where("n_tokens >= window")
        .withColumn("text_tokens", F.slice("text_tokens", first + 1, F.col("n_tokens")))
        .join(items.select("item", "item_id", "tokens"), "item")
        .withColumn(
            "equal",
            F.zip_with(
                "text_tokens",
                F.slice("tokens", skipped + 1, F.col("n_tokens")),
                lambda a, b: F.when(a == b, 1).otherwise(0),
            ),
        )
        .select("doc_id", "h", "item_id", "item", "shift", "n_tokens", "equal", "window")
        .withColumn("best", _best_window(F.col("equal"), F.col("window")))
        .where(F.col("best") * 100 >= F.col("window") * PERCENT)
    )
    total = F.aggregate("equal", F.lit(0), lambda acc, x: acc + x)
    best = aligned.groupBy("doc_id", "h", "item_id", "item").agg(
        F.max(F.struct(total.alias("n_equal"), (-F.col("shift")).alias("back"), "n_tokens")).alias("top")
    )
    out = materialize(
        best.select(
            "doc_id",
            "h",
            "item_id",
            (-F.col("top.back")).cast("long").alias("doc_token"),
            F.col("top.n_equal").cast("long").alias("n_equal"),
            F.col("top.n_tokens").cast("long").alias("n_tokens"),
        ),
        "overlaps",
    )
    scratch.clear()
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap no benchmark item, with all their columns, whatever these are called.

    Items of fewer than ``SHORTEST`` tokens do not count. Rows with one id and one text go together; a missing
    or empty text overlaps nothing and stays; an empty table gives an empty one, an empty benchmark leaves all.
    """
    passages = benchmark.where(F.size(tokens(F.col("text"))) >= SHORTEST)
    return rows_without(docs, find_overlaps(docs, passages))
