"""Grouping of spelling variants by asymmetric q-chunks.

A word of ``L`` letters is cut into two disjoint chunks of ``L // 2`` letters, its head and its tail.
One insertion, deletion or replacement leaves one of them whole: in the other word it stands where it
stood, or one place on. So of two words that differ by one edit the one gives its two chunks,
and the other its positional grams of the same length; both meet in a join on chunk and place, and an
edit distance confirms them. The shorter word is the one that is cut, so a pair comes up once. A gram's
place follows from the two lengths (a head stays, a tail moves by their difference), so grams that
lie at no chunk's place are not sent.

Chunks are shared unevenly. Where the words that share one would make more pairs than a multiple of their number,
the rest of the word is compared by what is left of it without one letter, which only words that
differ in that letter share: their number is limited by the alphabet, and what is joined is a result.

Only DataFrame operations; no word list passes the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, functions as F

from evidence_engine.llm.common import materialize

#: Fixed: what counts as a run of letters, and how one in so many runs is misspelled on purpose.
LETTER = "[A-Za-z\\u00C0-\\u00FF]"
NOISE = 31
SHORTEST = 7
LEAST = 2
TIMES = 10
#: Pairs for each word that a shared chunk may make; beyond, the rest of the words is keyed letter by letter.
PAIRS_PER_WORD = 64


def noisy_runs(docs: DataFrame) -> DataFrame:
    """``word`` for each run of at least ``SHORTEST`` letters, A-Z lower-cased; where 31 divides the hash of document and run, a letter is missing."""
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # A shorter run can't yield a word; one that is long enough is matched whole, from its first letter.
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"),
        F.explode(F.regexp_extract_all(lowered, F.lit(f"{LETTER}{{{SHORTEST},}}"), F.lit(0))).alias("w"),
    )
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat("d", F.lit(":"), "w"), "UTF-8")))
    place = (F.col("h") % F.length("w")).cast("int")
    shorter = F.concat(F.substring("w", F.lit(1), place), F.substring("w", place + 2, F.length("w")))
    return hashed.select(F.when(F.col("h") % NOISE == 0, shorter).otherwise(F.col("w")).alias("word"))


def count_words(runs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    counted = runs.where(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least)


def _merged(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join that sends neither side to all tasks. Spark sizes words, and what is cut from them, by the compressed
    files of the words; the rows of a file of 10 MB can be a hundred times that, and would pass the driver."""
    return left.join(right.hint("merge"), on, how)


def _cuts(words: DataFrame) -> DataFrame:
    """Chunks: ``key, size, word, rest``, two for each word; ``rest`` is what the chunk leaves of it."""
    length = F.length("word")
    half = F.floor(length / 2).cast("int")
    head = F.struct(
        F.lit("head").alias("side"),
        F.substring("word", F.lit(1), half).alias("part"),
        F.substring("word", half + 1, length).alias("rest"),
    )
    tail = F.struct(
        F.lit("tail").alias("side"),
        F.substring("word", length - half + 1, half).alias("part"),
        F.substring("word", F.lit(1), length - half).alias("rest"),
    )
    cut = words.select("word", length.alias("size"), F.explode(F.array(head, tail)).alias("c"))
    return _keyed(cut)


def _grams(words: DataFrame) -> DataFrame:
    """Grams at the places of chunks of words as long, or shorter by one, whose length is ``size``: ``key, size, word, rest``."""
    length = F.length("word")

    def at(size: Column) -> list[Column]:
        half = F.floor(size / 2).cast("int")
        head = (F.lit("head"), F.substring("word", F.lit(1), half), F.substring("word", half + 1, length))
        # The chunk begins at size - half; here it begins later by the difference of the lengths.
        start = (length - size) + size - half
        tail = (F.lit("tail"), F.substring("word", start + 1, half), F.substring("word", F.lit(1), start))
        return [
            F.struct(size.alias("size"), side.alias("side"), part.alias("part"), rest.alias("rest"))
            for side, part, rest in (head, tail)
        ]

    cut = words.select("word", F.explode(F.array(*at(length), *at(length - 1))).alias("c"))
    return _keyed(cut.withColumn("size", F.col("c.size")))


def _keyed(cut: DataFrame) -> DataFrame:
    key = F.xxhash64("size", "c.side", "c.part").alias("key")
    return cut.select(key, "size", "word", F.col("c.rest").alias("rest"), (F.col("c.side") == "tail").alias("is_tail"))


def _letters_out(rest: Column) -> Column:
    """``at, left``: a string without each of its letters in turn."""
    places = F.sequence(F.lit(1), F.length(rest))
    return F.transform(
        places, lambda i: F.struct(i.alias("at"), F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))).alias("left"))
    )


def _one_by_one(cuts: DataFrame, grams: DataFrame) -> DataFrame:
    """Pairs of crowded chunks. Equal lengths: the rests agree but for the letter at one place. Else: the longer rest
    without a letter is the shorter one, which is told by place 0."""
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("rest").alias("left")))
    less = F.transform(_letters_out(F.col("rest")), lambda x: F.struct(F.lit(0).alias("at"), x["left"].alias("left")))
    same = F.col("size") == F.length("word")
    left = cuts.select("key", F.col("word").alias("x"), "is_tail", F.inline(F.concat(_letters_out(F.col("rest")), whole)))
    right = grams.select(
        "key", F.col("word").alias("y"), F.inline(F.when(same, _letters_out(F.col("rest"))).otherwise(F.array_distinct(less)))
    )
    return _merged(left, right, ["key", "at", "left"]).select("x", "y", "is_tail")


def near_pairs(words: DataFrame, pairs_per_word: int = PAIRS_PER_WORD) -> DataFrame:
    """``x, y``: pairs of distinct words that differ by exactly one edit, each once; ``words`` is a written table."""
    cuts, grams = _cuts(words), _grams(words)
    sides = cuts.select("key", F.lit(1).alias("c"), F.lit(0).alias("g")).unionAll(
        grams.select("key", F.lit(0).alias("c"), F.lit(1).alias("g"))
    )
    # Every word meets itself: a key with one gram makes no pair.
    shared = sides.groupBy("key").agg(F.sum("c").alias("c"), F.sum("g").alias("g")).where("c > 0 and g > 1")
    crowded = F.col("c") * F.col("g") > pairs_per_word * (F.col("c") + F.col("g"))
    keys = materialize(shared.select("key", crowded.alias("crowded")), "chunks")
    few, many = (keys.where(c).select("key") for c in (~F.col("crowded"), F.col("crowded")))

    plain = _merged(
        _merged(cuts, few, "key").select("key", F.col("word").alias("x"), "is_tail"),
        grams.select("key", F.col("word").alias("y")),
        "key",
    )
    found = plain.select("x", "y", "is_tail").unionAll(
        _one_by_one(_merged(cuts, many, "key", "left_semi"), _merged(grams, many, "key", "left_semi"))
    )
    longer = F.length("x") < F.length("y")
    ordered = longer | ((F.length("x") == F.length("y")) & (F.col("x") < F.col("y")))
    half = F.floor(F.length("x") / 2).cast("int")
    by_head = F.substring("x", F.lit(1), half) == F.substring("y", F.lit(1), half)
    once = ~F.col("is_tail") | ~by_head
    return found.where(ordered & once & (F.levenshtein("x", "y", 1) == 1)).select("x", "y")


def _follow(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form. A form is at least ten times as frequent, so chains are
    short and have an end; each round doubles the step."""
    step = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = _merged(step, onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
        )
        moved = materialize(moved, "roots")
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def group_variants(words: DataFrame, times: int = TIMES, pairs_per_word: int = PAIRS_PER_WORD) -> DataFrame:
    """``word, n`` (each word once) to ``word, form, root, n, n_near, form_n``.

    A word's form is its most frequent near word, the smallest of equally frequent ones, if that is
    at least ``times`` as frequent; its root is where following forms ends. Words without near words
    have none, count 0 of them, and are their own root. An empty table gives an empty one.
    """
    words = materialize(words.select("word", "n"), "words")
    pairs = materialize(near_pairs(words, pairs_per_word), "near")
    both = pairs.unionAll(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    with_n = _merged(both, words.select(F.col("word").alias("y"), F.col("n").alias("m")), "y")
    best = F.min(F.struct((-F.col("m")).alias("m"), F.col("y").alias("y"))).alias("best")
    near = with_n.groupBy(F.col("x").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best)
    known = _merged(words, near, "word", "left")
    has_form = -F.col("best.m") >= times * F.col("n")
    formed = materialize(
        known.select(
            "word",
            F.when(has_form, F.col("best.y")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, -F.col("best.m")).alias("form_n"),
        ),
        "formed",
    )
    roots = _follow(formed.where("form is not null"))
    return _merged(formed, roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """Variants among the words of whole texts, ``doc_id, text``; other columns are not looked at.

    Missing texts have no words; a missing id counts as an empty string; repeated rows count each time.
    """
    return group_variants(count_words(noisy_runs(docs.select("doc_id", "text"))))
